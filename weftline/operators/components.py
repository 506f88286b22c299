"""Connected components over an edge table: union-find in one task for few edges, else star contraction.

Each round of the contraction replaces the edge set by one with the same components and a smaller diameter (the
"two-phase" large-star / small-star scheme of Kiveris et al., 2014).  A vertex of any degree only ever meets an aggregate
and an equi-join: the minimum of its neighbourhood is a map-side-combined ``min``, and the join back to the edges is one
that adaptive execution may split where a hub makes it skewed.  Nothing is collected; the driver sees two numbers a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.fixpoint import is_small, one_table
from weftline.plans.shared import Stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges ``(u, v)`` with u > v, each pair once."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def union_find(edges: pa.Table) -> pa.Table:
    """``(v, comp)`` of the vertices of an edge table held in memory; they are numbered in order, so the least root wins."""
    kind = edges.column(0).type
    ends = pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks], kind).combine_chunks()
    coded = ends.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    order = np.array(names.to_pylist(), object).argsort(kind="stable") if len(names) else np.empty(0, np.int64)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    codes = rank[codes] if len(names) else codes
    root, n = list(range(len(names))), edges.num_rows

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in zip(codes[:n].tolist(), codes[n:].tolist(), strict=True):
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    inverse = pa.array(order, pa.int64())
    top = inverse.take(pa.array([find(x) for x in range(len(root))], pa.int64()))
    return pa.table({"v": names.take(inverse), "comp": names.take(top)})


def components(edges: DataFrame, a: str = "u", b: str = "v", small: bool | None = None) -> DataFrame:
    """Label every vertex of ``edges`` with the smallest vertex it is connected to.

    Returns ``(v, comp)``, one row per vertex that occurs in an edge between two different vertices; the vertex type
    may be any orderable type.  Self-loops, repeated edges and either orientation are accepted; rows with a null end
    link nothing.  An empty edge table gives an empty result.  ``small`` chooses the strategy, by default the number of
    edges does; the result is the same.
    """
    stash = Stash(edges.sparkSession)
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = now.select(high.alias("u"), low.alias("v"))
    if is_small(now) if small is None else small:
        kind = dict(now.dtypes)["u"]
        return one_table(now, union_find, f"v {kind}, comp {kind}")
    now = stash.keep(now.distinct(), "edges")
    before = _state(now)
    while before[0]:
        turned = stash.keep(_star(_star(now, True), False), "edges")
        after = _state(turned)
        stash.drop(now)
        now = turned
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("v"), F.col("v").alias("comp")).union(
        now.select("v", F.col("v").alias("comp")).distinct()
    )

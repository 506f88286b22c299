"""Graph operators over edge tables.

Vertices are bigint ids; an edge table has ``u`` and ``v`` and, where the order of edges matters, a unique ``id``.
Every operator has one result for all physical strategies: up to ``SMALL_ROWS`` edges it runs as one sequential task,
beyond that as rounds of joins and map-side-combined aggregates with one written table a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import components
from weftline.plans.fixpoint import in_one_task, is_small, reserve_and_commit
from weftline.plans.shared import Stash


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge as two directed ones ``(src, dst)``, without loops and repeats."""
    a = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return a.union(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def _adjacency(edges: dict[str, list]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for s, d in zip(edges["src"], edges["dst"], strict=True):
        out.setdefault(s, []).append(d)
    return out


def bfs(directed: DataFrame, start: int, small: bool | None = None) -> DataFrame:
    """``(v, level)`` of every vertex reachable from ``start`` over edges ``(src, dst)``; the start has level 0."""
    if is_small(directed) if small is None else small:

        def kernel(e):
            ways, seen, front = _adjacency(e), {start: 0}, [start]
            while front:
                level, after = seen[front[0]] + 1, []
                for s in front:
                    for d in ways.get(s, ()):
                        if d not in seen:
                            seen[d] = level
                            after.append(d)
                front = after
            return {"v": list(seen), "level": list(seen.values())}

        return in_one_task(directed.select("src", "dst"), kernel, "v bigint, level bigint")
    spark, stash = directed.sparkSession, Stash(directed.sparkSession)
    directed = stash.keep(directed.select("src", "dst"), "directed")
    front = spark.range(1).select(F.lit(start).cast("bigint").alias("v"), F.lit(0).cast("bigint").alias("level"))
    seen = front = stash.keep(front, "front")
    while True:
        reached = front.join(directed, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), (F.col("level") + 1).alias("level")).distinct()
        front = stash.keep(reached.join(seen.select("v"), "v", "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = stash.keep(seen.union(front), "seen")


def bfs_summary(levels: DataFrame) -> DataFrame:
    """Number of vertices reached and of rounds, the round of the start included."""
    return levels.agg(F.count(F.lit(1)).alias("visited"), (F.max("level") + 1).alias("rounds"))


def reachable(directed: DataFrame, start: int) -> DataFrame:
    """The vertices reachable from ``start``, itself included."""
    return bfs(directed, start).select("v")


def _union_find(pairs) -> tuple[dict[int, int], list[bool]]:
    """Roots after linking all pairs, smallest vertex on top, and whether each pair linked two components."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    linked = []
    for u, v in pairs:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
        linked.append(a != b)
    return {x: find(x) for x in list(root)}, linked


def connected_components(vertices: DataFrame, edges: DataFrame, id: str = "id", small: bool | None = None) -> DataFrame:
    """``(v, comp)`` for every vertex, isolated ones included; ``comp`` is the smallest vertex of the component."""
    if is_small(edges) if small is None else small:

        def kernel(e):
            roots, _ = _union_find(zip(e["u"], e["v"], strict=True))
            return {"v": list(roots), "comp": list(roots.values())}

        named = in_one_task(edges.select("u", "v"), kernel, "v bigint, comp bigint")
    else:
        named = components(edges, small=False)
    return vertices.select(F.col(id).alias("v")).join(named, "v", "left").select("v", F.coalesce("comp", "v").alias("comp"))


def maximal_independent_set(vertices: DataFrame, edges: DataFrame, id: str = "id", small: bool | None = None) -> DataFrame:
    """``v`` of the lexicographically first maximal independent set: in id order, whoever has no chosen neighbour."""
    ways = both_ways(edges)
    touched = ways.select(F.col("src").alias("v")).distinct()
    alone = vertices.select(F.col(id).alias("v")).join(touched, "v", "left_anti")
    if is_small(edges) if small is None else small:

        def kernel(e):
            near, chosen = _adjacency(e), set()
            for v in sorted(near):
                if not any(n in chosen for n in near[v]):
                    chosen.add(v)
            return {"v": sorted(chosen)}

        return in_one_task(ways, kernel, "v bigint").union(alone)
    stash = Stash(edges.sparkSession)
    left, chosen = stash.keep(ways, "left"), None
    while True:
        # A vertex without a lower undecided neighbour joins; its neighbours are out.
        least = left.groupBy("src").agg(F.min("dst").alias("m"))
        now = least.where("src < m").select(F.col("src").alias("v"))
        chosen = stash.keep(now if chosen is None else chosen.union(now), "chosen")
        out = left.join(now, F.col("src") == F.col("v"), "left_semi").select(F.col("dst").alias("v")).distinct()
        gone = stash.keep(now.union(out), "gone")
        rest = left.join(gone, F.col("src") == F.col("v"), "left_anti").join(gone, F.col("dst") == F.col("v"), "left_anti")
        # Undecided vertices whose neighbours are all out lose their last edge here and join.
        freed = left.select(F.col("src").alias("v")).distinct().join(gone, "v", "left_anti")
        rest = stash.keep(rest, "left")
        freed = freed.join(rest.select(F.col("src").alias("v")).distinct(), "v", "left_anti")
        chosen = stash.keep(chosen.union(freed), "chosen")
        if rest.isEmpty():
            return chosen.union(alone)
        left = rest


def maximal_matching(edges: DataFrame, small: bool | None = None) -> DataFrame:
    """``id`` of the greedy matching in the order of edge ids."""
    rows = edges.where("u <> v").select("id", "u", "v")
    if is_small(rows) if small is None else small:

        def kernel(e):
            taken, out = set(), []
            for i, u, v in sorted(zip(e["id"], e["u"], e["v"], strict=True)):
                if u not in taken and v not in taken:
                    taken |= {u, v}
                    out.append(i)
            return {"id": out}

        return in_one_task(rows, kernel, "id bigint")
    return reserve_and_commit(rows.select("id", F.array("u", "v").alias("keys")), small=small)


def minimum_spanning_forest(edges: DataFrame, weight: str = "w", small: bool | None = None) -> DataFrame:
    """``id`` of the edges of the unique minimum spanning forest under the order (weight, id)."""
    rows = edges.where("u <> v").select("id", "u", "v", F.col(weight).alias("w"))
    if is_small(rows) if small is None else small:

        def kernel(e):
            order = sorted(zip(e["w"], e["id"], e["u"], e["v"], strict=True))
            _, linked = _union_find((u, v) for _, _, u, v in order)
            return {"id": [x[1] for x, taken in zip(order, linked, strict=True) if taken]}

        return in_one_task(rows, kernel, "id bigint")
    stash = Stash(edges.sparkSession)
    left, chosen = stash.keep(rows, "left"), None
    while not left.isEmpty():
        # Each component takes its lightest edge; components joined by those edges contract.
        ends = left.select(F.explode(F.array("u", "v")).alias("c"), F.struct("w", "id", "u", "v").alias("e"))
        picked = stash.keep(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "picked")
        chosen = stash.keep(picked.select("id") if chosen is None else chosen.union(picked.select("id")), "forest")
        name = stash.keep(components(picked), "names")
        moved = left.join(name.select(F.col("v").alias("u"), F.col("comp").alias("cu")), "u", "left")
        moved = moved.join(name.select("v", F.col("comp").alias("cv")), "v", "left")
        left = stash.keep(moved.select("id", F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"), "w").where("u <> v"), "left")
    return rows.select("id").limit(0) if chosen is None else chosen


def spanning_forest(edges: DataFrame, small: bool | None = None) -> DataFrame:
    """``id`` of the spanning forest that greedy selection in id order gives."""
    return minimum_spanning_forest(edges.withColumn("__w", F.col("id")), "__w", small)


def edge_list(directed: DataFrame) -> DataFrame:
    """Undirected edges ``(id, u, v)`` with u < v of a symmetric adjacency ``(src, dst)``, numbered by (u, v)."""
    from weftline.plans.blocked import sorted_positions

    pairs = directed.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    return sorted_positions(pairs, [F.col("u"), F.col("v")], "id").select("id", "u", "v")


def weighted_edges(edges: DataFrame) -> DataFrame:
    """Edges with a reproducible pseudo-random weight of their id."""
    return edges.withColumn("w", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))

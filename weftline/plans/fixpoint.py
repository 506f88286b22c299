"""Iterate a plan to its fixpoint with one written cut a round, and the kernel that small inputs run in one task."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.shared import Stash

SMALL_ROWS = 500_000


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], going: Callable[[DataFrame, int], bool], label: str = "state") -> DataFrame:
    """Apply ``step(state, round)`` while ``going(state, round)``; each state is a table in the shared folder."""
    stash = Stash(state.sparkSession)
    now, k = stash.keep(state, label), 0
    while going(now, k):
        after = stash.keep(step(now, k), label)
        stash.drop(now)
        now, k = after, k + 1
    return now


def is_small(df: DataFrame, most: int = SMALL_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no further than that."""
    return df.limit(most + 1).count() <= most


def one_table(df: DataFrame, kernel: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``kernel`` in one task on all rows of an input that ``is_small``, as an Arrow table; an empty input runs it too."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct, given = StructType.fromDDL(schema), to_arrow_schema(df.schema)
    kind = to_arrow_schema(struct)

    def run(batches):
        whole = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=given) for b in batches], given)
        yield from kernel(whole).select(kind.names).cast(kind).combine_chunks().to_batches()

    return df.coalesce(1).mapInArrow(run, struct)


def in_one_task(df: DataFrame, kernel: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Like ``one_table`` with the rows as lists by column."""

    return one_table(df, lambda whole: pa.table({c: pa.array(v) for c, v in kernel(whole.to_pydict()).items()}), schema)


def reserve_and_commit(items: DataFrame, keys: str = "keys", small: bool | None = None) -> DataFrame:
    """``id`` of the items that a sequential pass in id order would commit, when an item needs all its ``keys`` unused.

    Every round all remaining items reserve their keys, the smallest id wins each key, and an item that wins all of its
    own commits; items that share a key with a committed one are out.  An item without keys commits.  What is left when it
    is small is passed through in order by one task, as a chain of items would commit only a few a round; ``small=False``
    keeps to rounds.
    """
    stash = Stash(items.sparkSession)
    rows = items.select("id", F.array_distinct(keys).alias("keys"))
    free = rows.where("coalesce(size(keys), 0) <= 0").select("id")
    left, chosen = stash.keep(rows.where("size(keys) > 0"), "left"), free

    def in_order(rows: dict[str, list]) -> dict[str, list]:
        used, out = set(), []
        for i, ks in sorted(zip(rows["id"], rows["keys"], strict=True)):
            if used.isdisjoint(ks):
                used.update(ks)
                out.append(i)
        return {"id": out}

    while not left.isEmpty():
        if small is None and is_small(left):
            return chosen.union(in_one_task(left, in_order, f"id {dict(left.dtypes)['id']}"))
        each = left.select("id", F.size("keys").alias("need"), F.explode("keys").alias("key"))
        held = each.groupBy("key").agg(F.min("id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("won"))
        won = stash.keep(left.join(held, "id").where("won = size(keys)").select("id", "keys"), "won")
        chosen = stash.keep(chosen.union(won.select("id")), "chosen")
        out = each.join(won.select(F.explode("keys").alias("key")), "key", "left_semi").select("id").distinct()
        after = stash.keep(left.join(out, "id", "left_anti"), "left")
        stash.drop(left, won)
        left = after
    return chosen

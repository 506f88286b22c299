"""Grid cells and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.bits import spread_bits
from weftline.plans.blocked import sorted_positions
from weftline.plans.shared import Stash


def grid_coordinate(x: Column, low, size, bits: int) -> Column:
    """Number of the cell on one axis, clamped to ``0 .. 2^bits - 1``."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit((1 << bits) - 1).cast("bigint"), F.floor((x - low) / size)))


def morton_cell(axes: list[Column], low: list, size, bits: int) -> Column:
    """Interleaved bits of the cell coordinates; the first axis has the lowest bit."""
    out = F.lit(0).cast("bigint")
    for i, (x, lo) in enumerate(zip(axes, low, strict=True)):
        out = out.bitwiseOR(F.shiftleft(spread_bits(grid_coordinate(x, lo, size, bits), len(axes) - 1, bits), i))
    return out


def cell_center(cell: Column, axes: int, low: list, size, bits: int) -> list[Column]:
    """Centre of a Morton cell."""
    out = []
    for i in range(axes):
        c = F.lit(0).cast("bigint")
        for b in range(bits):
            c = c.bitwiseOR(F.shiftleft(F.shiftright(cell, b * axes + i).bitwiseAND(1), b))
        out.append(F.lit(low[i]) + (c + 0.5) * F.lit(size))
    return out


def by_cell(points: DataFrame, cell: str, n: int) -> DataFrame:
    """Points of a cell together, in space-filling order."""
    return points.repartitionByRange(n, cell).sortWithinPartitions(cell)


def leaf_order(points: DataFrame, cell: str, id: str = "id") -> DataFrame:
    """Position of each point on the space-filling curve; ties by id."""
    return sorted_positions(points, [F.col(cell), F.col(id)])


def nearest_neighbors(points: DataFrame, k: int, axes: tuple[str, ...] = ("x", "y"), per_cell: int = 8) -> DataFrame:
    """``(id, rank, ngh, d2)``: the k nearest other points of each point, nearest first, ties by id.

    Points are hashed to a grid of about ``per_cell`` points a cell.  In each round the points that are not settled look
    at the cells within the current ring; a point is settled when its k-th neighbour is no further than the ring reaches.
    The ring doubles, so all but outliers settle in the first round.  A cell that holds far more points than others is
    split by the join's skew handling.
    """
    stash = Stash(points.sparkSession)
    n = points.count()
    box = points.agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
    if n == 0 or k <= 0:
        return points.select("id", F.lit(0).cast("bigint").alias("rank"), F.col("id").alias("ngh"), F.lit(0.0).alias("d2")).limit(0)
    low = [box[2 * i] for i in range(len(axes))]
    span = max(max(box[2 * i + 1] - box[2 * i] for i in range(len(axes))), 1e-300)
    cells = max(1, int((n / per_cell) ** (1 / len(axes))))
    size = span / cells
    coords = [F.floor((F.col(a) - lo) / size).cast("bigint").alias(f"c{i}") for i, (a, lo) in enumerate(zip(axes, low, strict=True))]
    placed = stash.keep(points.select("id", *axes, *coords), "placed")
    c = [f"c{i}" for i in range(len(axes))]
    other = placed.select(F.col("id").alias("ngh"), *[F.col(a).alias(f"o{a}") for a in axes], *c)
    todo, done, ring = placed, None, 1
    want = min(k, n - 1)
    while True:
        around = todo
        for x in c:
            around = around.withColumn(x, F.explode(F.sequence(F.greatest(F.col(x) - ring, F.lit(0)), F.least(F.col(x) + ring, F.lit(cells)))))
        d2 = sum(((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in axes[1:]), (F.col(axes[0]) - F.col(f"o{axes[0]}")) * (F.col(axes[0]) - F.col(f"o{axes[0]}")))
        pairs = around.join(other, c).where("id <> ngh").select("id", "ngh", d2.alias("d2"))
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "ngh"))).where(F.col("rank") <= k)
        best = stash.keep(best.select("id", F.col("rank").cast("bigint").alias("rank"), "ngh", "d2"), "near")
        far = best.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.max("d2").alias("far"))
        # A point may lie anywhere in its cell, so the ring surely covers ring * size around it; strictly, for the ties.
        settled = far.where((F.col("m") >= want) & (F.sqrt("far") < ring * size * (1 - 1e-12))) if ring < cells else far
        part = best.join(settled.select("id"), "id", "left_semi")
        done = part if done is None else done.unionByName(part)
        if ring >= cells:
            return done
        todo = stash.keep(todo.join(settled.select("id"), "id", "left_anti"), "todo")
        if todo.isEmpty():
            return done
        ring = min(cells, ring * 4)

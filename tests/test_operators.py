"""Hand-made inputs with known answers, sequential baselines, and agreement of the physical strategies."""

from __future__ import annotations

import itertools
import math
import random
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import bits
from weftline.functions import geometry as g
from weftline.operators import aggregate, distinct, geometry, graph, order, scan, sequence, spatial, text
from weftline.operators.components import components
from weftline.plans.fixpoint import iterate, reserve_and_commit
from weftline.sources import binary, generators

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def seq(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "idx bigint, val bigint")


def column(df, name, by="idx"):
    return [r[name] for r in df.orderBy(by).collect()]


def graph_of(spark, pairs, weights=None):
    rows = [(i, min(p), max(p), weights[i] if weights else i) for i, p in enumerate(pairs)]
    return spark.createDataFrame(rows, "id bigint, u bigint, v bigint, w bigint")


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


@pytest.mark.parametrize(
    "how, want",
    [({}, [0, 3, 4, 8, 9]), ({"inclusive": True}, [3, 4, 8, 9, 14]), ({"back": True}, [11, 10, 6, 5, 0]), ({"back": True, "inclusive": True}, [14, 11, 10, 6, 5])],
)
def test_scans(spark, how, want):
    s = seq(spark, [3, 1, 4, 1, 5])
    for block in (1, 2, 100):
        assert column(scan.scan(s, F.col("val"), block=block, **how), "scan") == want
    assert scan.scan_total(s, F.col("val"))[1].first()[0] == 14


@FEW
@given(st.lists(st.integers(0, 32), max_size=40), st.sampled_from(["sum", "min", "max"]), st.booleans(), st.booleans())
def test_scan_is_the_sequential_scan(spark, values, op, inclusive, back):
    f = {"sum": lambda a, b: a + b, "min": min, "max": max}[op]
    zero = {"sum": 0, "min": 99, "max": -99}[op]
    want, acc = [], zero
    for v in values[::-1] if back else values:
        want.append(f(acc, v) if inclusive else acc)
        acc = f(acc, v)
    got = column(scan.scan(seq(spark, values), F.col("val"), op, zero, inclusive=inclusive, back=back, block=7), "scan")
    assert got == (want[::-1] if back else want)


@FEW
@given(st.lists(st.tuples(st.integers(0, 32), st.booleans()), max_size=40))
def test_pack_and_partition(spark, rows):
    df = spark.createDataFrame([(i, v, b) for i, (v, b) in enumerate(rows)], "idx bigint, val bigint, f boolean")
    kept = [v for v, b in rows if b]
    packed = sequence.pack(df, F.col("f")).orderBy("pos").collect()
    assert [r.val for r in packed] == kept and [r.pos for r in packed] == list(range(len(kept)))
    assert column(sequence.partition(df, F.col("f")), "val", "pos") == kept + [v for v, b in rows if not b]
    assert column(sequence.pack_index(df, F.col("f")), "idx", "pos") == [i for i, (_, b) in enumerate(rows) if b]


def test_pack_fixture(spark):
    df = spark.createDataFrame([(i, 10 + i, f) for i, f in enumerate([True, False, True, True, False])], "idx bigint, val bigint, f boolean")
    assert column(sequence.pack(df, F.col("f")), "val", "pos") == [10, 12, 13]


def test_arg_best_ties(spark):
    s = seq(spark, [2, 7, 7, 1])
    assert tuple(aggregate.arg_best(s, F.col("val")).first()) == (1, 7)
    assert tuple(aggregate.arg_best(s, F.col("val"), largest=False).first()) == (3, 1)
    assert tuple(aggregate.reduce(seq(spark, []), "max", F.col("val")).first()) == (None,)


def test_dedup_and_tables(spark):
    t = spark.createDataFrame([("a", 1), ("b", 5), ("a", 3)], "k string, v int")
    assert sorted(map(tuple, distinct.keep_largest(t, "k", "v").collect())) == [("a", 3), ("b", 5)]
    gone = distinct.delete(distinct.keep_largest(t, "k", "v"), spark.createDataFrame([("a",)], "k string"), "k")
    assert [tuple(r) for r in gone.collect()] == [("b", 5)]


def test_histogram_offsets(spark):
    rows = aggregate.histogram(seq(spark, [0, 0, 2, 2, 2]), F.col("val"), 4).orderBy("bucket").collect()
    assert [r["first"] for r in rows] == [0, 2, 2, 5]


@FEW
@given(st.lists(st.integers(0, 32), max_size=40), st.lists(st.integers(0, 32), max_size=40))
def test_sort_merge_bounds(spark, a, b):
    assert column(order.sort_sequence(seq(spark, a), F.col("val")), "val", "pos") == sorted(a)
    merged = order.merge(seq(spark, sorted(a)), seq(spark, sorted(b))).orderBy("pos").collect()
    assert [r.val for r in merged] == sorted(a + b)
    got = dict(map(tuple, order.upper_bounds(seq(spark, a), seq(spark, b)).collect()))
    assert got == {x: sum(y <= x for y in a) for x in b}


def test_permutation_is_one(spark):
    assert sorted(column(order.permuted(seq(spark, [0] * 50), 7, 50), "idx")) == list(range(50))


@pytest.mark.parametrize("small", [True, False])
def test_path_of_four(spark, small):
    e = graph_of(spark, [(0, 1), (1, 2), (2, 3)])
    vertices = spark.range(5)
    assert ids(graph.maximal_independent_set(vertices, e, small=small), "v") == [0, 2, 4]
    assert ids(graph.maximal_matching(e, small=small)) == [0, 2]
    levels = graph.bfs(graph.both_ways(e), 0, small=small)
    assert tuple(graph.bfs_summary(levels).first()) == (4, 4)
    m = graph_of(spark, [(0, 1), (1, 2), (0, 2)], [5, 1, 2])
    assert ids(graph.minimum_spanning_forest(m, small=small)) == [1, 2]
    assert ids(graph.spanning_forest(graph_of(spark, [(1, 2), (0, 2), (0, 1)]), small=small)) == [0, 1]


def test_strategies_agree_on_a_random_graph(spark):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    e = graph_of(spark, pairs, [rng.randrange(40) for _ in pairs])
    v = spark.range(60)
    for run in (
        lambda s: ids(graph.maximal_independent_set(v, e, small=s), "v"),
        lambda s: ids(graph.maximal_matching(e, small=s)),
        lambda s: sorted(map(tuple, graph.connected_components(v, e, small=s).collect())),
        lambda s: ids(graph.minimum_spanning_forest(e, small=s)),
        lambda s: sorted(map(tuple, graph.bfs(graph.both_ways(e), 0, small=s).collect())),
    ):
        assert run(True) == run(False)


def test_iterate_and_reservations(spark):
    grown = iterate(spark.range(1).select(F.lit(1).alias("x")), lambda s, k: s.select((F.col("x") * 3).alias("x")), lambda s, k: s.first().x < 100)
    assert grown.first().x == 243
    items = spark.createDataFrame([(0, ["a", "b"]), (1, ["b", "c"]), (2, ["c"]), (3, []), (4, ["c", "d"]), (5, None)], "id bigint, keys array<string>")
    assert ids(reserve_and_commit(items)) == [0, 2, 3, 5]


def test_components_of_a_long_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("word", ["banana", "aaaa", "x", "mississippi"])
def test_suffix_array(spark, small, word):
    df = text.byte_sequence(spark.createDataFrame([(word,)], "s string"), "s")
    got = column(text.suffix_array(df, small=small), "idx", "pos")
    assert got == sorted(range(len(word)), key=lambda i: word[i:])


def test_hull(spark):
    square = [(0, 0.0, 0.0), (1, 0.0, 2.0), (2, 2.0, 2.0), (3, 2.0, 0.0), (4, 1.0, 1.0), (5, 1.0, 0.0), (6, 0.0, 0.0)]
    p = spark.createDataFrame(square, "id bigint, x double, y double").repartition(3)
    assert column(geometry.convex_hull(p), "id", "pos") == [0, 1, 2, 3]
    ring = generators.points(spark, 60, "on")
    assert geometry.convex_hull(ring).count() == 60


def test_neighbors_with_outliers_and_duplicates(spark):
    rng = random.Random(3)
    pts = [(i, rng.random(), rng.random()) for i in range(120)] + [(120, 500.0, 500.0), (121, 0.5, 0.5), (122, 0.5, 0.5)]
    df = spark.createDataFrame(pts, "id bigint, x double, y double")
    got = {}
    for r in spatial.nearest_neighbors(df, 4).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.ngh
    for i, x, y in pts:
        want = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in pts if j != i)[:4]
        assert [got[i][k + 1] for k in range(4)] == [j for _, j in want]


def test_ray_blocks_agree_and_miss(spark):
    from weftline.sources import fixtures as fx

    p, t = fx.grid_points(spark), fx.grid_tris(spark)
    rays = fx.grid_rays(spark).union(spark.sql("SELECT 99L, 50.0D, 50.0D, 10.0D, 0.01D, 0.02D, -1.0D"))
    one, many = (sorted(map(tuple, geometry.ray_cast(p, t, rays, block).collect())) for block in (1000, 40))
    assert one == many and (99, -1) in one


def test_delaunay_and_refinement_properties(spark):
    p = generators.points(spark, 60, "square", seed=4)
    t = geometry.delaunay(p).collect()
    at = {r.id: (r.x, r.y) for r in p.collect()}
    hull = geometry.convex_hull(p).count()
    assert len(t) == 2 * 60 - 2 - hull
    for r in t:
        x, y, rr = geometry._circum(at[r.a], at[r.b], at[r.c])
        assert all((q[0] - x) ** 2 + (q[1] - y) ** 2 >= rr * (1 - 1e-9) for q in at.values())
    for r in geometry.refine(p).collect():
        assert geometry._least_angle((r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy)) >= math.radians(29.99)


def empty_circles(points):
    """Triangles of distinct corners whose circle holds no point, by exact arithmetic on all of them."""
    return {
        t for t in itertools.permutations(sorted(points), 3)
        if t[0] == min(t) and geometry.orientation(*t) > 0 and all(geometry.circle_side(*t, p) <= 0 for p in points)
    }


@FEW
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=12))
def test_triangulation_of_grid_points(points):
    """Collinear, equal and cocircular points: a valid triangulation of the hull by triangles with empty circles."""
    t = geometry.Triangulation()
    for p in points:
        t.insert((float(p[0]), float(p[1])))
    got = [tuple(t.points[i] for i in x) for x in t.triangles()]
    area = sum(geometry.orientation(*x) for x in got)
    hull = geometry.hull_of([(*p, i) for i, p in enumerate(sorted(set(points)))])
    twice = sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(hull, hull[1:] + hull[:1], strict=True))
    assert area == abs(twice)
    assert all(geometry.circle_side(*x, p) <= 0 for x in got for p in t.points)
    assert not got or {p for x in got for p in x} == set(t.points)


def test_triangulation_of_flat_hulls():
    rng = random.Random(3)
    sets = [[(0, 0), (1, 0), (0.5, 1e-6)], [(0, 0), (1, 0), (0.5, 1e-6), (0.5, 1)], [(i, i * i * 1e-13) for i in range(9)]]
    sets += [[(rng.random(), rng.random() * 10.0 ** -rng.randint(0, 16)) for _ in range(9)] for _ in range(20)]
    for points in sets:
        for order in (points, points[::-1]):
            t = geometry.Triangulation()
            for p in order:
                t.insert((float(p[0]), float(p[1])))
            got = {x[(k := x.index(min(x))) :] + x[:k] for x in (tuple(t.points[i] for i in y) for y in t.triangles())}
            assert got == empty_circles([(float(x), float(y)) for x, y in points])


@FEW
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 50)), max_size=12), st.integers(0, 40))
def test_knapsack(spark, items, capacity):
    best = {0: 0}
    for w, v in items:
        for c, total in sorted(best.items(), reverse=True):
            if c + w <= capacity:
                best[c + w] = max(best.get(c + w, 0), total + v)
    df = spark.createDataFrame([(i, v, w) for i, (w, v) in enumerate(items)], "id bigint, value bigint, weight bigint")
    assert geometry.knapsack(df, capacity).first().best == max(best.values())


def test_scalar_functions(spark):
    row = spark.range(1).select(
        *[bits.log2_up(F.lit(x)).alias(f"l{x}") for x in (0, 1, 2, 3, 4, 5, 1024, 1025)],
        bits.spread_bits(F.lit(7), 1, 3).alias("spread"),
        g.angle((F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(2.0))).alias("right"),
        g.in_circle((F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0)), (F.lit(0.6), F.lit(0.6))).alias("inside"),
        g.box_surface((F.lit(0.0),) * 3, (F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("box"),
    ).first()
    assert list(row)[:8] == [0, 0, 1, 2, 2, 3, 10, 11]
    assert row.spread == 0b10101 and row.right == pytest.approx(90) and row.inside and row.box == 22


def test_binary_layouts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "RANGE", 3)
    f = str(tmp_path / "a")
    binary.write_arrays(f, ("double", [0.5, 1.5, 2.5, 3.5]))
    assert column(binary.read_binary(spark, f, "array", item="double"), "val") == [0.5, 1.5, 2.5, 3.5]
    binary.write_arrays(f, ("point3", [(0, 0, 0), (1, 0, 0), (0, 1, 0)]), ("triangle", [(0, 1, 2)]), ("ray", [(0.1, 0.1, 1, 0.01, 0.01, -1)]))
    p, t, r = (binary.read_binary(spark, f, "rays", part=x) for x in ("points", "tris", "rays"))
    assert (p.count(), t.count(), r.count()) == (3, 1, 1) and r.first().oz == 1
    rays, tris = r.withColumnRenamed("idx", "id"), t.withColumnRenamed("idx", "id")
    assert geometry.ray_cast(p.withColumnRenamed("idx", "id"), tris, rays).first().tri == 0
    words = [b"one", b"", b"three", b"four"]
    (tmp_path / "b").write_bytes(struct.pack("<q4i", 4, *map(len, words)) + b"".join(words))
    assert column(binary.read_binary(spark, str(tmp_path / "b"), "strings"), "s") == ["one", "", "three", "four"]
    pairs = b"".join(w + struct.pack("<i", i) for i, w in enumerate(words))
    (tmp_path / "c").write_bytes(struct.pack("<q4i", 4, *map(len, words)) + pairs)
    assert [tuple(x) for x in binary.read_binary(spark, str(tmp_path / "c"), "string_ints").orderBy("idx").collect()][2] == (2, "three", 2)
    (tmp_path / "d").write_bytes(struct.pack("<i", 5) + b"\xffabcd")
    assert bytes(binary.read_binary(spark, str(tmp_path / "d"), "string").first().text) == b"\xffabcd"
    degree, edges = [2, 0, 1, 1], [1, 2, 3, 0]
    want = [(0, 1), (0, 2), (2, 3), (3, 0)]
    (tmp_path / "e").write_bytes(struct.pack("<2i4i4i", 4, 4, *degree, *edges))
    assert sorted(map(tuple, binary.read_binary(spark, str(tmp_path / "e"), "graph").collect())) == want
    for size, code in ((32, "I"), (64, "Q")):
        (tmp_path / "f").write_bytes(struct.pack("<5Q", binary.GRAPH_MAGIC, size, 4, 4, 0) + struct.pack(f"<9{code}", 0, 2, 2, 3, 4, *edges))
        assert sorted(map(tuple, binary.read_binary(spark, str(tmp_path / "f"), "adjlist").collect())) == want
    (tmp_path / "g").write_text("3 90\n 100 50\n60 40 30 60\n")
    items, capacity = binary.read_knapsack(spark, str(tmp_path / "g"))
    assert capacity == 90 and geometry.knapsack(items, capacity).first().best == 160
    binary.write_arrays(f, ("long", []))
    assert binary.read_binary(spark, f, "array", item="long").count() == 0


def test_generators(spark):
    for kind in ("random", "exponential", "almost", "equal"):
        assert generators.sort_input(spark, 100, kind).count() == 100
    assert generators.rmat(spark, 6, 100).where("u < v").count() > 50
    inside = generators.points(spark, 100, "in", 3).agg(F.max(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).first()[0]
    assert inside <= 1.0001
    assert generators.points(spark, 100, "plummer").count() == 100

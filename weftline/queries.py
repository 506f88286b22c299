"""The catalogue: one query for each operator over the driver's tables, with DuckDB SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import bits
from weftline.functions import geometry as g
from weftline.operators import aggregate, distinct, geometry, graph, order, scan, sequence, spatial, text
from weftline.sources import fixtures as fx
from weftline.sources import generators
from weftline.session import table

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLE: dict[str, str] = {}

SEQ = "s AS (SELECT event_id AS idx, user_id AS val FROM events)"
ORD = "o AS (SELECT o_orderkey AS idx, o_custkey AS val FROM orders)"
EDGES = """e AS (SELECT CAST(row_number() OVER (ORDER BY u, v) - 1 AS BIGINT) AS id, u, v, CAST((u * 7919 + v * 104729) % 1000003 AS BIGINT) AS w
  FROM (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS u, greatest(a.l_partkey, b.l_partkey) AS v FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey))"""
PTS = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
GRID = """gp AS (SELECT CAST(i AS BIGINT) AS id, CAST(i // 9 AS DOUBLE) AS x, CAST(i % 9 AS DOUBLE) AS y, CAST(((i // 9) * 3 + (i % 9) * 5) % 7 AS DOUBLE) / 8 AS z FROM range(81) t(i)),
gt AS (SELECT CAST(2 * (i * 8 + j) + k AS BIGINT) AS id, CAST(i * 9 + j AS BIGINT) AS a, CAST(CASE WHEN k = 0 THEN (i + 1) * 9 + j ELSE (i + 1) * 9 + j + 1 END AS BIGINT) AS b,
  CAST(CASE WHEN k = 0 THEN (i + 1) * 9 + j + 1 ELSE i * 9 + j + 1 END AS BIGINT) AS c FROM range(8) x(i), range(8) y(j), range(2) z(k))"""
CELL = 5  # bits of a Morton coordinate in the queries: cells of 1/8 from -2 on


def query(sql: str | None = None, name: str | None = None):
    def take(f: Q) -> Q:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return take


# 2.2 projection, predicate, compaction ------------------------------------------------------------------------------


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS c FROM lineitem WHERE l_quantity < 25 GROUP BY 1")
def q01_filter_reduce(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity < 25")
    return rows.groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("s"), F.count(F.lit(1)).alias("c"))


@query(f"WITH {SEQ} SELECT idx, val * 2 + 1 AS val FROM s")
def q02_map(spark, d):
    return sequence.map_values(fx.seq_int(spark, d), lambda v: v * 2 + 1)


@query(f"WITH {SEQ} SELECT idx, val FROM s WHERE val % 3 = 0")
def q03_filter(spark, d):
    return sequence.keep_if(fx.seq_int(spark, d), lambda v: v % 3 == 0)


@query(f"WITH {SEQ} SELECT count(*) AS n FROM s WHERE val % 3 = 0")
def q04_filter_count(spark, d):
    return sequence.keep_count(fx.seq_int(spark, d), lambda v: v % 3 == 0)


@query(f"WITH {SEQ} SELECT row_number() OVER (ORDER BY idx) - 1 AS pos, idx, val FROM s WHERE val % 2 = 0")
def q05_pack(spark, d):
    return sequence.pack(fx.seq_int(spark, d), F.col("val") % 2 == 0).select("pos", "idx", "val")


@query(f"WITH {SEQ} SELECT row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM s WHERE val % 2 = 0")
def q06_pack_index(spark, d):
    return sequence.pack_index(fx.seq_int(spark, d), F.col("val") % 2 == 0)


@query(f"WITH {SEQ} SELECT row_number() OVER (ORDER BY (val >= 50) DESC, idx) - 1 AS pos, idx, val FROM s")
def q07_partition(spark, d):
    return sequence.partition(fx.seq_int(spark, d), F.col("val") >= 50).select("pos", "idx", "val")


@query(f"WITH {SEQ}, a AS (SELECT idx, val AS ix FROM s) SELECT a.idx, a.ix, o.val FROM a LEFT JOIN (SELECT o_orderkey AS ix, o_custkey AS val FROM orders) o USING (ix)")
def q08_gather(spark, d):
    wanted = fx.seq_int(spark, d).select(F.col("idx").alias("i"), F.col("val").alias("ix"))
    return sequence.gather(wanted, fx.order_seq(spark, d), at="ix").select(F.col("i").alias("idx"), "ix", "val")


@query(f"WITH {ORD}, r AS (SELECT idx, row_number() OVER (ORDER BY val, idx) - 1 AS pos FROM o) SELECT pos AS idx, idx AS rank FROM r")
def q09_scatter(spark, d):
    return sequence.scatter(order.sort_sequence(fx.order_seq(spark, d), F.col("val")), "pos")


@query(f"WITH {SEQ} SELECT idx, CAST(7 AS BIGINT) AS val FROM s")
def q09b_fill(spark, d):
    return sequence.fill(fx.seq_int(spark, d), 7).withColumn("val", F.col("val").cast("bigint"))


@query(f"WITH {SEQ} SELECT 'L' AS side, idx, val FROM s WHERE val < 20 UNION ALL SELECT 'R', idx, val FROM s WHERE val > 80")
def q09c_split(spark, d):
    left, right = sequence.split(fx.seq_int(spark, d), lambda v: v < 20, lambda v: v > 80)
    return left.select(F.lit("L").alias("side"), "idx", "val").union(right.select(F.lit("R"), "idx", "val"))


@query(
    f"WITH {SEQ}, a AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, val FROM s WHERE val % 2 = 0), b AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, val FROM s WHERE val % 2 = 1)"
    " SELECT idx, val FROM a UNION ALL SELECT idx + (SELECT count(*) FROM a), val FROM b"
)
def q09d_concat(spark, d):
    s = fx.seq_int(spark, d)
    halves = [sequence.pack(s, F.col("val") % 2 == k).select(F.col("pos").alias("idx"), "val") for k in (0, 1)]
    return sequence.concat(*halves).select("idx", "val")


# 2.3 aggregation ----------------------------------------------------------------------------------------------------


@query(f"WITH {SEQ} SELECT CAST(sum(val) AS BIGINT) AS total, min(val) AS low, max(val) AS high FROM s")
def q10_reduce(spark, d):
    v = F.col("val")
    return fx.seq_int(spark, d).agg(F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


@query(f"WITH {SEQ} SELECT CAST(sum((val + 1) * (val % 7)) AS BIGINT) AS value FROM s")
def q11_map_reduce(spark, d):
    return aggregate.reduce(fx.seq_int(spark, d), "sum", (F.col("val") + 1) * (F.col("val") % 7))


@query(f"WITH {SEQ} SELECT idx, val AS value FROM s ORDER BY val DESC, idx LIMIT 1")
def q12_max_index(spark, d):
    return aggregate.arg_best(fx.seq_int(spark, d), F.col("val"))


@query(f"WITH {SEQ} SELECT idx, val AS value FROM s ORDER BY val, idx LIMIT 1")
def q13_min_index(spark, d):
    return aggregate.arg_best(fx.seq_int(spark, d), F.col("val"), largest=False)


@query(f"WITH {SEQ} SELECT count(*) FILTER (val % 3 = 1) AS n FROM s")
def q14_sum_flags(spark, d):
    return fx.seq_int(spark, d).agg(F.count_if(F.col("val") % 3 == 1).alias("n"))


@query(f"WITH {PTS} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM p")
def q15_bounding_box(spark, d):
    return aggregate.bounding_box(fx.points(spark, d))


@query("SELECT o_custkey AS k, min(o_orderkey) AS value FROM orders GROUP BY 1")
def q16_keyed_min(spark, d):
    return aggregate.reduce_by(table(spark, d, "orders").withColumn("k", F.col("o_custkey")), "k", "min", F.col("o_orderkey"))


@query("SELECT o_custkey AS k, max(o_orderkey) AS value FROM orders GROUP BY 1")
def q17_keyed_max(spark, d):
    return aggregate.reduce_by(table(spark, d, "orders").withColumn("k", F.col("o_custkey")), "k", "max", F.col("o_orderkey"))


@query("SELECT o_custkey AS k, CAST(sum(o_orderkey) AS BIGINT) AS value FROM orders GROUP BY 1")
def q17b_keyed_sum(spark, d):
    return aggregate.reduce_by(table(spark, d, "orders").withColumn("k", F.col("o_custkey")), "k", "sum", F.col("o_orderkey"))


@query(f"WITH {PTS} SELECT (SELECT id FROM p ORDER BY x, y, id LIMIT 1) AS leftmost, (SELECT id FROM p ORDER BY x DESC, y DESC, id LIMIT 1) AS rightmost")
def q17c_extreme_points(spark, d):
    return aggregate.extreme_points(fx.points(spark, d))


# 2.4 scans ----------------------------------------------------------------------------------------------------------


@query(f"WITH {SEQ} SELECT idx, CAST(coalesce(sum(val) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM s")
def q18_scan(spark, d):
    return scan.scan(fx.seq_int(spark, d), F.col("val"), block=1024).select("idx", "scan")


@query(f"WITH {SEQ} SELECT idx, CAST(sum(val) OVER (ORDER BY idx) AS BIGINT) AS scan, max(val) OVER (ORDER BY idx) AS top FROM s")
def q19_scan_inclusive(spark, d):
    one = scan.scan(fx.seq_int(spark, d), F.col("val"), inclusive=True, block=1024)
    return scan.scan(one, F.col("val"), "max", inclusive=True, out="top", block=1024).select("idx", "scan", "top")


@query(
    f"WITH {SEQ} SELECT idx, CAST(coalesce(sum(val) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS exclusive,"
    " CAST(sum(val) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS inclusive FROM s"
)
def q20_scan_back(spark, d):
    one = scan.scan(fx.seq_int(spark, d), F.col("val"), back=True, out="exclusive", block=1024)
    return scan.scan(one, F.col("val"), back=True, inclusive=True, out="inclusive", block=1024).select("idx", "exclusive", "inclusive")


@query(
    f"WITH {SEQ}, t AS (SELECT row_number() OVER (ORDER BY val, idx) - 1 AS pos, val FROM s)"
    " SELECT pos, val, coalesce(val <> lag(val) OVER (ORDER BY pos), true) AS changed, dense_rank() OVER (ORDER BY val) - 1 AS rank FROM t"
)
def q21_dense_rank(spark, d):
    t = order.sort_sequence(fx.seq_int(spark, d), F.col("val")).select(F.col("pos").alias("idx"), "val")
    ranked = scan.dense_rank_sorted(t, block=1024)
    return scan.changes(ranked, block=1024).select(F.col("idx").alias("pos"), "val", "changed", "rank")


@query("SELECT o_orderkey AS idx, o_custkey, CAST(coalesce(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM orders")
def q21b_scan_by_key(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), "o_custkey")
    return scan.scan(rows, F.col("idx"), keys=("o_custkey",)).select("idx", "o_custkey", "scan")


# 2.5 sorting, selection, movement -----------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_orderkey AS idx, o_totalprice AS val FROM orders")
def q22_sample_sort(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("val"))
    return order.sort_sequence(rows, F.col("val")).select("pos", "idx", "val")


@query(f"WITH {ORD} SELECT row_number() OVER (ORDER BY val, idx) - 1 AS pos, idx, val FROM o")
def q23_integer_sort(spark, d):
    return order.sort_sequence(fx.order_seq(spark, d), F.col("val")).select("pos", "idx", "val")


@query("SELECT row_number() OVER (ORDER BY o_custkey % 256, o_orderkey) - 1 AS pos, o_custkey % 256 AS k, o_orderkey AS idx FROM orders")
def q24_pair_sort(spark, d):
    rows = fx.order_seq(spark, d).select("idx", (F.col("val") % 256).alias("k"))
    return order.sort_sequence(rows, F.col("k")).select("pos", "k", "idx")


@query(
    f"WITH {SEQ}, {ORD}, m AS (SELECT val, idx, 0 AS src FROM s UNION ALL SELECT val, idx, 1 FROM o) SELECT row_number() OVER (ORDER BY val, src, idx) - 1 AS pos, val, src FROM m"
)
def q25_merge(spark, d):
    return order.merge(fx.seq_int(spark, d), fx.order_seq(spark, d))


@query(f"WITH {SEQ}, {ORD} SELECT val, (SELECT count(*) FROM o WHERE o.val <= t.val) AS bound FROM (SELECT DISTINCT val FROM s) t")
def q26_upper_bound(spark, d):
    return order.upper_bounds(fx.order_seq(spark, d), fx.seq_int(spark, d))


@query(f"WITH {SEQ} SELECT row_number() OVER (ORDER BY val, idx) - 1 AS pos, idx, val FROM s QUALIFY pos = 500")
def q27_select_kth(spark, d):
    return order.select_kth(fx.seq_int(spark, d), 500).select("pos", "idx", "val")


@query(f"WITH {SEQ} SELECT idx, val, CAST(val >= 40 AS INTEGER) AS side, CAST(CASE WHEN val < 20 THEN 0 WHEN val = 20 THEN 1 WHEN val < 60 THEN 2 WHEN val = 60 THEN 3 ELSE 4 END AS BIGINT) AS bucket FROM s")
def q27b_pivots(spark, d):
    return order.pivot_buckets(order.around_pivot(fx.seq_int(spark, d), F.lit(40)), [20, 60])


@query(
    f"WITH {SEQ}, h AS (SELECT val % 300 AS bucket, count(*) AS n FROM s GROUP BY 1), r AS (SELECT b.bucket, coalesce(h.n, 0) AS n FROM range(300) b(bucket) LEFT JOIN h USING (bucket))"
    " SELECT bucket, n, CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM r"
)
def q28_histogram(spark, d):
    return aggregate.histogram(fx.seq_int(spark, d), F.col("val") % 300, 300)


@query("SELECT s.p AS i, vec_id AS j, CAST(embedding[s.p + 1] AS DOUBLE) AS val FROM embeddings, range(64) s(p)")
def q29_transpose(spark, d):
    cells = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "val"))
    cells = cells.select("i", F.col("j").cast("bigint").alias("j"), F.col("val").cast("double").alias("val"))
    return order.transpose(cells).select("i", "j", "val")


@query(f"WITH {SEQ}, n AS (SELECT count(*) AS n FROM s) SELECT CAST((idx * 7919) % n AS BIGINT) AS idx, val FROM s, n")
def q29b_permutation(spark, d):
    s = fx.seq_int(spark, d)
    return order.permuted(s, 7919, s.count())


@query(f"WITH {SEQ} SELECT bucket, count(*) AS n, CAST(1 AS BIGINT) AS parts FROM (SELECT val % 16 AS bucket FROM s) GROUP BY 1")
def q29e_block_move(spark, d):
    """Rows of a bucket and the number of partitions they lie in."""
    moved = order.block_move(fx.seq_int(spark, d).withColumn("bucket", F.col("val") % 16), F.col("bucket"), 4)
    moved = moved.withColumn("p", F.spark_partition_id())
    return moved.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("parts"))


@query(None)
def q29c_hash_sample(spark, d):
    s = fx.seq_int(spark, d)
    return order.hash_sample(s, 100, s.count(), seed=7)


@query("SELECT row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS pos, c_custkey AS idx, c_name AS val FROM customer")
def q29d_string_sort(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("val"))
    return order.sort_sequence(rows, F.col("val")).select("pos", "idx", "val")


# 2.6 distinct -------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT l_partkey FROM lineitem")
def q30_distinct_int(spark, d):
    return distinct.distinct_values(table(spark, d, "lineitem"), "l_partkey")


@query("SELECT DISTINCT text FROM documents")
def q31_distinct_string(spark, d):
    return distinct.distinct_values(table(spark, d, "documents"), "text")


@query("SELECT l_partkey AS k, max(l_orderkey) AS v FROM lineitem GROUP BY 1")
def q32_keep_largest(spark, d):
    return distinct.keep_largest(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("v")), "k", "v")


@query("SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
def q33_delete(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return distinct.delete(parts, table(spark, d, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("k")), "k")


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def q33b_entry_count(spark, d):
    return distinct.entry_count(table(spark, d, "lineitem"), "l_partkey")


@query("SELECT o.o_custkey AS k, c.c_acctbal AS v FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey")
def q33c_find(spark, d):
    held = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return distinct.find(held, table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), "k")


@query("SELECT k, max(v) AS v FROM (SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def q33d_insert(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return distinct.insert(rows.where("v % 2 = 0"), rows.where("v % 3 = 0"), "k", "v")


# 2.8 graphs: greedy selections have no SQL that ends on whole tables; tests/test_whole_inputs.py holds them against
# sequential Python ---------------------------------------------------------------------------------------------------------

_BFS = (
    f"WITH RECURSIVE {EDGES}, d AS (SELECT u AS s, v AS t FROM e UNION SELECT v, u FROM e), b AS (SELECT (SELECT min(u) FROM e) AS v, CAST(0 AS BIGINT) AS level"
    " UNION SELECT d.t, b.level + 1 FROM b JOIN d ON d.s = b.v WHERE b.level < 60), l AS (SELECT v, min(level) AS level FROM b GROUP BY 1) "
)


def _start(edges: DataFrame) -> int:
    return edges.agg(F.min("u")).first()[0]


@query(_BFS + "SELECT v, level FROM l")
def q34_bfs(spark, d):
    e = fx.graph_edges(spark, d)
    return graph.bfs(graph.both_ways(e), _start(e))


@query(_BFS + "SELECT count(*) AS visited, max(level) + 1 AS rounds FROM l")
def q34b_bfs_summary(spark, d):
    e = fx.graph_edges(spark, d)
    return graph.bfs_summary(graph.bfs(graph.both_ways(e), _start(e)))


@query(_BFS + "SELECT v FROM l")
def q35_reachable(spark, d):
    e = fx.graph_edges(spark, d)
    return graph.reachable(graph.both_ways(e), _start(e))


_COMPONENTS = (
    f"WITH RECURSIVE {EDGES}, d AS (SELECT u AS s, v AS t FROM e UNION SELECT v, u FROM e), c(v, comp) USING KEY (v) AS (SELECT p_partkey, p_partkey FROM part"
    " UNION SELECT d.t, min(c.comp) FROM c JOIN d ON d.s = c.v JOIN recurring.c AS r ON r.v = d.t WHERE c.comp < r.comp GROUP BY d.t) SELECT v, comp FROM c"
)


@query(_COMPONENTS)
def q36_components(spark, d):
    return graph.connected_components(fx.part_vertices(spark, d), fx.graph_edges(spark, d))


@query()
def q37_independent_set(spark, d):
    return graph.maximal_independent_set(fx.part_vertices(spark, d), fx.graph_edges(spark, d))


@query()
def q38_matching(spark, d):
    return graph.maximal_matching(fx.graph_edges(spark, d))


@query()
def q39_spanning_tree(spark, d):
    return graph.minimum_spanning_forest(fx.graph_edges(spark, d))


@query()
def q40_spanning_forest(spark, d):
    return graph.spanning_forest(fx.graph_edges(spark, d))


@query(f"WITH {EDGES} SELECT id, u, v FROM e")
def q40b_edge_list(spark, d):
    return graph.edge_list(graph.both_ways(fx.graph_edges(spark, d)))


# The same operators by distributed rounds, whatever the size of the input.


@query(_BFS + "SELECT v, level FROM l")
def q34c_bfs_rounds(spark, d):
    e = fx.graph_edges(spark, d)
    return graph.bfs(graph.both_ways(e), _start(e), small=False)


@query(_COMPONENTS)
def q36b_components_rounds(spark, d):
    return graph.connected_components(fx.part_vertices(spark, d), fx.graph_edges(spark, d), small=False)


@query()
def q37b_independent_set_rounds(spark, d):
    return graph.maximal_independent_set(fx.part_vertices(spark, d), fx.graph_edges(spark, d), small=False)


@query()
def q38b_matching_rounds(spark, d):
    return graph.maximal_matching(fx.graph_edges(spark, d), small=False)


@query()
def q39b_spanning_tree_rounds(spark, d):
    return graph.minimum_spanning_forest(fx.graph_edges(spark, d), small=False)


@query(f"WITH {EDGES} SELECT count(*) AS n, count(DISTINCT id) AS ids, true AS weighted FROM e")
def q40c_weighted_edges(spark, d):
    """Every edge gets a weight in range."""
    out = graph.weighted_edges(fx.graph_edges(spark, d).drop("w"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.bool_and((F.col("w") >= 0) & (F.col("w") < 1 << 30)).alias("weighted"))


# 2.9 text, space, geometry ------------------------------------------------------------------------------------------


@query()
def q41_suffix_array(spark, d):
    return text.suffix_array(fx.suffix_bytes(spark, d))


_AXIS = "greatest(0, least(31, CAST(floor(({0} + 2) / 0.125) AS BIGINT)))"
_MORTON = " + ".join(f"((({_AXIS.format('x')} >> {i}) & 1) << {2 * i}) + ((({_AXIS.format('y')} >> {i}) & 1) << {2 * i + 1})" for i in range(CELL))


def _cells(spark, d) -> DataFrame:
    return fx.points(spark, d).withColumn("cell", spatial.morton_cell([F.col("x"), F.col("y")], [-2.0, -2.0], 0.125, CELL))


@query(f"WITH {PTS} SELECT id, CAST({_MORTON} AS BIGINT) AS cell FROM p")
def q42_morton_cell(spark, d):
    return _cells(spark, d).select("id", "cell")


@query(f"WITH {PTS}, c AS (SELECT id, CAST({_MORTON} AS BIGINT) AS cell FROM p) SELECT row_number() OVER (ORDER BY cell, id) - 1 AS pos, id, cell FROM c")
def q42b_leaf_order(spark, d):
    return spatial.leaf_order(_cells(spark, d), "cell").select("pos", "id", "cell")


@query(f"WITH {PTS} SELECT id, CAST(-2 + ({_AXIS.format('x')} + 0.5) * 0.125 AS DOUBLE) AS cx, CAST(-2 + ({_AXIS.format('y')} + 0.5) * 0.125 AS DOUBLE) AS cy FROM p")
def q42c_cell_center(spark, d):
    cx, cy = spatial.cell_center(F.col("cell"), 2, [-2.0, -2.0], 0.125, CELL)
    return _cells(spark, d).select("id", cx.alias("cx"), cy.alias("cy"))


def _knn(dims: str) -> str:
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in dims)
    return f"WITH {PTS} SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY {d2}, b.id) AS rank, b.id AS ngh FROM p a JOIN p b ON a.id <> b.id QUALIFY rank <= 3"


@query(_knn("xy"))
def q43_neighbors(spark, d):
    return spatial.nearest_neighbors(fx.points(spark, d), 3).select("id", "rank", "ngh")


@query(_knn("xyz"))
def q44_neighbors_3d(spark, d):
    return spatial.nearest_neighbors(fx.points(spark, d, 3), 3, ("x", "y", "z")).select("id", "rank", "ngh")


@query(
    f"WITH {GRID}, h AS (SELECT id, 0 AS side, a AS u, b AS v FROM gt UNION ALL SELECT id, 1, b, c FROM gt UNION ALL SELECT id, 2, c, a FROM gt)"
    " SELECT h.id, CAST(h.side AS BIGINT) AS side, h.u, h.v, o.id AS neighbor FROM h LEFT JOIN h o ON o.u = h.v AND o.v = h.u"
)
def q45_mesh_topology(spark, d):
    return geometry.mesh_topology(fx.grid_tris(spark))


@query(
    f"WITH {PTS}, s AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id WHERE NOT EXISTS"
    " (SELECT 1 FROM p c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0)) SELECT a, b FROM s"
)
def q46_convex_hull(spark, d):
    h = geometry.convex_hull(fx.points(spark, d))
    size = h.agg(F.count(F.lit(1)).alias("n"))
    after = h.select(F.col("pos").alias("q"), F.col("id").alias("b"))
    both = h.join(F.broadcast(size)).withColumn("q", (F.col("pos") + 1) % F.col("n")).join(after, "q")  # one row of size
    return both.select(F.col("id").alias("a"), "b")


@query(
    f"WITH {GRID}, r AS (SELECT CAST(i * 8 + j AS BIGINT) AS id, i + 0.3::DOUBLE AS ox, j + 0.6::DOUBLE AS oy, 10.0::DOUBLE AS oz, 0.01::DOUBLE AS dx, 0.02::DOUBLE AS dy, -1.0::DOUBLE AS dz FROM range(8) x(i), range(8) y(j)),"
    " t AS (SELECT gt.id AS tri, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ex, b.y - a.y AS ey, b.z - a.z AS ez, c.x - a.x AS fx, c.y - a.y AS fy, c.z - a.z AS fz"
    " FROM gt JOIN gp a ON a.id = gt.a JOIN gp b ON b.id = gt.b JOIN gp c ON c.id = gt.c),"
    " m AS (SELECT r.*, t.*, dy * fz - dz * fy AS px, dz * fx - dx * fz AS py, dx * fy - dy * fx AS pz, ox - ax AS sx, oy - ay AS sy, oz - az AS sz FROM r, t),"
    " n AS (SELECT *, ex * px + ey * py + ez * pz AS det, sy * ez - sz * ey AS qx, sz * ex - sx * ez AS qy, sx * ey - sy * ex AS qz FROM m),"
    " h AS (SELECT id, tri, (fx * qx + fy * qy + fz * qz) / det AS tt FROM n WHERE det <> 0 AND (sx * px + sy * py + sz * pz) / det >= 0"
    " AND (dx * qx + dy * qy + dz * qz) / det >= 0 AND (sx * px + sy * py + sz * pz + dx * qx + dy * qy + dz * qz) / det <= 1 AND (fx * qx + fy * qy + fz * qz) / det > 0),"
    " f AS (SELECT id, tri FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY tt, tri) = 1) SELECT r.id, coalesce(f.tri, -1) AS tri FROM r LEFT JOIN f USING (id)"
)
def q47_ray_cast(spark, d):
    return geometry.ray_cast(fx.grid_points(spark), fx.grid_tris(spark), fx.grid_rays(spark))


@query(
    f"WITH {PTS}, c AS (SELECT CAST({_MORTON} AS BIGINT) AS cell FROM p) SELECT CAST(l AS INTEGER) AS level, cell >> CAST((5 - l) * 2 AS BIGINT) AS cell, count(*) AS n FROM c, range(6) t(l) GROUP BY ALL"
)
def q48_quadtree(spark, d):
    return aggregate.quadtree_rollup(_cells(spark, d), "cell", CELL)


@query(
    "WITH RECURSIVE k AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, CAST(p_size AS BIGINT) AS w, CAST(floor(p_retailprice) AS BIGINT) AS v FROM part ),"
    " r AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(range(121), lambda x: CAST(0 AS BIGINT)) AS dp UNION ALL"
    " SELECT k.i, list_transform(range(121), lambda c: greatest(dp[c + 1], CASE WHEN c >= k.w THEN dp[c - k.w + 1] + k.v ELSE 0 END)) FROM r JOIN k ON k.i = r.i + 1)"
    " SELECT dp[121] AS best FROM r ORDER BY i DESC LIMIT 1"
)
def q49_knapsack(spark, d):
    return geometry.knapsack(fx.knap_items(spark, d), 120)


@query(
    "WITH k AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS weight, CAST(floor(p_retailprice) AS BIGINT) AS value FROM part )"
    " SELECT id, row_number() OVER (ORDER BY CAST(value AS DOUBLE) / weight DESC, id) - 1 AS pos FROM k"
)
def q49b_density_order(spark, d):
    return geometry.density_order(fx.knap_items(spark, d)).select("id", "pos")


def _quads(spark, d) -> DataFrame:
    """Each point with the three that follow it in id order, by ids."""
    p = fx.points(spark, d)
    out = p.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    for k, n in enumerate("bcp", 1):
        out = out.join(p.select((F.col("id") - k).alias("id"), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")), "id")
    return out


_QUADS = f"{PTS}, q AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, d.x AS px, d.y AS py FROM p a JOIN p b ON b.id = a.id + 1 JOIN p c ON c.id = a.id + 2 JOIN p d ON d.id = a.id + 3)"


@query(
    f"WITH {_QUADS}, t AS (SELECT id, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS area, ax - px AS ux, ay - py AS uy, bx - px AS vx, by_ - py AS vy, cx - px AS wx, cy - py AS wy FROM q)"
    " SELECT id, round(area, 6) AS area, area > 0 AS ccw, (uy * (vx * vx + vy * vy) - (ux * ux + uy * uy) * vy) * wx + ((ux * ux + uy * uy) * vx - ux * (vx * vx + vy * vy)) * wy + (ux * vy - uy * vx) * (wx * wx + wy * wy) > 0 AS inside FROM t"
)
def q50_orientation(spark, d):
    a, b, c, p = (g.vec(n) for n in "abcp")
    return _quads(spark, d).select("id", F.round(g.triangle_area(a, b, c), 6).alias("area"), g.counter_clockwise(a, b, c).alias("ccw"), g.in_circle(a, b, c, p).alias("inside"))


@query(
    f"WITH {_QUADS}, t AS (SELECT id, ax, ay, bx - ax AS ux, by_ - ay AS uy, cx - ax AS vx, cy - ay AS vy FROM q),"
    " s AS (SELECT *, 2 * (ux * vy - uy * vx) AS d, ux * ux + uy * uy AS uu, vx * vx + vy * vy AS vv FROM t)"
    " SELECT id, round(degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(uu) * sqrt(vv)))))), 4) AS angle, (ux * vx + uy * vy) < 0 AS obtuse,"
    " round(ax + (vy * uu - uy * vv) / d, 3) + 0 AS ccx, round(ay + (ux * vv - vx * uu) / d, 3) + 0 AS ccy FROM s WHERE abs(d) > 0.01"
)
def q51_angles(spark, d):
    a, b, c = (g.vec(n) for n in "abc")
    x, y = g.circumcenter(a, b, c)
    rows = _quads(spark, d).where(F.abs(g.triangle_area(a, b, c) * 2) > 0.01)
    return rows.select("id", F.round(g.angle(a, b, c), 4).alias("angle"), g.obtuse_at(a, b, c).alias("obtuse"), (F.round(x, 3) + 0.0).alias("ccx"), (F.round(y, 3) + 0.0).alias("ccy"))


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_partkey <= 1 THEN 0 ELSE length(bin(p_partkey - 1)) END AS BIGINT) AS up, (p_partkey >> 3) & 15 AS field FROM part")
def q51b_bits(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), bits.log2_up(k).alias("up"), bits.bit_field(k, 3, 4).alias("field"))


@query(
    f"WITH {PTS} SELECT id, CAST((x >= 0) AS BIGINT) + 2 * CAST((y >= 0) AS BIGINT) + 4 * CAST((z >= 0) AS BIGINT) AS octant, round(sqrt(x * x + y * y + z * z), 6) AS len, greatest(x, y, z) AS top, abs(x) > 1 OR abs(y) > 1 OR abs(z) > 1 AS outside FROM p"
)
def q51c_vectors(spark, d):
    p, zero = g.vec("", "xyz"), (F.lit(0.0),) * 3
    return fx.points(spark, d, 3).select("id", g.quadrant(p, zero).alias("octant"), F.round(g.length(p), 6).alias("len"), g.max_dim(p).alias("top"), g.out_of_box(p, zero, 1.0).alias("outside"))


@query(
    f"WITH {PTS}, n AS (SELECT count(*) AS n FROM p), s AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id WHERE NOT EXISTS"
    " (SELECT 1 FROM p c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0))"
    " SELECT 2 * n - 2 - (SELECT count(*) FROM s) AS triangles, n AS corners, CAST(0 AS BIGINT) AS violations FROM n"
)
def q52_delaunay(spark, d):
    """Counts of the triangulation, and corners of neighbours inside a triangle's circle (none: it is Delaunay)."""
    p = fx.points(spark, d)
    t = geometry.delaunay(p)
    top = geometry.mesh_topology(t).where("neighbor IS NOT NULL").select("id", F.col("neighbor").alias("n"), "u", "v")
    far = t.select(F.col("id").alias("n"), F.explode(F.array("a", "b", "c")).alias("p"))
    rows = top.join(far, "n").where("p <> u AND p <> v").select("id", "p").join(t, "id")
    for k in "abcp":
        rows = rows.join(p.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")), k)
    a, b, c, q = (g.vec(k) for k in "abcp")
    bad = rows.agg(F.count_if(g.in_circle_det(a, b, c, q) > 1e-9).alias("violations"))
    counts = t.agg(F.count(F.lit(1)).alias("triangles"), F.count_distinct(F.col("id") * 0).alias("one"))
    corners = t.select(F.explode(F.array("a", "b", "c")).alias("k")).agg(F.count_distinct("k").alias("corners"))
    return counts.join(corners).join(bad).select("triangles", "corners", "violations")  # one row each


@query("SELECT CAST(18 AS BIGINT) AS triangles, CAST(20 AS BIGINT) AS corners")
def q52b_delaunay_flat(spark, d):
    """Twenty points of an almost flat arc: all are corners of the hull, so 20 - 2 triangles."""
    x = F.col("id").cast("double")
    t = geometry.delaunay(spark.range(20).select("id", x.alias("x"), (x * x * 1e-12).alias("y")))
    return t.select(F.explode(F.array("a", "b", "c")).alias("k")).agg((F.count("k") / 3).cast("bigint").alias("triangles"), F.count_distinct("k").alias("corners"))


@query(f"WITH {PTS} SELECT CAST(0 AS BIGINT) AS thin, true AS covers")
def q53_refine(spark, d):
    """Triangles of the refined mesh with an angle below the bound, and whether the mesh covers its square."""
    p = fx.points(spark, d)
    t = geometry.refine(p)
    a, b, c = (g.vec(k) for k in "abc")
    box = p.agg((F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) * 1.5).alias("side"))
    out = t.agg(F.count_if(g.min_angle_below(a, b, c, 29.999)).alias("thin"), (F.sum(g.triangle_area(a, b, c)) / 2).alias("area"))
    return out.join(box).select("thin", (F.abs(F.col("area") / (F.col("side") * F.col("side")) - 1) < 1e-6).alias("covers"))  # one row each


# generators ---------------------------------------------------------------------------------------------------------


@query("SELECT i AS idx, i % 1024 AS val FROM range(10000) t(i)")
def q54_generator(spark, d):
    return generators.sequence(spark, 10_000, "modular")


@query(
    "WITH a AS (SELECT i AS a, i // 100 AS x, (i // 10) % 10 AS y, i % 10 AS z FROM range(1000) t(i)), b AS (SELECT a, 0 AS k, x * 100 + y * 10 + (z + 1) % 10 AS b FROM a UNION ALL SELECT a, 1, x * 100 + ((y + 1) % 10) * 10 + z FROM a"
    " UNION ALL SELECT a, 2, ((x + 1) % 10) * 100 + y * 10 + z FROM a) SELECT a * 3 + k AS id, least(a, b) AS u, greatest(a, b) AS v FROM b"
)
def q55_cube_grid(spark, d):
    return generators.cube_grid(spark, 10)

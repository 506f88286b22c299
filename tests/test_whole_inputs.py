"""Queries over whole tables against sequential Python on the smallest fixture."""

from __future__ import annotations

import math

import pytest

from weftline.operators import graph, text
from weftline.queries import QUERIES
from weftline.session import table
from weftline.sources import fixtures as fx


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def edges(spark, sf):
    """``(id, u, v, w)`` of the part graph of all orders."""
    lines = {}
    for r in table(spark, sf, "lineitem").collect():
        lines.setdefault((r.l_orderkey, r.l_linenumber), []).append(r.l_partkey)
    near = {tuple(sorted((a, b))) for (o, n), x in lines.items() for a in x for b in lines.get((o, n + 1), ()) if a != b}
    return [(i, u, v, (u * 7919 + v * 104729) % 1000003) for i, (u, v) in enumerate(sorted(near))]


@pytest.fixture(scope="module")
def parts(spark, sf):
    return sorted(r.p_partkey for r in table(spark, sf, "part").collect())


def forest(order):
    group, out = {}, []
    for i, u, v, _ in order:
        a, b = group.setdefault(u, {u}), group.setdefault(v, {v})
        if a is not b:
            out.append((i,))
            a |= b
            for x in b:
                group[x] = a
    return sorted(out)


def levels(edges):
    near, start = {}, min(u for _, u, _, _ in edges)
    for _, u, v, _ in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    level, front = {start: 0}, [start]
    for s in front:
        for d in near[s]:
            if d not in level:
                level[d] = level[s] + 1
                front.append(d)
    return level


def chosen(edges, parts):
    near, out = {}, set()
    for _, u, v, _ in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    for v in parts:
        if not near.get(v, set()) & out:
            out.add(v)
    return sorted((v,) for v in out)


def matched(edges):
    taken, out = set(), []
    for i, u, v, _ in edges:
        if not {u, v} & taken:
            taken |= {u, v}
            out.append((i,))
    return out


def lowest(edges, parts):
    group = {v: {v} for v in parts}
    for _, u, v, _ in edges:
        if group[u] is not group[v]:
            group[u] |= group[v]
            for x in group[v]:
                group[x] = group[u]
    return sorted((v, min(group[v])) for v in parts)


def test_graph_is_of_all_orders(spark, sf, edges):
    assert rows(fx.graph_edges(spark, sf), "id", "u", "v", "w") == edges
    assert rows(QUERIES["q40b_edge_list"](spark, sf), "id", "u", "v") == [e[:3] for e in edges]


def test_bfs_on_the_whole_graph(spark, sf, edges):
    want = levels(edges)
    assert rows(QUERIES["q34_bfs"](spark, sf), "v", "level") == sorted(want.items())
    assert rows(QUERIES["q34b_bfs_summary"](spark, sf), "visited", "rounds") == [(len(want), max(want.values()) + 1)]
    assert rows(QUERIES["q35_reachable"](spark, sf), "v") == sorted((v,) for v in want)


def test_graph_queries_on_the_whole_graph(spark, sf, edges, parts):
    assert rows(QUERIES["q36_components"](spark, sf), "v", "comp") == lowest(edges, parts)
    assert rows(QUERIES["q37_independent_set"](spark, sf), "v") == chosen(edges, parts)
    assert rows(QUERIES["q38_matching"](spark, sf), "id") == matched(edges)
    assert rows(QUERIES["q39_spanning_tree"](spark, sf), "id") == forest(sorted(edges, key=lambda e: (e[3], e[0])))
    assert rows(QUERIES["q40_spanning_forest"](spark, sf), "id") == forest(edges)


def test_rounds_on_the_whole_graph(spark, sf, edges, parts):
    assert rows(QUERIES["q37b_independent_set_rounds"](spark, sf), "v") == chosen(edges, parts)
    assert rows(QUERIES["q38b_matching_rounds"](spark, sf), "id") == matched(edges)
    assert rows(QUERIES["q39b_spanning_tree_rounds"](spark, sf), "id") == forest(sorted(edges, key=lambda e: (e[3], e[0])))


def test_bfs_rounds_on_the_whole_graph(spark, edges):
    e = spark.createDataFrame(edges, "id bigint, u bigint, v bigint, w bigint").coalesce(1)
    assert rows(graph.bfs(graph.both_ways(e), min(u for _, u, _, _ in edges), small=False), "v", "level") == sorted(levels(edges).items())


def test_knapsack_and_density_of_all_parts(spark, sf):
    items = [(r.p_partkey, int(r.p_size), math.floor(r.p_retailprice)) for r in table(spark, sf, "part").collect()]
    best = {0: 0}
    for _, w, v in items:
        for c, total in list(best.items()):
            if c + w <= 120 and total + v > best.get(c + w, 0):
                best[c + w] = total + v
    assert QUERIES["q49_knapsack"](spark, sf).first().best == max(best.values())
    order = sorted(items, key=lambda x: (-x[2] / x[1], x[0]))
    assert rows(QUERIES["q49b_density_order"](spark, sf), "pos", "id") == [(i, x[0]) for i, x in enumerate(order)]


def test_suffix_array_of_all_texts(spark, tmp_path):
    texts = [(3, "naïve Größe"), (1, "banana" * 20), (2, ""), (5, None), (4, "日本 banana"), (0, "x")]
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    whole = "".join(t for _, t in sorted(texts, key=lambda r: r[0]) if t).encode()
    want = list(enumerate(sorted(range(len(whole)), key=lambda i: whole[i:])))
    assert rows(QUERIES["q41_suffix_array"](spark, str(tmp_path)), "pos", "idx") == want
    assert rows(text.suffix_array(fx.suffix_bytes(spark, str(tmp_path)), small=False), "pos", "idx") == want

"""Closures, tops, trees and sums of any depth: a chain of 200 levels, rings, several ways, unknown parents."""

import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import defaults, documents, graph

CHAIN = [(i, i - 1 if i else None) for i in range(201)]
RING = [(1000 + i, 1000 + (i + 1) % 5) for i in range(5)] + [(1010, 1003), (1011, 1010)]
LOST = [(2000, 9999), (2001, 2000)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(CHAIN + RING + LOST, "id int, parent_id int").repartition(3)


def ways(edges):
    """Shortest ways by search from every node."""
    near = {}
    for s, d, w in edges:
        near.setdefault(s, []).append((d, w))
    out = {}
    for start in near:
        best, todo = {start: 0}, [start]
        while todo:
            at = todo.pop(0)
            for d, w in near.get(at, []):
                if best[at] + w < best.get(d, 1 << 30):
                    best[d] = best[at] + w
                    todo.append(d)
        out |= {(start, d): n for d, n in best.items() if d != start}
    return out


def test_closure(spark):
    edges = [(1, 2, 1), (2, 3, 1), (1, 3, 5), (3, 4, 0), (4, 1, 1), (5, 5, 1), (4, 6, 2), (1, 6, 9), (7, 8, 1), (7, 8, 3)]
    df = spark.createDataFrame(edges, "src int, dst int, weight int")
    assert {(r.src, r.dst): r.distance for r in graph.closure(df).collect()} == ways(edges)
    assert {(r.src, r.dst): r.distance for r in graph.closure(df.drop("weight")).collect()} == ways([(s, d, 1) for s, d, _ in edges if s != d])
    assert graph.closure(df.limit(0)).count() == 0


def test_ancestry_and_sums(spark, nodes):
    got = {(r.id, r.ancestor): r.distance for r in graph.ancestry(nodes).collect()}
    rows = CHAIN + RING + LOST
    assert got == ways([(i, p, 1) for i, p in rows if p is not None]) | {(i, i): 0 for i, _ in rows}
    short = {(r.id, r.ancestor) for r in graph.ancestry(nodes, 3).collect()}
    assert short == {k for k, d in got.items() if d <= 3}
    values = spark.createDataFrame([(i, i) for i, _ in rows] + [(5, 1000), (None, 7)], "id int, value int")
    sums = {r.id: (r.total, r.members) for r in graph.subtree_sums(nodes, values).collect()}
    own = {i: i for i, _ in rows}
    own[5] += 1000
    below = {}
    for i, a in got:
        below.setdefault(a, []).append(i)
    assert sums == {a: (sum(own[i] for i in ids), len(ids)) for a, ids in below.items()}


def test_tops(nodes):
    assert {(r.id, r.top) for r in graph.tops(nodes).collect()} == {(i, 0) for i, _ in CHAIN}


def test_trees_of_any_depth(spark, nodes):
    named = nodes.withColumns({"name": F.concat(F.lit('n"'), "id"), "debt": F.when(F.col("id") % 2 == 1, F.col("id"))})
    got = documents.tree_documents(named, ["name"], sums=("debt",)).collect()
    assert [r.id for r in got] == [0]
    at, seen = json.loads(got[0].document), 0
    while True:
        assert (at["id"], at["name"], at["subtree_debt"]) == (seen, f'n"{seen}', sum(i for i in range(seen, 201) if i % 2))
        if not at["children"]:
            break
        (at,) = at["children"]
        seen += 1
    assert seen == 200
    wide = spark.createDataFrame([("r", None, 1), *[(f"k{i:02}", "r", i) for i in range(30)], ("x", "k07", 5)], "id string, parent_id string, v long")
    tree = json.loads(documents.tree_documents(wide, [], sums=("v",)).first().document)
    assert [k["id"] for k in tree["children"]] == [f"k{i:02}" for i in range(30)]
    assert (tree["subtree_v"], tree["children"][7]["subtree_v"]) == (1 + sum(range(30)) + 5, 12)


def test_a_wide_tree_is_nested_in_little_memory(monkeypatch):
    n = 60_000
    ids = pa.array([f"n{i}" for i in range(n)])
    parents = pa.array([None] + [f"n{(i - 1) // 9}" for i in range(1, n)])
    bodies = pa.array([f'{{"id":"n{i}"}}' for i in range(n)])
    own = np.array([[2**61]] * n, object)
    tracemalloc.start()
    monkeypatch.setattr(documents, "PIECE", 1000)
    text = documents.nested(ids, parents, bodies, own[:, :0].astype("int64"), (), None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 * n
    monkeypatch.setattr(documents, "PIECE", 7)
    tree = json.loads(documents.nested(ids, parents, bodies, own, ("v",), None))
    todo, seen = [tree], 0
    assert tree["subtree_v"] == n * 2**61
    while todo:
        at, seen = todo.pop(), seen + 1
        below = sorted(f"n{k}" for k in range(9 * int(at["id"][1:]) + 1, 9 * int(at["id"][1:]) + 10) if k < n)
        assert [k["id"] for k in at["children"]] == below
        todo += at["children"]
    assert seen == n == text.count('"children"')


def test_defaults_spread(spark):
    debt = spark.createDataFrame([(1, 1, 10, True), (2, 1, 50, True), (3, 1, 5, True), (4, 1, 99, False), (5, 2, 70, True), (6, 1, None, True), (7, None, 80, True)], "id int, company_id int, outstanding long, is_active boolean")
    columns = "source_id int, target_id int, relationship string, threshold long, is_bilateral boolean"
    links = spark.createDataFrame([
        (1, None, "cross_default", 20, False), (3, 1, "cross_acceleration", None, True), (5, 2, "pari_passu", None, True), (2, 4, "cross_default", None, False),
        (6, 3, "cross_default", None, None), (6, 3, "cross_default", None, None), (7, None, "cross_default", None, False), (9, 1, "cross_default", None, False),
    ], columns)
    assert {(r.id, r.reached, r.steps) for r in defaults.default_reach(links, debt).collect()} == {(2, 1, 1), (2, 3, 2), (2, 6, 3), (1, 3, 1), (1, 6, 2), (3, 1, 1), (3, 6, 1)}
    assert {r.id: (r.n, r.amount, r.steps) for r in defaults.default_exposure(links, debt).collect()} == {1: (2, 5, 2), 2: (3, 15, 3), 3: (2, 10, 1), 5: (0, 0, 0), 6: (0, 0, 0), 7: (0, 0, 0)}
    assert defaults.default_reach(links.limit(0), debt).count() == 0


def test_only_linked_or_large_companies_take_the_closure(spark, monkeypatch):
    debt = spark.createDataFrame([(i, i // 10, 10 * i, i % 9 != 4) for i in range(60)] + [(99, None, 5, True)], "id int, company_id int, outstanding long, is_active boolean")
    columns = "source_id int, target_id int, relationship string, threshold long, is_bilateral boolean"
    near = [(i, i + 1 if i % 10 < 9 and i % 3 else None, "cross_default", 200 if i % 2 else None, i % 5 == 0) for i in range(60)]
    links = spark.createDataFrame([*near, (15, 27, "cross_acceleration", None, False), (99, 32, "cross_default", None, False)], columns)
    taken, closure = [], graph.closure

    def seen(edges):
        taken.append({r.src for r in edges.collect()} | {r.dst for r in edges.collect()})
        return closure(edges)

    monkeypatch.setattr(defaults, "closure", seen)
    got = {(r.id, r.reached): r.steps for r in defaults.default_reach(links, debt).collect()}
    assert {int(n[2:]) // 10 for n in taken[0] if n.startswith("i:")} == {1, 2, 3, 9}  # those of the two links between companies
    monkeypatch.setattr(defaults, "ROW", 0)
    assert got == {(r.id, r.reached): r.steps for r in defaults.default_reach(links, debt).collect()}
    edges = [(r.src, r.dst, r.weight) for r in defaults.default_edges(links, debt).collect()]
    assert got == {(int(a[2:]), int(b[2:])): n for (a, b), n in ways(edges).items() if a[0] == b[0] == "i"}

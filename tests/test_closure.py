"""Closure by shortcuts and condensation against a search from every start."""

import math
import random

import pytest

from plumbline.operators import closure, graph


def searched(starts, edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for node, item in starts:
        todo, met = [node], set()
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in met:
                    met.add(b)
                    todo.append(b)
        found |= {(b, item) for b in met}
    return found


def run(spark, starts, edges):
    df, rounds = closure.closure(spark.createDataFrame(starts, "node long, item string"), spark.createDataFrame(edges, "a long, b long"))
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows), rounds


def cases():
    rng = random.Random(9)
    sparse = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    dense = [(rng.randrange(12), rng.randrange(12)) for _ in range(70)]
    cycles = [(10 * c + i, 10 * c + (i + 1) % n) for c, n in enumerate((2, 3, 4, 5, 7, 8)) for i in range(n)] + [(0, 10), (12, 20), (21, 30), (33, 40), (44, 50)]
    hub = [(i, 500) for i in range(100)] + [(500, 600 + i) for i in range(100)] + [(600, 700)] + [(700 + i, 701 + i) for i in range(30)]
    return {"sparse": sparse, "dense": dense, "cycles": cycles, "hub": hub, "loops": [(1, 1), (1, 2), (2, 2)], "none": []}


@pytest.mark.parametrize("name", cases())
def test_same_as_search(spark, name):
    edges = cases()[name]
    nodes = sorted({n for e in edges for n in e})
    starts = [(n, f"i{k % 4}") for k, n in enumerate(nodes[:: max(1, len(nodes) // 8)])] + [(10**6, "off")]
    got, _ = run(spark, starts, edges)
    assert got == searched(starts, edges)


def test_long_chain_and_cycle(spark):
    """A thousand nodes in a row that end in a cycle of 64: some ten rounds, not a thousand."""
    chain = [(i, i + 1) for i in range(1000)]
    ring = [(1000 + i, 1000 + (i + 1) % 64) for i in range(64)]
    got, rounds = run(spark, [(0, "f"), (1000, "g")], chain + ring)
    assert got == {(i, "f") for i in range(1, 1064)} | {(1000 + i, "g") for i in range(64)}
    assert rounds <= math.log2(1064) + 3


def test_shortcuts_are_bounded(spark):
    """A node of a hundred ways in and a hundred out makes no ten thousand shortcuts."""
    edges = spark.createDataFrame(cases()["hub"], "a long, b long")
    assert closure.shortcuts(edges).count() <= closure.WIDE * edges.count()
    assert closure.shortcuts(edges).filter("a < 100 and b >= 600 and b < 700").count() == 0


def test_column_lineage_deeper_than_the_plain_rounds(spark):
    """A chain of columns through two tables in turn, with a cycle at its end, and one that leaves the footprint."""
    m, f, a, b, out = "urn:li:mlModel:m", "urn:li:mlFeature:f", "urn:li:dataset:a", "urn:li:dataset:b", "urn:li:dataset:c"
    found = spark.createDataFrame([(m, a), (m, b), ("other", a)], "model_urn string, urn string")
    sources = spark.createDataFrame([(m, a, [f])], "model_urn string, urn string, feeds_features array<string>")
    columns = spark.createDataFrame([(m, a, "c0")], "model_urn string, urn string, path string")
    at = lambda i: ((a, b)[i % 2], f"c{i}")
    rows = [(*at(i), *at(i + 1)) for i in range(40)] + [(*at(40), *at(36)), (*at(20), out, "x"), (out, "x", a, "never")]
    edges = spark.createDataFrame(rows, "down_urn string, down_col string, up_urn string, up_col string")
    got = {(r["model_urn"], r["urn"], r["path"]): r["features"] for r in graph.column_features(found, sources, columns, edges).collect()}
    assert got == {(m, *at(i)): [f] for i in range(1, 41)}

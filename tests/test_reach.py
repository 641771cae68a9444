"""Bitmap walks against a walk of each seed by itself."""

import random

import pytest

from plumbline.functions.kinds import TRAVERSABLE
from plumbline.operators import graph, reach

EDGE = "src string, dst string, relationship string, seq int"


def name(kind, i):
    return f"urn:li:{kind}:(urn:li:dataPlatform:x,{i},PROD)"


def kind_of(urn):
    return urn.split(":")[2]


def alone(seed, edges, cap):
    """{node: path} by levels, of several ways the one whose seqs, then names, come first."""
    down = {}
    for src, dst, _, seq in edges:
        down.setdefault(dst, []).append((seq, src))
    found, level = {seed: ((), (seed,))}, {seed: ((), (seed,))}
    for depth in range(cap):
        after = {}
        for node, (place, path) in level.items():
            if depth and kind_of(node) not in TRAVERSABLE:
                continue
            for seq, to in down.get(node, []):
                way = ((*place, seq), (*path, to))
                if to not in found and way < after.get(to, (((1 << 60),),)):
                    after[to] = way
        found |= after
        level = after
    return {n: list(path) for n, (_, path) in found.items() if kind_of(n) == "mlModel" and n != seed}


def random_graph(rng):
    nodes = [name("mlModel", i) for i in range(6)] + [name("mlFeature", i) for i in range(8)] + [name("dataset", i) for i in range(30)] + [name("dashboard", i) for i in range(3)]
    return nodes, [(rng.choice(nodes), rng.choice(nodes), "R", rng.randrange(4)) for _ in range(120)]


@pytest.mark.parametrize("block, cap", [(1 << 15, 6), (8, 3), (16, 1)])
def test_same_as_alone(spark, monkeypatch, block, cap):
    monkeypatch.setattr(reach, "SEEDS", block)
    nodes, edges = random_graph(random.Random(cap))
    seeds = [n for n in nodes if kind_of(n) != "mlFeature"] + [name("dataset", "nowhere")]
    df = spark.createDataFrame([(s,) for s in [*seeds, seeds[0], None]], "seed string").repartition(3)
    table = spark.createDataFrame(edges, EDGE)
    want = sorted((s, m, len(p) - 1, p) for s in seeds for m, p in alone(s, edges, cap).items())
    assert want
    assert sorted(tuple(r) for r in graph.downstream_models(df, table, cap).collect()) == want
    assert sorted(tuple(r) for r in graph.downstream_models(df, table, cap, paths=False).collect()) == [w[:3] for w in want]


def test_levels_have_a_row_per_node_and_block(spark, monkeypatch):
    """A hundred seeds on one table are a row of the level, not a hundred; a hot node's fan-in meets in one bitmap."""
    seeds = [name("dataset", f"s{i:03}") for i in range(100)]
    hot, m = name("dataset", "hot"), name("mlModel", "m")
    edges = [(hot, s, "R", i) for i, s in enumerate(seeds)] + [(m, hot, "R", 0)] + [(s, hot, "R", 1) for s in seeds]
    monkeypatch.setattr(reach, "SEEDS", 64)
    table = spark.createDataFrame([(b, a, a.split(":")[2]) for a, b, _, _ in edges], "`from` string, `to` string, to_type string")
    known = reach.numbered(spark.createDataFrame([(s,) for s in seeds], "seed string"))
    assert sorted((r["block"], r["bit"]) for r in known.collect()) == [(i // 64, i % 64) for i in range(100)]
    levels = reach.levels_of(known, table, 5)
    assert levels[0].count() == 2
    assert all(x.count() <= 2 * 102 for x in levels)
    assert {len(r["bits"]) for x in levels for r in x.collect()} == {8}
    found = graph.downstream_models(spark.createDataFrame([(s,) for s in seeds], "seed string"), spark.createDataFrame(edges, EDGE))
    assert sorted((r["seed"], r["path"]) for r in found.collect()) == [(s, [s, hot, m]) for s in seeds]


def test_nothing_to_walk(spark):
    edges = spark.createDataFrame([(name("mlModel", 1), name("dataset", 1), "R", 0)], EDGE)
    none = spark.createDataFrame([], "seed string")
    some = spark.createDataFrame([(name("dataset", 1),)], "seed string")
    for paths in (True, False):
        assert graph.downstream_models(none, edges, 6, paths).count() == 0
        assert graph.downstream_models(some, edges, 0, paths).count() == 0
        assert graph.downstream_models(some, edges.limit(0), 6, paths).count() == 0
    assert graph.downstream_models(some, edges).first()["path"] == [name("dataset", 1), name("mlModel", 1)]


def test_few_models_are_walked_from(spark, monkeypatch):
    """Many seeds and one model: levels have a row a node at most, not one for each seed that comes by."""
    rows, m = [], name("mlModel", "m")
    tables = [name("dataset", i) for i in range(40)]
    edges = [(b, a, "R", 0) for a, b in zip(tables, tables[1:])] + [(m, tables[-1], "R", 0)]
    counted = lambda df, label: (rows.append(df.count()), cut(df, label))[1]
    cut = reach.cut
    monkeypatch.setattr(reach, "cut", lambda df, label: counted(df, label) if label == "level" else cut(df, label))
    found = graph.downstream_models(spark.createDataFrame([(t,) for t in tables], "seed string"), spark.createDataFrame(edges, EDGE), 6)
    assert sorted((r["seed"], r["depth"], r["path"]) for r in found.collect()) == sorted((t, 40 - i, [*tables[i:], m]) for i, t in enumerate(tables) if i > 33)
    assert max(rows) <= 7


def test_bitmaps_where_both_ends_are_many(spark, monkeypatch):
    monkeypatch.setattr(reach, "FEW", 0)
    test_same_as_alone(spark, monkeypatch, 16, 4)


def test_few_seeds_are_walked_down(spark, monkeypatch):
    """A few seeds of a large graph meet what is below them, not all that the models come from; their paths read only edges of what they met."""
    urn = lambda kind, i: f"urn:li:{kind}:{i}"
    model, tables, sources = urn("mlModel", 0), [urn("dataset", i) for i in range(60)], [urn("dataset", 100 + i) for i in range(60)]
    edges = [(model, t, "R", i) for i, t in enumerate(tables)] + [(t, s, "R", 0) for t, s in zip(tables, sources, strict=True)] + [(tables[3], sources[4], "R", 1)]
    sizes, written = {}, reach.cut

    def counted(df, label):
        sizes[label] = max(sizes.get(label, 0), df.count())
        return written(df, label)

    monkeypatch.setattr(reach, "cut", counted)
    found = graph.downstream_models(spark.createDataFrame([(sources[4],), (sources[9],)], "seed string"), spark.createDataFrame(edges, EDGE), 6)
    assert {(r["seed"], r["depth"], tuple(r["path"])) for r in found.collect()} == {(sources[4], 2, (sources[4], tables[4], model)), (sources[9], 2, (sources[9], tables[9], model))}
    assert sizes["level"] <= 6 and sizes["met"] == 6 and sizes["edges"] == len(edges)

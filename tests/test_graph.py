"""Walks against a plain queue-based simulation on random graphs."""

import random
from collections import deque

from plumbline.operators import graph

EDGE = "src string, dst string, relationship string, seq int"


def name(kind, i):
    return f"urn:li:{kind}:(urn:li:dataPlatform:x,{i},PROD)"


def random_edges(rng):
    nodes = [name("mlModel", f"m{i}") for i in range(3)] + [name("mlFeature", f"f{i}") for i in range(5)] + [name("dataset", f"d{i}") for i in range(14)] + [name("mlFeatureTable", "t")]
    out = []
    for src in nodes:
        ups = rng.sample(nodes[3:], rng.randrange(0, 4))
        out += [(src, dst, "R", i) for i, dst in enumerate(ups)]
    return nodes, out


def queue_walk(model, edges, cap):
    by = {}
    for s, d, _, i in sorted(edges, key=lambda e: e[3]):
        by.setdefault(s, []).append(d)
    path, todo, cut = {model: [model]}, deque([model]), set()
    keep = lambda n, d: d != n and ":mlFeatureTable:" not in d
    while todo:
        n = todo.popleft()
        if len(path[n]) - 1 >= cap:
            continue
        for d in by.get(n, []):
            if keep(n, d) and d not in path:
                path[d] = [*path[n], d]
                todo.append(d)
    for n, p in path.items():
        if len(p) - 1 == cap and any(keep(n, d) and d not in path for d in by.get(n, [])):
            cut.add(n)
    return path, cut


def test_footprint_is_breadth_first(spark):
    rng = random.Random(2)
    for cap in (1, 3):
        nodes, edges = random_edges(rng)
        models = nodes[:3]
        found = graph.footprint(spark.createDataFrame([(m,) for m in models], "model_urn string"), spark.createDataFrame(edges, EDGE), cap).collect()
        for m in models:
            path, cut = queue_walk(m, edges, cap)
            assert {r["urn"]: [h["urn"] for h in r["chain"]] for r in found if r["model_urn"] == m} == path
            assert {r["urn"] for r in found if r["model_urn"] == m and r["truncated"]} == cut


def test_counters_of_a_walk(spark):
    """Ends of edges fetched and met before, level by level, also where the walk ends by itself or has nothing to walk."""
    m, f, d, e = name("mlModel", "m"), name("mlFeature", "f"), name("dataset", "d"), name("dataset", "e")
    edges = spark.createDataFrame([(m, f, None, 0), (f, d, None, 0), (d, f, None, 0), (d, e, None, 1), (f, e, None, 1), (d, d, None, 2)], EDGE)
    models = spark.createDataFrame([(m,)], "model_urn string")
    for cap, want in ((1, (1, 1, 0)), (2, (2, 3, 0)), (9, (3, 5, 2))):
        counters = graph.Counters()
        assert graph.footprint(models, edges, cap, counters).count() == min(cap + 1, 4) + (cap > 1) - (cap > 2)
        assert tuple(counters.totals().values()) == want
    counters = graph.Counters()
    graph.footprint(models.limit(0), edges, 3, counters)
    assert tuple(counters.totals().values()) == (1, 0, 0)


def test_hops_run_from_the_root(spark):
    m, f, d = name("mlModel", "m"), name("mlFeature", "f"), name("dataset", "d")
    edges = spark.createDataFrame([(m, f, None, 0), (f, d, None, 0), (d, d, None, 1)], EDGE)
    found = graph.hops(graph.footprint(spark.createDataFrame([(m,)], "model_urn string"), edges))
    hops = found.filter(found["urn"] == d).first()["hops"]
    assert [(h["urn"], h["via"]) for h in hops] == [(d, None), (f, "DerivedFrom"), (m, "Consumes")]
    alone = graph.footprint(spark.createDataFrame([("nothing",)], "model_urn string"), edges).collect()
    assert [(r["urn"], r["depth"]) for r in alone] == [("nothing", 0)]


def test_downstream(spark):
    raw, staging, f1, f2, m1, m2, other = name("dataset", "raw"), name("dataset", "staging"), name("mlFeature", "1"), name("mlFeature", "2"), name("mlModel", "1"), name("mlModel", "2"), name("dashboard", "x")
    edges = [(staging, raw, None, 0), (raw, staging, None, 0), (f1, staging, None, 0), (f2, staging, None, 1), (m1, f1, None, 0), (m2, f2, None, 0), (m2, m1, None, 0), (other, raw, None, 5), (m1, other, None, 9)]
    df, seeds = spark.createDataFrame(edges, EDGE), spark.createDataFrame([(raw,)], "seed string")
    got = {r["model_urn"]: r["path"] for r in graph.downstream_models(seeds, df).collect()}
    assert got == {m1: [raw, staging, f1, m1], m2: [raw, staging, f2, m2]}
    assert graph.downstream_models(seeds, df, 2).count() == 0


def test_column_features_reach_up(spark):
    m, f, a, b, c = name("mlModel", "m"), name("mlFeature", "f"), name("dataset", "a"), name("dataset", "b"), name("dataset", "c")
    edges = spark.createDataFrame([(m, f, None, 0), (f, a, None, 0), (a, b, None, 0), (b, a, None, 0)], EDGE)
    found = graph.footprint(spark.createDataFrame([(m,)], "model_urn string"), edges)
    sources = graph.feature_sources(found, edges)
    columns = spark.createDataFrame([(m, a, "x"), (m, a, "y"), (m, b, "z")], "model_urn string, urn string, path string")
    column_edges = spark.createDataFrame([(a, "x", b, "z"), (b, "z", b, "w"), (b, "w", a, "x"), (a, "y", c, "out")], "down_urn string, down_col string, up_urn string, up_col string")
    got = {(r["urn"], r["path"]): r["features"] for r in graph.column_features(found, sources, columns, column_edges).collect()}
    assert got == {(b, "z"): [f], (b, "w"): [f], (a, "x"): [f]}
    assert graph.column_features(found, sources, columns, column_edges.limit(0)).count() == 0


def test_attribution(spark):
    m, f, d = name("mlModel", "m"), name("mlFeature", "f"), name("dataset", "d")
    edges = spark.createDataFrame([(m, f, None, 0), (f, d, None, 0)], EDGE)
    found = graph.footprint(spark.createDataFrame([(m,)], "model_urn string"), edges)
    findings = spark.createDataFrame([(m, d, "c", None), (m, "elsewhere", None, None)], "model_urn string, subject_urn string, subject_column string, affected_feature_urn string")
    owners = spark.createDataFrame([(m, d, ["o"])], "model_urn string, urn string, owners array<string>")
    queries = spark.createDataFrame([(d, "SELECT 1"), ("elsewhere", "SELECT 2")], "urn string, query_sql string")
    got = {r["subject_urn"]: r for r in graph.attribute(findings, found, owners, queries).collect()}
    assert got[d]["affected_feature_urn"] == f and got[d]["hops"][0]["column"] == "c" and got[d]["path_owners"] == ["o"] and got[d]["path_depth"] == 2
    assert got[d]["query_sql"] == "SELECT 1"
    assert got["elsewhere"]["unattributed"] and got["elsewhere"]["root_urn"] is None and got["elsewhere"]["query_sql"] is None


def test_footprint_without_paths(spark):
    """The same assets and depths as with paths, and the same counters, from levels with a row for each node and 64 models."""
    nodes, edges = random_edges(random.Random(5))
    models = [name("mlModel", f"m{i}") for i in range(3)]
    more = [name("mlModel", f"n{i}") for i in range(70)]
    df = spark.createDataFrame([(m,) for m in [*models, *more, models[0]]], "model_urn string")
    table = spark.createDataFrame([*edges, *((m, nodes[i % 20 + 3], "R", 0) for i, m in enumerate(more))], EDGE)
    for cap in (0, 2, 6):
        plain, counted = graph.Counters(), graph.Counters()
        want = {(r["model_urn"], r["urn"], r["entity_type"], r["depth"]) for r in graph.footprint(df, table, cap, plain).collect()}
        got = [tuple(r) for r in graph.footprint(df, table, cap, counted, paths=False).collect()]
        assert len(got) == len(want) and set(got) == want
        assert counted.totals() == plain.totals()
    assert {len(c) for c in [graph.footprint(df, table, 2, paths=False).columns]} == {4}

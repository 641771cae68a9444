"""Queries over whole tables against brute force: no line item and no event is left out."""

from collections import defaultdict

import duckdb
from plumbline.plans import registry, slices

SF = "/root/testdata/sf0.001"


def rows_of(sql):
    return duckdb.sql(sql.replace("{", f"'{SF}/").replace("}", ".parquet'")).fetchall()


def walk(seeds, nexts, cap, stop=()):
    found, level = {}, set(seeds)
    for depth in range(cap + 1):
        level -= found.keys()
        found |= dict.fromkeys(level, depth)
        level = {y for x in level if x[0] not in stop for y in nexts[x]}
    return found


def graph():
    up = defaultdict(set)
    for region, nation in rows_of("SELECT n_regionkey, n_nationkey FROM {nation}"):
        up["M", region].add(("F", nation))
    for nation, supplier in rows_of("SELECT s_nationkey, s_suppkey FROM {supplier}"):
        up["F", nation].add(("S", supplier))
    ((n,),) = rows_of("SELECT count(*) FROM {part}")
    for supplier, part in rows_of("SELECT l_suppkey, l_partkey FROM {lineitem}"):
        up["S", supplier].add(("P", part))
        up["P", part].add(("P", (part * 7 + 3) % n))
    return up


def named(urn):
    name = urn.split(",")[1].rstrip(")")
    return {"r": "M", "s": "S", "p": "P"}.get(name[0], "F"), int(name.replace("_", ".").split(".")[-1])


def test_edges_have_every_line_item(spark):
    got = slices.edges(spark, SF).filter("src like '%,supplier.%'").select("src", "dst").collect()
    assert {(named(a), named(b)) for a, b in got} == {(("S", s), ("P", p)) for s, p in rows_of("SELECT l_suppkey, l_partkey FROM {lineitem}")}


def test_footprint_and_downstream(spark):
    up, down = graph(), defaultdict(set)
    for x, ys in up.items():
        for y in ys:
            down[y].add(x)
    models = [x for x in up if x[0] == "M"]
    want = {(m, x, d) for m in models for x, d in walk([m], up, 5).items()}
    assert {(named(r[0]), named(r[1]), r[2]) for r in registry.QUERIES["upstream_footprint"](spark, SF).collect()} == want
    seeds = {("P", p) for (p,) in rows_of("SELECT l_partkey FROM {lineitem}")}
    want = {(s, x, d) for s in seeds for x, d in walk([s], down, 6, stop="M").items() if x[0] == "M"}
    assert {(named(r[0]), named(r[1]), r[2]) for r in registry.QUERIES["downstream_models"](spark, SF).collect()} == want


def test_calibration(spark):
    runs = defaultdict(set)
    for user, day, kind in rows_of("SELECT user_id, CAST(ts AS DATE), event_type FROM {events}"):
        runs[f"m{user % 20}", day].add(kind)
    total, warned = defaultdict(int), defaultdict(int)
    for (m, _), kinds in runs.items():
        total[m] += 1
        for k in kinds:
            warned[m, k] += 1
    want = {(m, k, n, total[m]) for (m, k), n in warned.items() if total[m] >= 4 and n / total[m] >= 0.5}
    got = registry.QUERIES["calibration"](spark, SF).select("model_urn", "kind", "warn_count", "total_runs")
    assert {tuple(r) for r in got.collect()} == want

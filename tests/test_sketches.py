"""Mergeable profiles against exact ones of the union."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile, sketches

SCHEMA = "day string, n long, x double, t string, when date, gone int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for i in range(6000):
        x = None if i % 10 == 3 else 1e9 + rng.gauss(0, 1) * (1 + i % 7)
        out.append((f"d{i % 5}", i % 1700, x, rng.choice(["", "a", "é" * 3, None]), None, None))
    out += [("late", 2**60 + 1, None, "z", None, None), ("late", 2**60, None, None, None, None), (None, 5, 1.0, "q", None, None)]
    return spark.createDataFrame(out, SCHEMA)


COLUMNS = ["n", "x", "t", "when", "gone"]


def test_merge_of_parts_is_the_profile_of_the_union(spark, rows, tmp_path):
    whole = {r["path"]: r for r in profile.profile(rows, [], COLUMNS).collect()}
    daily = sketches.sketch(rows, ["day"], COLUMNS)
    path = f"file://{tmp_path}/states"
    for day in ("d0", "d1", "d2"):
        sketches.put(daily.filter(daily["day"] == day), path, day)
    sketches.put(daily.filter("day is null or day not in ('d0', 'd1', 'd2')"), path, "rest")
    sketches.put(daily.filter("day = 'd1'"), path, "d1")  # again, without effect
    stored = sketches.stored(spark, path)
    once = {r["path"]: r for r in sketches.finish(sketches.merge(stored, []), []).collect()}
    twice = sketches.merge(sketches.merge(stored, ["day"]), [])
    assert len(once) == len(COLUMNS)
    for got in (once, {r["path"]: r for r in sketches.finish(twice, []).collect()}):
        for c in COLUMNS:
            a, b = got[c], whole[c]
            assert (a["row_count"], a["null_count"], a["min"], a["max"]) == (b["row_count"], b["null_count"], b["min"], b["max"]), c
            assert abs(a["unique_count"] - b["unique_count"]) <= sketches.DISTINCT_ERROR * b["unique_count"]
    values = sorted(r["x"] for r in rows.collect() if r["x"] is not None)
    assert float(once["x"]["mean"]) == pytest.approx(statistics.fmean(values), rel=1e-12)
    assert float(once["x"]["stdev"]) == pytest.approx(statistics.stdev(values), rel=1e-6)
    for share, mark in once["x"]["quantiles"].items():
        rank = sum(v < mark for v in values) / len(values)
        assert abs(rank - share) <= sketches.RANK_ERROR
    assert once["t"]["quantiles"] is None and once["t"]["mean"] is None
    assert once["gone"]["unique_count"] == 0 and once["gone"]["min"] is None and once["gone"]["quantiles"] is None


def test_deviation_of_far_means(spark):
    """Parts far from each other: the common deviation is that of all values."""
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1e6), ("c", float("nan")), ("c", float("inf")), ("c", None)], "day string, v double")
    got = sketches.finish(sketches.merge(sketches.sketch(df, ["day"], ["v"]), []), []).first()
    assert float(got["stdev"]) == pytest.approx(statistics.stdev([1.0, 3.0, 1e6]))
    assert (got["row_count"], got["null_count"]) == (6, 1)


def test_nothing(spark):
    df = spark.createDataFrame([], "day string, v double")
    states = sketches.sketch(df, ["day"], ["v"])
    assert states.count() == 0 and sketches.finish(sketches.merge(states, []), []).count() == 0


def test_whole_numbers_below_zero(spark):
    """Extremes that doubles cannot tell apart are told apart as numbers, not as texts."""
    df = spark.createDataFrame([(-(2**60) - 1,), (-(2**60),)], "n long")
    got = sketches.finish(sketches.merge(sketches.sketch(df, [], ["n"]), []), []).first()
    assert (got["min"], got["max"]) == (str(-(2**60) - 1), str(-(2**60)))


def test_rows_of_the_query_are_not_multiplied(spark, tmp_path):
    """A column of nulls has its row, and no step makes a row for each column of a row."""
    import duckdb

    from plumbline.plans import registry

    for t in ("orders", "lineitem"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        lost = {"orders": "o_totalprice", "lineitem": "l_linenumber"}[t]
        table.withColumn(lost, F.lit(None).cast(table.schema[lost].dataType)).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    df = registry.profile_merged(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    wanted = con.sql(registry.ORACLES["profile_merged"])
    assert sorted(map(repr, (tuple(r[c] for c in wanted.columns) for r in df.collect()))) == sorted(map(repr, wanted.fetchall()))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "explode" not in plan

"""The watch with state: stream against batch, over restarts, late rows and gaps."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import verdict
from plumbline.operators.policy import Policy, Thresholds
from plumbline.plans import slices
from plumbline.streaming import latest, watch

SCHEMA = "at timestamp, asset string, value double"


def at(day, hour=0, minute=0):
    return datetime(2024, 1, day, hour, minute)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, latest.STORE)
    yield
    spark.conf.set(name, old)


def shown(df):
    return sorted((str(r["window_start"]), r["asset"] or "", r["kind"], round(r["magnitude"], 6), r["severity"]) for r in df.collect())


def test_stream_equals_batch_over_restarts(spark, tmp_path, store):
    steps = [
        [(at(d, h), a, float(h + (40 if d == 3 else 0))) for d in (1, 2, 3) for h in range(0, 24, 3) for a in ("a", "b")],
        # A row that is late by less than the bound, an asset of nulls, a null asset, and a day without rows of "a".
        [(at(3, 21, 30), "a", -50.0), (at(4, 5), "b", None), (at(4, 6), "b", 1.0), (at(4, 7), None, 2.0), (at(5, 1), None, 9.0)],
        [(at(5, 2), "a", 3.0), (at(5, 3), "a", 4.0), (at(9), "z", 0.0)],
    ]
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for rows in steps:
        # Each step is a run of its own, so the state comes back from the checkpoint.
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        running = latest.watch_latest(stream, "at", "asset", "value", out, ck, now=slices.NOW, late="3 hours")
        assert running.awaitTermination(120)
    every = spark.createDataFrame([r for rows in steps for r in rows if r[1] != "z"], SCHEMA)
    paired = latest.successive(watch.windowed_profile(every, "at", "asset", "value"))
    ruled, verdicts = latest.ruled_runs(paired, "value", Policy(), slices.NOW)
    want = shown(ruled)
    assert shown(spark.read.parquet(f"{out}/findings")) == want
    assert {(d[:10], a, k) for d, a, k, *_ in want} >= {("2024-01-03", "a", "RANGE_VIOLATION"), ("2024-01-04", "b", "NULL_RATE_JUMP"), ("2024-01-05", "a", "ROW_COUNT_CHANGE"), ("2024-01-05", "", "RANGE_VIOLATION")}
    runs = spark.read.parquet(f"{out}/verdict_runs").drop("epoch")
    told = lambda df: sorted(map(str, df.select("model_urn", "run_id", "millis", "result", F.to_json("native")).collect()))
    assert told(runs) == told(latest.runs_of_windows(verdicts)) and runs.count() == paired.count()
    warned = {(r["model_urn"], r["native"]["severity"]) for r in runs.filter("millis = unix_millis(timestamp'2024-01-05')").collect()}
    assert warned == {("a", "WARN"), (None, "WARN")}
    history = {r["model_urn"]: r["runs"] for r in verdict.history_summary(verdict.runs_of(runs)).collect()}
    assert history == {"a": 4, "b": 4, None: 2}


def test_successive(spark):
    rows = [(at(d, h), "a", v) for d, h, v in ((1, 0, 1.0), (1, 1, 3.0), (1, 2, 2.0), (4, 0, None), (5, 0, 2.0))]
    got = latest.successive(watch.windowed_profile(spark.createDataFrame(rows, SCHEMA), "at", "asset", "value")).orderBy("window_start").collect()
    assert [(r["row_count"], r["base_rows"], r["base_low"], r["base_high"], r["base_null_rate"]) for r in got] == [(3, None, None, None, None), (1, 3.0, 1.0, 3.0, 0.0), (1, 1.0, None, None, 1.0)]
    ruled, verdicts = latest.ruled_runs(latest.successive(watch.windowed_profile(spark.createDataFrame(rows, SCHEMA), "at", "asset", "value")), "value", Policy(thresholds=Thresholds()), slices.NOW)
    assert {(r["window_start"].day, r["kind"]) for r in ruled.collect()} == {(4, "ROW_COUNT_CHANGE"), (4, "NULL_RATE_JUMP")}
    assert {r["model_urn"]["window_start"].day: r["severity"] for r in verdicts.collect()} == {1: "CLEAR", 4: "WARN", 5: "CLEAR"}
    empty = latest.successive(watch.windowed_profile(spark.createDataFrame([], SCHEMA), "at", "asset", "value"))
    assert empty.count() == 0 and latest.ruled_runs(empty, "value", Policy(), slices.NOW)[1].count() == 0

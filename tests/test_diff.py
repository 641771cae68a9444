"""Differs on small snapshots."""

import pytest

from plumbline.operators import diff, profile
from plumbline.operators.policy import Thresholds
from plumbline.operators.snapshot import Snapshot

M, A = "m", "urn:li:dataset:(urn:li:dataPlatform:x,t,PROD)"
F1, F2 = "urn:li:mlFeature:(n,one)", "urn:li:mlFeature:(n,two)"


def snapshot(spark, columns=(), profiles=(), rows=1000, urn=A, **asset):
    a = {"entity_type": "dataset", "owners": ["o"], "tags": [], "deprecated": False, "deprecation_note": None, "feeds_features": [], "profiled": bool(profiles) or "profiled" in asset} | asset
    schema = "model_urn string, urn string, row_count bigint, entity_type string, owners array<string>, tags array<string>, deprecated boolean, deprecation_note string, feeds_features array<string>, profiled boolean"
    assets = spark.createDataFrame([(M, urn, rows, *(a[k] for k in ("entity_type", "owners", "tags", "deprecated", "deprecation_note", "feeds_features", "profiled")))], schema)
    cols = spark.createDataFrame([(M, urn, i, *c) for i, c in enumerate(columns)], "model_urn string, urn string, ord int, path string, data_type string, native_type string, nullable boolean, tags array<string>")
    stats = ("null_count", "null_proportion", "unique_count", "min", "max", "mean", "stdev")
    profs = spark.createDataFrame([(M, urn, p["path"], *(p.get(s) for s in stats)) for p in profiles], "model_urn string, urn string, path string, null_count bigint, null_proportion double, unique_count bigint, min string, max string, mean string, stdev string")
    feats = spark.createDataFrame([(M, urn, c, fs) for c, fs in asset.get("column_features", {}).items()], "model_urn string, urn string, path string, features array<string>")
    return Snapshot.of(assets, cols, profs, feats)


def col(path, native="int", nullable=False, kind="number", tags=()):
    return path, kind, native, nullable, list(tags)


def kinds(found):
    return sorted(((r["kind"], r["subject_column"]) for r in found.collect()), key=str)


def test_schema(spark):
    old = snapshot(spark, [col("a"), col("b", "bigint"), col("c"), col("d")])
    new = snapshot(spark, [col("b", "int"), col("c", nullable=True), col("d", "bigint"), col("e")], feeds_features=[F1, F2])
    found = diff.diff_schema(old, new)
    assert kinds(found) == [("COLUMN_ADDED", "e"), ("COLUMN_DROPPED", "a"), ("COLUMN_NULLABILITY_RELAXED", "c"), ("COLUMN_TYPE_CHANGED", "b")]
    by = {r["kind"]: r for r in found.collect()}
    assert by["COLUMN_DROPPED"]["summary"] == "Column `a` was dropped from t, which feeds 2 live features"
    assert by["COLUMN_DROPPED"]["affected_feature_urn"] == F1
    assert by["COLUMN_TYPE_CHANGED"]["summary"] == "Column `b` on t changed type bigint → int; not all old values fit, which feeds 2 live features"
    assert by["COLUMN_DROPPED"]["evidence"]["features"] == f"{F1}, {F2}"


def test_column_features_replace_the_asset_s(spark):
    old = snapshot(spark, [col("a"), col("b")])
    new = snapshot(spark, [], feeds_features=[F1], column_features={"a": [F2]})
    by = {r["subject_column"]: r for r in diff.dropped_columns(old, new).collect()}
    assert by["a"]["affected_feature_urn"] == F2 and by["a"]["summary"].endswith(", which feeds two")
    assert by["b"]["affected_feature_urn"] is None and not by["b"]["on_feature_path"]


def test_assets_of_one_side_are_skipped(spark):
    assert diff.diff_all(snapshot(spark, [col("a")], urn="x"), snapshot(spark, [col("b")], urn="y")).count() == 0


def test_duplicate_paths_keep_the_first(spark):
    old, new = snapshot(spark, [col("a", "bigint"), col("a", "int")]), snapshot(spark, [col("a", "bigint")])
    assert diff.diff_schema(old, new).count() == 0


def test_governance(spark):
    old = snapshot(spark, [col("a", tags=["x"])], owners=["o", "p"], tags=["urn:li:tag:pii"])
    new = snapshot(spark, [col("a", tags=["x", "urn:li:tag:GDPR"]), col("new", tags=["PII"])], owners=[], tags=["urn:li:tag:PII", "urn:li:tag:Class.Restricted", "blue"], deprecated=True, deprecation_note="gone soon")
    found = diff.diff_governance(old, new)
    assert set(kinds(found)) == {("ASSET_DEPRECATED", None), ("NEW_SENSITIVE_TAG", None), ("NEW_SENSITIVE_TAG", "a"), ("OWNERSHIP_LOST", None)}
    assert found.count() == 4
    by = {(r["kind"], r["subject_column"]): r for r in found.collect()}
    assert by["ASSET_DEPRECATED", None]["summary"] == "Dataset t is deprecated now — gone soon"
    assert by["OWNERSHIP_LOST", None]["evidence"]["previous_owners"] == "o, p"
    assert by["NEW_SENSITIVE_TAG", "a"]["evidence"]["tag_urn"] == "urn:li:tag:GDPR"
    assert by["NEW_SENSITIVE_TAG", None]["evidence"]["tag_urn"] == "urn:li:tag:Class.Restricted"
    assert diff.diff_governance(new, new).count() == 0
    assert diff.new_sensitive_tags(old, new, ("blue",)).count() == 1


def stats(spark, old, new, rows=(1000, 1000), limits=None):
    names = {p["path"] for p in old + new}
    columns = [col(n) for n in sorted(names)]
    return diff.diff_statistics(snapshot(spark, columns, old, rows[0]), snapshot(spark, columns, new, rows[1]), limits)


CASES = [
    ({"null_proportion": 0.0}, {"null_proportion": 0.10}, []),
    ({"null_proportion": 0.0}, {"null_proportion": 0.11}, ["NULL_RATE_JUMP"]),
    ({"null_proportion": 0.5}, {"null_proportion": 0.1}, []),
    ({"null_count": 0}, {"null_count": 200}, ["NULL_RATE_JUMP"]),
    ({"null_count": 0}, {}, []),
    ({"unique_count": 100}, {"unique_count": 150}, []),
    ({"unique_count": 100}, {"unique_count": 49}, ["CARDINALITY_CHANGE"]),
    ({"unique_count": 0}, {"unique_count": 9}, []),
    ({"mean": "10", "stdev": "2"}, {"mean": "16"}, []),
    ({"mean": "10", "stdev": "2"}, {"mean": "16.1"}, ["MEAN_SHIFT"]),
    ({"mean": "10", "stdev": "0"}, {"mean": "10.0001"}, ["MEAN_SHIFT"]),
    ({"mean": "10", "stdev": "0"}, {"mean": "10"}, []),
    ({"mean": "10", "stdev": "nan"}, {"mean": "99"}, []),
    ({"min": "0", "max": "9"}, {"min": "-1", "max": "9"}, ["RANGE_VIOLATION"]),
    ({"min": "0", "max": "9"}, {"max": "10"}, ["RANGE_VIOLATION"]),
    ({"max": "9"}, {"min": "-1", "max": "10"}, []),
    ({"min": "apple", "max": "pear"}, {"min": "a", "max": "z"}, []),
]


@pytest.fixture(scope="module")
def all_cases(spark):
    old = [{"path": f"c{i}"} | o for i, (o, _, _) in enumerate(CASES)]
    new = [{"path": f"c{i}"} | n for i, (_, n, _) in enumerate(CASES)]
    return kinds(stats(spark, old, new))


@pytest.mark.parametrize("i", range(len(CASES)))
def test_statistics(all_cases, i):
    assert [k for k, c in all_cases if c == f"c{i}"] == CASES[i][2]


def test_row_counts(spark):
    one = [{"path": "a"}]
    assert kinds(stats(spark, one, one, (100, 150))) == []
    assert kinds(stats(spark, one, one, (100, 49))) == [("ROW_COUNT_CHANGE", None)]
    assert kinds(stats(spark, one, one, (0, 9))) == []
    assert kinds(stats(spark, one, one, (100, 120), Thresholds(row_count_change_pct=10))) == [("ROW_COUNT_CHANGE", None)]


def test_summaries(spark):
    old = [{"path": "x", "null_proportion": 0.0, "min": "1.00", "max": "5000.00", "mean": "125.50", "stdev": "45.20", "unique_count": 1000}]
    new = [{"path": "x", "null_proportion": 0.18, "min": "1.00", "max": "18400.00", "mean": "342.10", "stdev": "512.75", "unique_count": 10}]
    by = {r["kind"]: r["summary"] for r in stats(spark, old, new).collect()}
    assert by["NULL_RATE_JUMP"] == "Null rate on `x` rose 0.0% → 18.0% (+18.0pp) in t"
    assert by["MEAN_SHIFT"] == "Mean of `x` moved 125.5 → 342.1 (+4.8σ) in t"
    assert by["RANGE_VIOLATION"] == "Values of `x` in t are outside the baseline: max 5000 → 18400"
    assert by["CARDINALITY_CHANGE"] == "Cardinality of `x` collapsed 1,000 → 10 (-99%) in t"


def test_coverage(spark):
    old = snapshot(spark, [col("a"), col("b"), col("gone")], [{"path": "a", "mean": "1"}, {"path": "b", "null_count": 1}])
    new = snapshot(spark, [col("a"), col("b")], [{"path": "a", "mean": "x"}, {"path": "b", "null_count": 2}])
    row = profile.coverage(diff.column_pairs(old, new), old.profiles, new.profiles, diff.shared_assets(old, new)).first()
    assert (row["columns_total"], row["columns_compared"], row["assets_total"], row["assets_profiled"], row["is_blind"]) == (2, 1, 1, 1, False)


def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", None, "y"), ("a", 3.0, "y"), ("b", None, None)], "k string, v double, s string")
    got = {(r["k"], r["path"]): r for r in profile.profile(df, ["k"], ["v", "s"]).collect()}
    v = got["a", "v"]
    assert (v["row_count"], v["null_count"], v["unique_count"], float(v["mean"]), float(v["min"])) == (3, 1, 2, 2.0, 1.0)
    assert got["b", "v"]["mean"] is None and got["b", "s"]["unique_count"] == 0 and got["a", "s"]["mean"] is None
    assert profile.profile(df.limit(0), ["k"], ["v"]).count() == 0
    assert {r["unique_count"] for r in profile.profile(df, ["k"], ["s"], approximate=True).collect()} == {2, 0}


def test_one_value_has_no_deviation(spark):
    """Partial states of one value, added up, round; the value is the mean all the same, and nothing deviates from it."""
    from pyspark.sql import functions as F

    from plumbline.operators import sketches
    from plumbline.streaming import watch

    df = spark.range(0, 1470, 1, 7).select(F.lit(1000.1).alias("v"), (F.col("id") % 5).alias("part"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    assert df.agg(F.stddev_samp("v")).first()[0] > 0 and df.agg(F.avg("v")).first()[0] != 1000.1
    got = profile.profile(df, [], ["v"]).first()
    merged = sketches.finish(sketches.merge(sketches.sketch(df, ["part"], ["v"]), []), []).first()
    assert [(r["mean"], r["stdev"]) for r in (got, merged)] == [("1000.1", "0.0")] * 2
    window = watch.windowed_profile(df, "at", "part", "v").first()
    assert (window["mean"], window["stdev"]) == (1000.1, 0.0)
    one, undefined = (profile.profile(spark.createDataFrame([(x,)] * n, "v double"), [], ["v"]).first() for x, n in ((2.0, 1), (float("nan"), 2)))
    assert (one["mean"], one["stdev"]) == ("2.0", None)
    assert (undefined["mean"], undefined["stdev"]) == ("NaN", "NaN")

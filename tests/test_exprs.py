"""Expressions: names, types, tags and numbers."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import exprs as X

WIDER = [
    ("int", "bigint"), ("smallint", "int"), ("float", "double"), ("decimal(10,2)", "decimal(12,2)"), ("decimal(10,2)", "decimal(12,4)"), ("varchar(16)", "varchar(64)"),
    ("varchar(64)", "text"), ("int", "double"), ("int", "decimal(10,0)"), ("decimal(8,0)", "bigint"), ("varchar(10)", "varchar(max)"), ("int(11)", "int(20)"),
    ("geography", "int"), (None, "int"), ("int", None), ("VARCHAR(8)", "varchar( 8 )"), ("decimal(5)", "decimal(6,0)"),
]
NARROWER = [
    ("bigint", "int"), ("int", "smallint"), ("double", "float"), ("decimal(12,2)", "decimal(10,2)"), ("decimal(10,2)", "decimal(8,4)"), ("decimal(10,4)", "decimal(12,2)"),
    ("varchar(64)", "varchar(16)"), ("text", "varchar(64)"), ("double", "int"), ("decimal(8,2)", "int"), ("decimal", "decimal(10,2)"), ("varchar(max)", "varchar(8)"), ("text", "int"),
]


def test_native_types(spark):
    rows = [(a, b, True) for a, b in WIDER] + [(a, b, False) for a, b in NARROWER]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    number = F.lit("NumberType")
    got = df.select("a", "b", "want", X.lossless_change(number, F.col("a"), F.lit("number"), F.col("b")).alias("got")).collect()
    assert [(r["a"], r["b"], r["got"]) for r in got] == rows


def test_logical_types(spark):
    rows = [("string", "number", False), ("StringType", " string", True), ("null", "number", True), ("number", "unknown", True), ("type", "type", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    none = F.lit(None).cast("string")
    assert all(r["want"] == r["got"] for r in df.select("want", X.lossless_change(F.col("a"), none, F.col("b"), none).alias("got")).collect())


NAMES = [
    ("urn:li:dataset:(urn:li:dataPlatform:snowflake,a.b,PROD)", "dataset", "a.b", "a.b"),
    ("urn:li:dataset:(urn:li:dataPlatform:snowflake,a.b,ZONE)", "dataset", "a.b", "ZONE"),
    ("urn:li:mlFeature:(ns,f)", "mlFeature", "f", "f"),
    ("urn:li:mlFeatureTable:(urn:li:dataPlatform:feast,t)", "mlFeatureTable", "t", "t"),
    ("urn:li:corpuser:tom", "corpuser", "tom", "tom"),
    ("plain", "unknown", "plain", "plain"),
    ("urn:li:", "unknown", "", "urn:li:"),
]


def test_names(spark):
    df = spark.createDataFrame([(n[0],) for n in NAMES], "u string")
    u = F.col("u")
    got = df.select(u, X.entity_type(u), X.report_name(u), X.finding_name(u)).collect()
    assert [tuple(r) for r in got] == NAMES
    from plumbline.plans import report

    assert all(report.short(n[0]) == n[2] for n in NAMES)


def test_fields(spark):
    good = "urn:li:schemaField:(urn:li:dataset:(urn:li:dataPlatform:x,a,PROD),col)"
    df = spark.createDataFrame([(good,), ("urn:li:schemaField:(x,c",), ("urn:li:dataset:(p,a,PROD)",)], "u string")
    got = [tuple(r) for r in df.select(X.field_dataset(F.col("u")), X.field_column(F.col("u"))).collect()]
    assert got == [("urn:li:dataset:(urn:li:dataPlatform:x,a,PROD)", "col"), (None, None), (None, None)]


def test_tags(spark):
    rows = [("urn:li:tag:Legacy.PII", "pii"), (" pii ", "pii"), ("urn:li:glossaryTerm:Class.Restricted", "restricted"), ("a:b", "a:b")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", X.tag_name(F.col("t")).alias("got")).collect())


def test_numbers(spark):
    rows = [("1.5", 1.5), ("inf", None), ("NaN", None), ("x", None), (None, None), (" 2 ", 2.0), ("0", 0.0)]
    df = spark.createDataFrame(rows, "t string, want double")
    assert all(r["want"] == r["got"] for r in df.select("want", X.finite(F.col("t")).alias("got")).collect())
    values = [0.0, 125.5, 18400.0, 342.1, 1234567.0, 0.0001, 0.00001234, -2.5, 999999.0, 1e20, 100.0, 0.1234567]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[1] for r in df.select("v", X.plain(F.col("v"))).collect()] == [f"{v:g}" for v in values]
    one = spark.range(1).select(X.relative_change(F.lit(0.0), F.lit(1.0)), X.relative_change(F.lit(-2.0), F.lit(-1.0)), X.null_rate(F.lit(None).cast("double"), F.lit(1), F.lit(0)), X.null_rate(F.lit(0.0), F.lit(5), F.lit(10)))
    assert tuple(one.first()) == (None, 0.5, None, 0.0)


@pytest.mark.parametrize("pattern,hits", [("*raw*", {"a.raw,PROD", "raw"}), ("raw", {"raw"}), ("r?w", {"raw", "r.w"}), ("[a-b].*", {"a.raw,PROD"}), ("[!a]*w", {"raw", "r.w"})])
def test_globs(spark, pattern, hits):
    df = spark.createDataFrame([("a.raw,PROD",), ("raw",), ("r.w",), ("other",)], "u string")
    assert {r[0] for r in df.filter(X.glob_match(F.col("u"), pattern)).collect()} == hits


def test_assertion_id(spark):
    import hashlib

    model = "urn:li:mlModel:(x,y,PROD)"
    want = "urn:li:assertion:" + hashlib.md5(f'{{"model_urn":"{model}","scope":"gate"}}'.encode()).hexdigest()
    assert spark.range(1).select(X.assertion_id(F.lit(model), "gate")).first()[0] == want


def test_names_are_computed_once(spark):
    """The parts of a name are split once a row, whatever the number of places that use them."""
    df = spark.createDataFrame([("urn:li:dataset:(urn:li:dataPlatform:x,a.b,PROD)",), ("urn:li:x:()",), ("urn:li:x:(a,B)",), ("urn:li:x:(a,B",), ("urn:li:x:(PROD)\n",), (None,)], "u string").repartition(1)
    named = df.select("u", X.report_name(F.col("u")).alias("name"))
    assert {r["u"]: r["name"] for r in named.collect()} == {
        "urn:li:dataset:(urn:li:dataPlatform:x,a.b,PROD)": "a.b", "urn:li:x:()": "", "urn:li:x:(a,B)": "a", "urn:li:x:(a,B": "a", "urn:li:x:(PROD)\n": "PROD", None: None,
    }
    assert named._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1

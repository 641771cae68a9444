"""Recordings in parts: round trips, named assets, folders opened, and what is not there."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.plans import demo
from plumbline.sources import recorded
from plumbline.sources.catalog import Catalog

TABLES = ("assets", "columns", "profiles", "edges", "column_edges")


def shown(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def states(spark, tmp_path_factory):
    path = demo.write_recording(spark, "governance", str(tmp_path_factory.mktemp("whole") / "one"))
    return {s: recorded.load(spark, path, s) for s in ("before", "after")}


@pytest.fixture(scope="module")
def parts(states, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts") / "many")
    recorded.record_parts(states, path, parts=8)
    return path


def scanned(df):
    """Files and folders that the one scan below ``df`` opened."""
    df = df.select("*")  # A plan of its own: a second run of one plan counts no files.
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    return [metrics.get(m).get().value() for m in ("numFiles", "numPartitions")]


def test_round_trip(spark, states, parts):
    """Both states come back as they were, the newest profile of each asset included."""
    for state, source in states.items():
        again = recorded.load_parts(spark, parts, state)
        for t in TABLES:
            rows = getattr(source, t)
            assert shown(getattr(again, t).select(rows.columns)) == shown(rows) != [], (state, t)
    assert os.listdir(parts + "/of=8") and {"state=before", "state=after"} <= set(os.listdir(parts + "/of=8"))


def test_named_assets(spark, states, parts):
    """Named assets have the same rows as in a load of all, and only their parts are opened."""
    one = recorded.load_parts(spark, parts, "after", [demo.RAW])
    for t, key in zip(TABLES, ("urn", "urn", "urn", "src", "down_urn")):
        assert shown(getattr(one, t)) == shown(getattr(recorded.load_parts(spark, parts, "after"), t).filter(F.col(key) == demo.RAW)), t
    assert scanned(one.assets) == [1, 1]
    assert scanned(recorded.load_parts(spark, parts, "after").assets)[1] > 1
    assert recorded.load_parts(spark, parts, "after", ["urn:li:dataset:nowhere"]).assets.count() == 0
    assert recorded.load_parts(spark, parts, "after", []).assets.count() == 0


def test_refused(spark, parts, states, monkeypatch):
    with pytest.raises(ValueError, match="no state"):
        recorded.load_parts(spark, parts, "between")
    monkeypatch.setattr(recorded, "MOST_NAMED", 1)
    with pytest.raises(ValueError, match="at most"):
        recorded.load_parts(spark, parts, "after", ["a", "b"])
    with pytest.raises(Exception, match="exist"):
        recorded.record_parts(states, parts)


def test_no_limit_of_assets(spark, tmp_path, monkeypatch):
    """More assets than one document takes, some named twice, one without an entity, an identity with quotes, a hub of edges."""
    monkeypatch.setattr(recorded, "MOST_ASSETS", 10)
    named = spark.range(500).select(F.format_string("urn:li:dataset:(urn:li:dataPlatform:spark,t'\"%d,PROD)", "id").alias("urn"))
    assets = named.select(
        "urn", F.lit("dataset").alias("entity_type"), F.array(F.lit("o")).alias("owners"), F.array(F.lit("")).alias("tags"), F.lit(True).alias("deprecated"), F.lit("gone\nsoon").alias("deprecation_note")
    )
    hub = assets.orderBy("urn").first()["urn"]
    edges = named.select(F.lit(hub).alias("src"), F.col("urn").alias("dst"), F.lit("DownstreamOf").alias("relationship"), F.lit(0).alias("seq")).filter("src <> dst")
    path = str(tmp_path / "parts")
    wanted = named.union(named.limit(3)).union(spark.createDataFrame([("urn:li:dataset:bare",)], "urn string"))
    recorded.record_parts({"now": Catalog.of(assets, edges)}, path, wanted)
    again = recorded.load_parts(spark, path, "now")
    assert shown(again.assets) == shown(assets) and again.edges.count() == 499 and again.profiles.count() == again.columns.count() == 0
    assert scanned(recorded.load_parts(spark, path, "now", [hub]).assets)[1] == 1


def test_parts_follow_the_rows(spark, tmp_path, monkeypatch):
    """The number of parts grows with the rows, so none grows with the catalog; a task writes one folder; edges keep both ends, nulls and order."""
    monkeypatch.setattr(recorded, "PART_ROWS", 100)
    monkeypatch.setattr(recorded, "LEAST_PARTS", 2)
    name = lambda i: F.format_string("urn:li:dataset:%d", i)
    assets = spark.range(100).select(
        name("id").alias("urn"), F.lit("dataset").alias("entity_type"), F.array(F.lit("o")).alias("owners"), F.array().cast("array<string>").alias("tags"),
        F.lit(False).alias("deprecated"), F.lit(None).cast("string").alias("deprecation_note"),
    )
    edges = spark.range(900).select(
        name(F.col("id") % 90).alias("src"), name((F.col("id") * 7 + 1) % 110).alias("dst"),
        F.when(F.col("id") % 3 > 0, F.lit("Consumes")).alias("relationship"), (-F.col("id")).cast("int").alias("seq"),
    )
    path = str(tmp_path / "parts")
    recorded.record_parts({"a": Catalog.of(assets, edges), "b": Catalog.of(assets, edges)}, path)
    assert os.listdir(path + "/of=10") and [f for f in os.listdir(path) if f.startswith("of=")] == ["of=10"]
    lines = spark.read.json(path)
    folders = lines.withColumn("file", F.input_file_name()).groupBy("state", "part").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["files"] for r in folders} == {1} and max(r["n"] for r in folders) < 30 and sum(r["n"] for r in folders) == 200
    sides = lines.filter("state = 'a'").select("urn", F.posexplode("lineage.UPSTREAM").alias("at", "e")).select("at", "e.source_urn", "e.target_urn", "e.relationship", "urn").collect()
    wanted = [r for r in edges.orderBy("seq").collect()]
    for urn in ("urn:li:dataset:0", "urn:li:dataset:89"):
        assert [(r[1], r[2], r[3]) for r in sorted(sides, key=lambda r: r["at"]) if r["urn"] == urn] == [(e["src"], e["dst"], e["relationship"]) for e in wanted if e["src"] == urn] != []
    down = lines.filter("state = 'a'").select("urn", F.posexplode("lineage.DOWNSTREAM").alias("at", "e")).orderBy("at").select("urn", "e.*").collect()
    assert [(r["source_urn"], r["target_urn"], r["relationship"]) for r in down if r["urn"] == "urn:li:dataset:99"] == [(e["src"], e["dst"], e["relationship"]) for e in wanted if e["dst"] == "urn:li:dataset:99"] != []


def test_small_on_disk(spark, tmp_path):
    """A recording takes a small part of its text on disk, and one of plain text is read as before."""
    urn = lambda kind, i: F.format_string(f"urn:li:dataset:(urn:li:dataPlatform:spark,{kind}.%d,PROD)", i)
    assets = spark.range(200).select(
        urn("part", "id").alias("urn"), F.lit("dataset").alias("entity_type"), F.array(F.lit("o")).alias("owners"), F.array().cast("array<string>").alias("tags"),
        F.lit(False).alias("deprecated"), F.lit(None).cast("string").alias("deprecation_note"),
    )
    edges = spark.range(6000).select(urn("part", F.col("id") % 200).alias("src"), urn("supplier", F.col("id")).alias("dst"), F.lit("DownstreamOf").alias("relationship"), F.col("id").cast("int").alias("seq"))
    path, plain = str(tmp_path / "parts"), str(tmp_path / "plain")
    recorded.record_parts({"now": Catalog.of(assets, edges)}, path)
    text = spark.read.text(path)
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert sum(map(os.path.getsize, files)) * 5 < text.agg(F.sum(F.length("value"))).first()[0]
    text.write.partitionBy("of", "state", "part").text(plain)
    for t in TABLES:
        again, packed = (shown(getattr(recorded.load_parts(spark, p, "now"), t)) for p in (plain, path))
        assert again == packed and (len(packed) == {"assets": 200, "edges": 6000}.get(t, 0))

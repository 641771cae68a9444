"""The whole gate over the recorded fixture, sources, sinks, impact, reports, the command line and the watch."""

import json
import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.operators import diff, impact, verdict
from plumbline.operators.policy import Policy
from plumbline.operators.snapshot import Snapshot
from plumbline.plans import demo, gate, report, slices
from plumbline.sources import catalog, documents, recorded, sinks
from plumbline.streaming import watch


@pytest.fixture(scope="module")
def results(spark):
    return {m: demo.gate_of(spark, m) for m in demo.MUTATIONS}


def test_statuses(results):
    got = {m: {r["model_urn"]: (r["status"], r["blocking"], r["warning"], r["assets_checked"]) for r in g.verdicts.collect()} for m, g in results.items()}
    assert {m: v[demo.FRAUD] for m, v in got.items()} == {"none": ("CLEAR", 0, 0, 6), "drop": ("BLOCK", 1, 0, 6), "drift": ("WARN", 0, 3, 6), "governance": ("BLOCK", 1, 1, 6)}
    assert {m: g.exit_code() for m, g in results.items()} == {"none": 0, "drop": 1, "drift": 0, "governance": 1}


def test_drop_is_attributed(results):
    row = results["drop"].findings.filter(F.col("model_urn") == demo.FRAUD).first()
    assert row["summary"] == "Column `transaction_amount` was dropped from transactions.raw, which feeds transaction_velocity_7d"
    assert [h["urn"] for h in row["hops"]] == [demo.RAW, demo.STAGING, demo.VELOCITY, demo.FRAUD]
    assert row["path_owners"] == ["urn:li:corpuser:data_eng_tom"] and row["affected_feature_urn"] == demo.VELOCITY
    incident = results["drop"].incidents.first()
    assert incident["root_urn"] == demo.RAW and incident["model_count"] == 2


def test_column_features(results):
    got = {r["path"]: r["features"] for r in results["none"].snapshot.col_features.filter(F.col("model_urn") == demo.FRAUD).collect()}
    assert set(got) == {"transaction_id", "customer_id", "transaction_amount", "timestamp"}


def test_reports(results):
    g = results["drift"]
    v = g.verdicts.filter(F.col("model_urn") == demo.FRAUD).first()
    found = g.findings.filter(F.col("model_urn") == demo.FRAUD).orderBy("place").collect()
    text = report.console(v, found, g.coverage.filter(F.col("model_urn") == demo.FRAUD).first(), report.truncation_line(["urn:li:corpuser:a"], 5))
    assert "WARN" in text and "+4.8σ" in text and "+18.0pp" in text and "Compared statistics on 3/14 columns across 3/6 assets." in text and "stopped after 5 hops at a" in text
    comment = report.markdown(v, found, report.narrate(v, "why"))
    assert "| WARN |" in comment and "@data_eng_tom" in comment
    allowed = report.named_in(v, found)
    assert report.names_only(f"see {demo.STAGING}", allowed) and not report.names_only("see urn:li:dataset:(x,y,PROD)", allowed)


def test_missing_baseline(spark):
    path = demo.write_recording(spark, "none", f"{gate.cut.__globals__['shared_dir'](spark)}/plumbline/no-baseline")
    models = spark.createDataFrame([(demo.FRAUD,), ("urn:li:mlModel:(x,ghost,PROD)",)], "model_urn string")
    empty = sinks.read_baseline(spark, f"{path}-nothing")
    source = recorded.load(spark, path, "before")
    soft = {r["model_urn"]: r["status"] for r in gate.check(source, models, empty, now=slices.NOW).verdicts.collect()}
    assert soft == {demo.FRAUD: "WARN", "urn:li:mlModel:(x,ghost,PROD)": "ERROR"}
    hard = {r["model_urn"]: r["status"] for r in gate.check(source, models, empty, now=slices.NOW, require_baseline=True).verdicts.collect()}
    assert set(hard.values()) == {"ERROR"}
    stopped = gate.check(source, models, empty, Policy(max_hops=1, fail_on_truncation=True), slices.NOW)
    assert {r["model_urn"]: r["status"] for r in stopped.verdicts.collect()}[demo.FRAUD] == "ERROR"
    with pytest.raises(ValueError):
        recorded.load(spark, path, "between")


def test_sinks(spark, results, tmp_path):
    g, base = results["governance"], str(tmp_path / "base")
    sinks.write_baseline(g.snapshot, base)
    again = sinks.read_first_baseline(spark, [str(tmp_path / "none"), base])
    assert again.assets.count() == g.snapshot.assets.count()
    assert diff.diff_all(again, g.snapshot).count() == 0
    out = str(tmp_path / "out")
    assert sinks.write_back(g.verdicts, g.findings, out, slices.NOW) == ["verdict_runs", "model_status", "model_properties"]
    sinks.write_back(g.verdicts, g.findings, out, slices.NOW)
    assert spark.read.parquet(f"{out}/verdict_runs").count() == 2
    # A later gate adds its runs; properties of other writers stay.
    own = sinks.properties(spark, out).withColumn("properties", F.create_map(F.lit("team"), F.lit("a"), F.lit("gate_severity"), F.lit("OLD")))
    sinks.patch_properties(own, out)
    assert {r["properties"]["gate_severity"] for r in sinks.properties(spark, out).collect()} == {"OLD"}
    sinks.write_back(g.verdicts, g.findings, out, slices.NOW + timedelta(hours=1))
    assert {(r["properties"]["team"], r["properties"]["gate_severity"]) for r in sinks.properties(spark, out).collect()} == {("a", "BLOCK")}
    runs = verdict.runs_of(spark.read.parquet(f"{out}/verdict_runs"))
    assert runs.count() == 4 and {r["severity"] for r in runs.collect()} == {"BLOCK"}
    status = spark.read.parquet(f"{out}/model_status").collect()
    assert len(status) == 2 and {r["dataset"] for r in status} == {demo.RAW} and status[0]["tags"] == ["urn:li:tag:gate_block"]
    with pytest.raises(sinks.WriteError) as e:
        sinks.write_back(g.verdicts, g.findings, "nosuchscheme://x", slices.NOW)
    assert set(e.value.failures) == {"verdict_runs", "model_status", "model_properties"}


def test_baselines_are_replaced_and_fail_closed(spark, results, tmp_path):
    """A new version without profiles leaves no old ones; other models keep theirs; what can't be read is an error."""
    g, base = results["none"], str(tmp_path / "base")
    sinks.write_baseline(g.snapshot, base)
    assert sinks.read_baseline(spark, base).profiles.count() == g.snapshot.profiles.count() > 0
    one = g.snapshot.assets.agg({"model_urn": "min"}).first()[0]
    bare = Snapshot.of(g.snapshot.assets.filter(F.col("model_urn") == one))
    sinks.write_baseline(bare, base)
    read = sinks.read_baseline(spark, base)
    assert read.profiles.filter(F.col("model_urn") == one).count() == 0 and read.profiles.count() > 0
    assert read.columns.filter(F.col("model_urn") == one).count() == 0 and read.assets.count() == g.snapshot.assets.count()
    # A write that breaks off before the approval changes nothing.
    g.snapshot.profiles.write.parquet(f"{base}/profiles/version=99999999999999999999-broken")
    assert sinks.read_baseline(spark, base).profiles.count() == read.profiles.count()
    shutil.rmtree(f"{base}/columns")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.read_baseline(spark, base).columns.count()


def test_sql_impact(spark, tmp_path):
    path = demo.write_recording(spark, "none", str(tmp_path / "rec"))
    source = recorded.load(spark, path, "before")
    spark.sql("CREATE OR REPLACE TEMP VIEW raw_transactions AS SELECT 'a' AS transaction_id, 'b' AS customer_id, CAST(1 AS DECIMAL(10,2)) AS transaction_amount, TIMESTAMP '2020-01-01' AS timestamp")
    tables = source.columns.select(cli.impact_table(F.col("urn")).alias("table"), F.col("urn").alias("table_urn"), "ord", "path")
    ctas = "CREATE OR REPLACE TABLE staging.transactions_clean AS SELECT transaction_id, customer_id, CAST(timestamp AS DATE) AS event_date FROM raw_transactions"
    statements = {"a.sql": ctas, "b.sql": "SELECT 1", "c.sql": "CREATE TABLE x AS SELEC", "d.sql": "CREATE TABLE staging.transactions_clean AS SELECT nothing FROM raw_transactions"}
    got = {r["sql_file"]: r for r in impact.sql_impact(spark, statements, tables, source.edges, source.assets.select("urn", "owners")).collect()}
    assert set(got) == {"a.sql", "c.sql", "d.sql"}
    assert got["a.sql"]["dropped"] == ["amount"] and got["a.sql"]["added"] == [] and got["a.sql"]["breaking"]
    assert {m["model_urn"]: m["route"] for m in got["a.sql"]["impacted"]} == {demo.FRAUD: "transaction_velocity_7d → fraud_detector_v3", demo.CHURN: "customer_txn_volume → churn_predictor_v1"}
    assert got["c.sql"]["parse_error"] and got["d.sql"]["parse_error"] and not got["d.sql"]["breaking"]
    proposal = impact.propose(spark, ctas)
    assert ("event_date", "timestamp", False) in proposal.sources and ("transaction_id", "transaction_id", True) in proposal.sources
    text = report.impact_comment([got[k] for k in sorted(got)])
    assert "columns go that models depend on" in text and "@ml_eng_alex" in text and "could not be parsed" in text
    owners = source.assets.select("urn", "owners")
    assert {r["model_urn"] for r in impact.what_if(spark, demo.CUSTOMERS, "credit_score", source.edges, owners).collect()} == {demo.FRAUD}


def test_schema_source(spark):
    rows = catalog.columns_of_schema(spark, "u", spark.createDataFrame([(1, "a", None)], "i bigint, s string, t array<int>").schema).orderBy("ord").collect()
    assert [(r["path"], r["data_type"], r["native_type"]) for r in rows] == [("i", "number", "bigint"), ("s", "string", "string"), ("t", "unknown", "array<int>")]


def test_command_line(spark, tmp_path, capsys):
    rec = tmp_path / "rec.json"
    rec.write_text(json.dumps(demo.recording("drop")))
    config = tmp_path / "p.yaml"
    config.write_text(f"models:\n- {demo.FRAUD}\n- {demo.CHURN}\n")
    common = ["--config", str(config), "--graph", f"file://{rec}"]
    base = str(tmp_path / "base")
    assert cli.main(["policy-validate", "--config", str(config)]) == 0
    assert cli.main(["policy-show", "--config", str(config)]) == 0
    assert cli.main(["baseline", *common, "--state", "before", "--baseline", base]) == 0
    assert cli.main(["check", *common, "--state", "before", "--baseline", base]) == 0
    assert cli.main(["check", *common, "--baseline", base, "--write-back", str(tmp_path / "out")]) == 1
    assert cli.main(["check", *common, "--baseline", base, "--model", demo.FRAUD, "--markdown"]) == 1
    # The first place that has a model's baseline counts; all models of a catalog; both at once, or no baseline, is an error.
    assert cli.main(["check", *common, "--state", "before", "--baseline", str(tmp_path / "none"), "--baseline", base, "--all"]) == 0
    assert cli.main(["check", *common, "--baseline", base, "--all", "--model", demo.FRAUD]) == 2
    assert cli.main(["check", *common, "--baseline", str(tmp_path / "none"), "--require-baseline"]) == 2
    # Baselines in the catalog's own records count where no place has one, each only in the record of its own model.
    notes, strange = str(tmp_path / "notes"), str(tmp_path / "strange")
    kept = documents.to_documents(sinks.read_baseline(spark, base)).select(F.col("model_urn").alias("urn"), F.lit("urn:x:gate_baseline").alias("property_urn"), F.col("document").alias("value"))
    kept.write.json(notes)
    kept.withColumn("urn", F.lit("urn:x:other")).write.json(strange)
    assert cli.main(["check", *common, "--baseline", str(tmp_path / "none"), "--records", notes]) == 1
    assert cli.main(["check", *common, "--records", strange, "--require-baseline"]) == 2
    assert cli.main(["check", *common]) == 2
    assert cli.main(["demo", "--config", str(config)]) == 1
    assert cli.main(["history", "--config", str(config), "--runs", str(tmp_path / "out" / "verdict_runs")]) == 0
    assert cli.main(["what-if", *common, demo.RAW, "x"]) == 0
    sql = tmp_path / "change.sql"
    sql.write_text("CREATE TABLE staging.transactions_clean AS SELECT 1 AS transaction_id")
    assert cli.main(["impact", *common, str(sql)]) == 0
    assert cli.main(["impact", *common, str(sql), "--fail-on-impact"]) == 1
    assert cli.main(["resolve", *common, "--model", "urn:li:mlModel:(x,ghost,PROD)"]) == 2
    config.write_text("rules: {NOPE: WARN}")
    assert cli.main(["policy-validate", "--config", str(config)]) == 2
    out = capsys.readouterr().out
    assert "affects 2 models" in out and "fraud_detector_v3 via staging.transactions_clean → transaction_velocity_7d" in out


def test_stream_equals_batch(spark, tmp_path):
    events = slices.table(spark, "/root/testdata/sf0.001", "events")
    source = str(tmp_path / "events")
    events.repartition(3).write.parquet(source)
    base = events.groupBy(F.col("event_type").alias("asset")).agg(
        F.lit(1.0).alias("base_rows"), (F.avg("value")).alias("base_low"), F.avg("value").alias("base_high"), F.avg("value").alias("base_mean"), F.stddev_samp("value").alias("base_stdev"), F.lit(0.0).alias("base_null_rate")
    )
    stream = spark.readStream.schema(events.schema).parquet(source)
    running = watch.watch(stream, base, "ts", "event_type", "value", str(tmp_path / "out"), str(tmp_path / "ck"), now=slices.NOW)
    assert running.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = watch.drift(watch.windowed_profile(events, "ts", "event_type", "value"), base)
    key = ["window_start", "asset", "kind"]
    closed = got.select(*key).distinct()
    assert closed.count() > 0 and {r["severity"] for r in got.collect()} == {"WARN"}
    assert closed.exceptAll(batch.select(*key)).count() == 0
    assert batch.select(*key).exceptAll(closed).select("window_start").distinct().count() <= 1
    # A batch that is replayed after a failure writes its own folder again.
    commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for f in [*commits[-1:], *(tmp_path / "ck" / "commits").glob(f".{commits[-1].name}.crc")]:
        f.unlink()
    before = sorted(map(str, got.select(*key, "epoch").collect()))
    again = watch.watch(spark.readStream.schema(events.schema).parquet(source), base, "ts", "event_type", "value", str(tmp_path / "out"), str(tmp_path / "ck"), now=slices.NOW)
    assert again.awaitTermination(120)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*key, "epoch").collect())) == before


def test_documents(spark, results):
    snapshot = results["drift"].snapshot
    docs = documents.to_documents(snapshot)
    assert docs.count() == 2
    back = documents.from_documents(docs)
    assert diff.diff_all(back, snapshot).count() == 0 and back.columns.count() == snapshot.columns.count()
    text = docs.first()["document"]
    rows = [("a", "urn:x:gate_baseline", text, None), ("a", None, None, "other {model_urn}"), ("b", None, None, f"see {text} here"), ("c", "urn:x:color", "blue", "{}"), ("d", "urn:x:baseline", "no json", None)]
    found = documents.embedded(spark.createDataFrame(rows, "urn string, property_urn string, value string, description string"))
    got = {r["model_urn"]: r["document"] for r in found.collect()}
    assert got == {"a": text, "b": text, "d": "no json"}
    assert documents.from_documents(found.filter("model_urn = 'd'")).assets.count() == 0


def test_patch(spark):
    schema = "model_urn string, properties map<string,string>"
    old, new = spark.createDataFrame([("m", {"a": "1", "b": "2"}), ("n", {"x": "y"})], schema), spark.createDataFrame([("m", {"b": "3"}), ("o", {"z": "1"})], schema)
    assert {r["model_urn"]: r["properties"] for r in sinks.patched(old, new).collect()} == {"m": {"a": "1", "b": "3"}, "n": {"x": "y"}, "o": {"z": "1"}}


def test_first_findings(results):
    got = verdict.first_findings(results["drift"].findings, 2)
    assert got.filter(F.col("model_urn") == demo.FRAUD).count() == 2


def test_scale_graph(spark):
    from plumbline.operators import graph

    models = spark.createDataFrame([(demo._model("scale_model"),)], "model_urn string")
    found = graph.footprint(models, demo.scale_edges(spark, 40), 5)
    assert found.count() == 1 + 40 + 40 + 40 + 1 + 2 + 3
    assert [r["urn"] for r in found.filter("truncated").collect()] == [demo._dataset("deep_02")]
    assert graph.footprint(models, demo.scale_edges(spark, 40), 20).filter("truncated").count() == 0


def test_recording_of_a_catalog(spark, tmp_path, monkeypatch):
    """A recorded catalog loads as it was, with its owners, tags, notes, edges, profiles and column lineage."""
    path = demo.write_recording(spark, "governance", str(tmp_path / "first"))
    states = {s: recorded.load(spark, path, s) for s in ("before", "after")}
    urns = states["before"].assets.select("urn").unionByName(states["after"].assets.select("urn"))
    recorded.record(states, urns, str(tmp_path / "second"))
    tables = ("assets", "columns", "profiles", "edges", "column_edges")
    shown = lambda df: sorted(map(repr, df.collect()))
    for state, catalog_of in states.items():
        again = recorded.load(spark, str(tmp_path / "second"), state)
        for t in tables:
            rows = getattr(catalog_of, t)
            assert shown(getattr(again, t).select(rows.columns)) == shown(rows) != [], (state, t)
    # Only the named assets, and no more than a document may hold.
    recorded.record({"after": states["after"]}, urns.filter(F.col("urn") == demo.RAW), str(tmp_path / "third"))
    one = recorded.load(spark, str(tmp_path / "third"), "after")
    assert [r["urn"] for r in one.assets.collect()] == [demo.RAW] and {r["urn"] for r in one.columns.collect()} == {demo.RAW}
    monkeypatch.setattr(recorded, "MOST_ASSETS", 1)
    with pytest.raises(ValueError, match="at most"):
        recorded.record(states, urns, str(tmp_path / "fourth"))


def test_property_definitions(spark, tmp_path):
    out = str(tmp_path / "out")
    assert sinks.define_properties(spark, out) and sinks.define_properties(spark, out)
    names = [r["name"] for r in spark.read.parquet(f"{out}/property_definitions").collect()]
    assert sorted(names) == sorted(sinks.PROPERTIES)
    assert not sinks.define_properties(spark, "nosuchscheme://x")


def test_places_of_incidents(spark):
    rows = [(f"r{i:03d}", i % 5) for i in range(200)]
    got = verdict.placed_incidents(spark.createDataFrame(rows, "root_urn string, model_count long").repartition(7)).collect()
    want = {r: p for p, (r, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    assert {r["root_urn"]: r["place"] for r in got} == want
    assert verdict.placed_incidents(spark.createDataFrame([], "root_urn string, model_count long")).count() == 0

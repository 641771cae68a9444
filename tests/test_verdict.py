"""Policies, ruling, verdicts, incidents and history."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions.kinds import KINDS
from plumbline.operators import verdict
from plumbline.operators.policy import Exemption, Policy, PolicyError, load_policy, policy_from

NOW = datetime(2026, 8, 3, 12, tzinfo=UTC)
LATER, PAST = NOW + timedelta(days=1), NOW - timedelta(days=1)


def findings(spark, rows):
    schema = "model_urn string, kind string, subject_urn string, subject_column string, summary string, root_urn string, path_owners array<string>, family_ord int, ord int, kind_ord int"
    full = [(m, k, u, c, f"{k} {u}", u, [f"owner-{m}"], 0, i, 0) for i, (m, k, u, c) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def severities(spark, rows, policy):
    return {(r["kind"], r["subject_urn"], r["subject_column"]): r for r in verdict.rule(findings(spark, [("m", *r) for r in rows]), policy, NOW).collect()}


def test_default_severities(spark):
    got = severities(spark, [(k, "u", None) for k in KINDS], Policy())
    assert {k[0]: r["severity"] for k, r in got.items()} == {k: s for k, (_, s) in KINDS.items()}
    assert got["MEAN_SHIFT", "u", None]["confidence"] == "PROBABLE" and got["COLUMN_DROPPED", "u", None]["rule_id"] == "column-dropped"


def test_probable_findings_cannot_block(spark):
    rules = {"MEAN_SHIFT": "BLOCK", "COLUMN_ADDED": "BLOCK"}
    rows = [("MEAN_SHIFT", "u", None), ("COLUMN_ADDED", "u", None)]
    assert {k[0]: r["severity"] for k, r in severities(spark, rows, Policy(rules)).items()} == {"MEAN_SHIFT": "WARN", "COLUMN_ADDED": "BLOCK"}
    assert {r["severity"] for r in severities(spark, rows, Policy(rules, allow_probable_block=True)).values()} == {"BLOCK"}


def test_exemptions(spark):
    policy = Policy(
        exemptions=(
            Exemption("expired", PAST, "CLEAR"),
            Exemption("ends now", NOW, "CLEAR"),
            Exemption("column", LATER, "CLEAR", column="c"),
            Exemption("any of x", LATER, "WARN", urn_pattern="x*"),
            Exemption("kind", LATER, "CLEAR", kind="COLUMN_DROPPED"),
        )
    )
    rows = [("COLUMN_DROPPED", "u", "c"), ("COLUMN_DROPPED", "xu", "d"), ("COLUMN_DROPPED", "u", None), ("COLUMN_ADDED", "xu", "d"), ("ASSET_DEPRECATED", "u", None)]
    got = severities(spark, rows, policy)
    assert [got[r]["severity"] for r in rows] == ["CLEAR", "WARN", "CLEAR", "WARN", "BLOCK"]
    assert got[rows[0]]["exempted_by"] == "column" and got[rows[0]]["exemption_expires"] == LATER.isoformat() and got[rows[4]]["exempted_by"] is None


def test_order_and_explanation(spark):
    rows = [("m", "MEAN_SHIFT", "a", "c"), ("m", "OWNERSHIP_LOST", "b", None), ("m", "COLUMN_DROPPED", "z", "k"), ("m", "COLUMN_DROPPED", "a", "k"), ("m", "COLUMN_ADDED", "a", "n"), ("w", "MEAN_SHIFT", "a", "c")]
    ruled = verdict.listed(verdict.rule(findings(spark, rows), Policy(), NOW))
    got = [(r["kind"], r["subject_urn"]) for r in ruled.filter("model_urn = 'm'").orderBy("place").collect()]
    assert got == [("COLUMN_DROPPED", "a"), ("COLUMN_DROPPED", "z"), ("OWNERSHIP_LOST", "b"), ("MEAN_SHIFT", "a"), ("COLUMN_ADDED", "a")]
    models = spark.createDataFrame([("m", 3, False), ("w", 2, False), ("quiet", 5, False), ("blind", 1, False), ("cut", 9, True)], "model_urn string, assets_checked int, truncated_stop boolean")
    found = verdict.verdicts(models, ruled)
    by = {r["model_urn"]: r for r in found.collect()}
    assert {m: (r["status"], r["exit_code"]) for m, r in by.items()} == {"m": ("BLOCK", 1), "w": ("WARN", 0), "quiet": ("CLEAR", 0), "blind": ("ERROR", 2), "cut": ("ERROR", 2)}
    assert (by["m"]["blocking"], by["m"]["warning"], by["m"]["findings"], by["m"]["warning_kinds"]) == (2, 2, 5, "MEAN_SHIFT,OWNERSHIP_LOST")
    assert {r["model_urn"]: r["exit_code"] for r in verdict.verdicts(models, ruled, True).collect()}["w"] == 1
    assert verdict.sweep_exit(found).first()[0] == 2
    text = {r["model_urn"]: r["explanation"] for r in verdict.explain(found, ruled).collect()}
    assert text["m"] == "Blocked by column dropped on k and 1 other blocking change(s)."
    assert text["w"] == "Warned of mean shift on c."
    assert text["quiet"] == "Nothing to report on 5 upstream assets."


def test_incidents(spark):
    rows = [("b", "MEAN_SHIFT", "r", "c"), ("b", "COLUMN_DROPPED", "r", "k"), ("a", "MEAN_SHIFT", "r", "c"), ("a", "MEAN_SHIFT", "r", "d"), ("a", "COLUMN_DROPPED", "lone", "k"), ("c", "COLUMN_ADDED", "r", "k")]
    ruled = verdict.listed(verdict.rule(findings(spark, rows), Policy(), NOW))
    got = verdict.incidents(ruled).collect()
    assert [(r["root_urn"], r["model_count"], r["worst_severity"], r["owners"]) for r in got] == [("r", 2, "BLOCK", ["owner-a"])]
    assert [tuple(a) for a in got[0]["affected"]] == [("a", "MEAN_SHIFT r"), ("b", "COLUMN_DROPPED r")]
    from plumbline.plans import report

    assert report.incident_lines(got[0])[0] == "r (@owner-a) — affects 2 models"


def test_history(spark):
    rows = [("m", str(i), 1_700_000_000_000 + i * 86_400_000, "FAILURE" if i == 2 else "SUCCESS", {"severity": "BLOCK" if i == 2 else "WARN", "warning_count": "x" if i == 1 else "3", "warning_kinds": "A,B" if i % 2 else "A,,A"}) for i in range(5)]
    rows += [("m", "9", 0, None, {}), ("n", "1", None, "SUCCESS", None)]
    runs = verdict.runs_of(spark.createDataFrame(rows, "model_urn string, run_id string, millis bigint, result string, native map<string,string>"))
    assert runs.count() == 6
    by = {r["run_id"]: r for r in runs.filter("model_urn = 'm'").collect()}
    assert by["1"]["warning"] == 0 and by["0"]["warning"] == 3 and by["2"]["exit_code"] == 1 and not by["2"]["passed"]
    assert {r["run_id"] for r in verdict.recent(runs, 2).filter("model_urn = 'm'").collect()} == {"3", "4"}
    summary = {r["model_urn"]: r["summary"] for r in verdict.history_summary(runs).collect()}
    assert summary == {"m": "5 run(s) over 4 day(s), 1 blocked.", "n": "1 run(s), 0 blocked."}
    got = verdict.calibrate(runs).collect()
    assert [(r["kind"], r["warn_count"], r["total_runs"]) for r in got] == [("A", 5, 5)]
    assert verdict.calibrate(runs.filter(F.col("run_id") < "3")).count() == 0


def test_policy_documents(tmp_path):
    assert load_policy(tmp_path / "absent.yaml") == Policy()
    path = tmp_path / "p.yaml"
    path.write_text("rules: {MEAN_SHIFT: CLEAR}\nmax_hops: 3\nmodels: [a]\nthresholds: {mean_shift_sigma: 2}\nsensitive_tags: [x]\nexemptions:\n- {reason: r, expires: 2027-01-01, kind: MEAN_SHIFT}\n")
    policy = load_policy(path).validate()
    assert policy.severity_of("MEAN_SHIFT") == "CLEAR" and policy.max_hops == 3 and policy.thresholds.mean_shift_sigma == 2 and policy.sensitive_tags == ("x",)
    assert policy.exemptions[0].expires == datetime(2027, 1, 1, tzinfo=UTC)
    assert ("MEAN_SHIFT", "CLEAR", "PROBABLE", "policy") in policy.table()
    for text in ("rules: [", "- 1", "rules: {A: LOUD}", "exemptions: [{expires: 2027-01-01}]", "thresholds: {x: 1}"):
        path.write_text(text)
        with pytest.raises(PolicyError):
            load_policy(path)
    for bad in ({"rules": {"NOPE": "WARN"}}, {"exemptions": [{"reason": "r"}]}, {"exemptions": [{"reason": "r", "expires": "2027-01-01", "downgrade_to": "BLOCK"}]}):
        with pytest.raises(PolicyError):
            policy_from(bad).validate()

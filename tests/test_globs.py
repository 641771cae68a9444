"""The index of exemptions against trying them in their order."""

import fnmatch
import random
from datetime import UTC, datetime, timedelta

from plumbline.operators import globs, verdict
from plumbline.operators.policy import Exemption, Policy

NOW = datetime(2026, 8, 3, 12, tzinfo=UTC)
LATER = NOW + timedelta(days=3)
KINDS = ("COLUMN_DROPPED", "MEAN_SHIFT", "COLUMN_ADDED")


def table(spark, rows):
    return spark.createDataFrame(rows, "kind string, subject_urn string, subject_column string")


def random_exemption(rng, i):
    body = rng.choice(["raw", "mart", "stage", "a", ""]) + str(rng.randrange(40))
    pattern = rng.choice([None, "*", f"urn:{body}", f"urn:{body}*", f"*{body}", f"urn:*{body}?", f"*{body[:1]}*", f"urn:[rm]*{body[-1:]}", f"u?n:{body}*", "urn:[!a]*", f"*[0-4]{body[-1:]}", "urn:[", "*]"])
    return Exemption(f"e{i}", LATER if i % 7 else NOW, rng.choice(["CLEAR", "WARN"]), rng.choice([None, *KINDS]), pattern, rng.choice([None, None, "c1", "*", ""]))


def test_same_as_in_order(spark):
    rng = random.Random(12)
    exemptions = [random_exemption(rng, i) for i in range(400)]
    rng.shuffle(exemptions)
    rows = [(rng.choice(KINDS), "urn:" + rng.choice(["raw", "mart", "stage", "A", ""]) + str(rng.randrange(50)) + rng.choice(["", "x", "]"]), rng.choice([None, "c1", "c2", "*", ""])) for _ in range(300)]
    rows += rows[:50] + [("MEAN_SHIFT", "", None)]
    policy = Policy(exemptions=tuple(exemptions))
    active = [x for x in exemptions if x.active(NOW)]

    def first(kind, urn, column):
        for x in active:
            if x.kind in (None, kind) and (x.urn_pattern is None or fnmatch.fnmatchcase(urn, x.urn_pattern)) and (x.column is None or x.column == column):
                return x.reason, x.downgrade_to
        return None, None

    for some in (policy, Policy(exemptions=tuple(active[: verdict.FEW]))):
        active = [x for x in some.exemptions if x.active(NOW)]
        got = verdict.rule(table(spark, rows), some, NOW).collect()
        assert len(got) == len(rows)
        for r in got:
            reason, severity = first(r["kind"], r["subject_urn"], r["subject_column"])
            assert r["exempted_by"] == reason, r
            if reason:
                assert r["severity"] == severity and r["exemption_expires"] == LATER.isoformat()


def test_ten_thousand_in_a_plan_of_the_same_size(spark):
    def plan(n):
        exemptions = tuple(Exemption(f"e{i}", LATER, urn_pattern=f"urn:table{i:05}*", column="c") for i in range(n))
        out = verdict.rule(table(spark, [("MEAN_SHIFT", "urn:table00007x", "c"), ("MEAN_SHIFT", "urn:table99999x", "c")]), Policy(exemptions=exemptions), NOW)
        return out, len(out._jdf.queryExecution().optimizedPlan().toString())

    (_, small), (out, large) = plan(100), plan(10_000)
    assert large < 1.2 * small
    assert sorted(r["exempted_by"] or "" for r in out.collect()) == ["", "e7"]


def test_literal_ends():
    ends = {"abc": ("abc", "abc"), "a*b?c": ("a", "c"), "*x": ("", "x"), "x*": ("x", ""), "a[bc]d": ("a", "d"), "[]": ("", ""), "": ("", "")}
    assert {p: globs.literal_ends(p) for p in ends} == ends

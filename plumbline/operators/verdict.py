"""Ruling findings, verdicts per model, incidents across models, history and its review."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.functions.durable import cut
from plumbline.functions.kinds import BLOCK, CERTAIN, CLEAR, KINDS, PROBABLE, WARN
from plumbline.operators import globs
from plumbline.operators.policy import Exemption, Policy

#: Runs that a review needs, and the share of them in which a chronic kind warned.
LEAST_RUNS, CHRONIC_RATE = 4, 0.5

#: Exemptions up to which they are tried one after the other; more are looked up in an index.
FEW = 16


def _covers(x: Exemption) -> Column:
    met = F.lit(True)
    if x.kind is not None:
        met = met & (F.col("kind") == x.kind)
    if x.urn_pattern is not None:
        met = met & X.glob_match(F.col("subject_urn"), x.urn_pattern)
    if x.column is not None:
        met = met & F.coalesce(F.col("subject_column") == x.column, F.lit(False))
    return met


def rule(findings: DataFrame, policy: Policy, now: datetime) -> DataFrame:
    """Adds confidence, rule_id, severity, severity_rank, exempted_by and exemption_expires.

    Probable findings warn where a rule would block, unless the policy lets them. Then the first
    active exemption that matches, in file order, sets the severity, up or down. More than FEW exemptions
    are an index that findings are joined with, so the plan doesn't grow with them.
    """
    ruled = {k: WARN if c == PROBABLE and policy.severity_of(k) == BLOCK and not policy.allow_probable_block else policy.severity_of(k) for k, (c, _) in KINDS.items()}
    severity = X.literal_map(ruled, F.col("kind"))
    active = [x for x in policy.exemptions if x.active(now)]
    out = findings.withColumn("confidence", X.literal_map({k: c for k, (c, _) in KINDS.items()}, F.col("kind")))
    out = out.withColumn("rule_id", X.rule_id(F.col("kind")))
    if len(active) > FEW:
        out = globs.first_match(out, active)
    else:
        told = lambda i, x: F.struct(F.lit(i).alias("ord"), F.lit(x.downgrade_to).alias("downgrade_to"), F.lit(x.reason).alias("reason"), F.lit(x.expires.isoformat() if x.expires else None).cast("string").alias("expires"))
        none = F.lit(None).cast("struct<ord:int,downgrade_to:string,reason:string,expires:string>")
        out = out.withColumn("exemption", F.coalesce(*(F.when(_covers(x), told(i, x)) for i, x in enumerate(active)), none))
    out = out.withColumn("severity", F.coalesce("exemption.downgrade_to", severity)).withColumn("severity_rank", X.severity_rank(F.col("severity")))
    return out.withColumn("exempted_by", F.col("exemption.reason")).withColumn("exemption_expires", F.col("exemption.expires")).drop("exemption")


def listing_order() -> list[Column]:
    """Worst first, certain before probable, then kind, subject, column and the differ's own order."""
    return [
        F.desc("severity_rank"),
        F.when(F.col("confidence") == CERTAIN, 0).otherwise(1),
        F.asc("kind"),
        F.asc("subject_urn"),
        F.coalesce("subject_column", F.lit("")),
        F.asc("family_ord"),
        F.asc("ord"),
        F.asc("kind_ord"),
    ]


def listed(ruled: DataFrame) -> DataFrame:
    """Adds ``place``, the finding's place in its model's report, from 1. Findings of one model are few."""
    return ruled.withColumn("place", F.row_number().over(Window.partitionBy("model_urn").orderBy(*listing_order())))


def first_findings(ruled: DataFrame, most: int = 3) -> DataFrame:
    """The findings of each model that come first in its differs' order, for a closer look."""
    order = Window.partitionBy("model_urn").orderBy("family_ord", "subject_urn", "kind_ord", "ord", F.coalesce("subject_column", F.lit("")))
    return ruled.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)


def verdicts(models: DataFrame, ruled: DataFrame, fail_on_warn: bool = False) -> DataFrame:
    """A row per model: severity, blocking, warning, findings, warning_kinds, exit_code.

    Models without findings stay, as CLEAR. ``models``: model_urn, and optionally ``assets_checked``
    and ``truncated_stop``: a model with one asset at most, or stopped for a truncated walk, is an
    ERROR with exit code 2, whatever was found.
    """
    kinds = F.array_sort(F.collect_set(F.when(F.col("severity") == WARN, F.col("kind"))))
    own = ruled.groupBy("model_urn").agg(
        F.max("severity_rank").alias("worst"),
        F.count_if(F.col("severity") == BLOCK).alias("blocking"),
        F.count_if(F.col("severity") == WARN).alias("warning"),
        F.count(F.lit(1)).alias("findings"),
        F.array_join(kinds, ",").alias("warning_kinds"),
    )
    out = models.join(own, "model_urn", "left")
    for c in ("worst", "blocking", "warning", "findings"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    out = out.withColumn("warning_kinds", F.coalesce("warning_kinds", F.lit(""))).withColumn("severity", X.severity_name(F.col("worst")))
    failed = F.lit(False)
    if "assets_checked" in models.columns:
        failed = failed | (F.col("assets_checked") <= 1)
    if "truncated_stop" in models.columns:
        failed = failed | F.coalesce("truncated_stop", F.lit(False))
    code = F.when(F.col("severity") == BLOCK, 1).when((F.col("severity") == WARN) & F.lit(fail_on_warn), 1).otherwise(0)
    return out.withColumn("status", F.when(failed, "ERROR").otherwise(F.col("severity"))).withColumn("exit_code", F.when(failed, 2).otherwise(code)).drop("worst")


def sweep_exit(found: DataFrame) -> DataFrame:
    """The worst exit code of a sweep: errors outrank blocks."""
    return found.agg(F.coalesce(F.max("exit_code"), F.lit(0)).alias("exit_code"))


def explain(found: DataFrame, ruled: DataFrame) -> DataFrame:
    """(model_urn, explanation): one line for each verdict, naming its first finding."""
    first = listed(ruled).filter("place = 1 and severity <> 'CLEAR'")
    lead = first.select(
        "model_urn",
        F.replace(F.lower("kind"), F.lit("_"), F.lit(" ")).alias("what"),
        F.coalesce("subject_column", "subject_urn").alias("place_name"),
    )
    out = found.join(lead, "model_urn", "left")
    checked = F.col("assets_checked").cast("string") if "assets_checked" in found.columns else F.lit("0")
    more = lambda n, word: F.when(n > 1, F.concat(F.lit(" and "), (n - 1).cast("string"), F.lit(f" other {word}."))).otherwise(".")
    text = (
        F.when(F.col("severity") == CLEAR, F.concat(F.lit("Nothing to report on "), checked, F.lit(" upstream assets.")))
        .when(F.col("severity") == BLOCK, F.concat(F.lit("Blocked by "), "what", F.lit(" on "), "place_name", more(F.col("blocking"), "blocking change(s)")))
        .otherwise(F.concat(F.lit("Warned of "), "what", F.lit(" on "), "place_name", more(F.col("warning"), "warning(s)")))
    )
    return out.select("model_urn", text.alias("explanation"))


def ordered_incidents(found: DataFrame) -> DataFrame:
    """Incidents in the order of a report: those of most models first, then by root."""
    return found.orderBy(F.desc("model_count"), "root_urn")


def placed_incidents(found: DataFrame) -> DataFrame:
    """Adds ``place``, the incident's place in that order, from 1; sorted by ranges, with the partitions' sizes added up."""
    ordered = ordered_incidents(found).withColumn("part", F.spark_partition_id())
    numbered = cut(ordered.withColumn("row", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "incidents")
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    # A row per partition of the sort.
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    return numbered.join(starts, "part").withColumn("place", F.col("start") + F.col("row") + 1).drop("part", "row", "start")


def incidents(ruled: DataFrame) -> DataFrame:
    """Roots that two models or more are warned or blocked by.

    Needs listed, attributed findings: root_urn, path_owners, place. Of each model's findings on one
    root, the worst counts, the first among equals; owners are those seen first, by model.
    """
    counted = ruled.filter((F.col("severity") != CLEAR) & F.col("root_urn").isNotNull())
    worst = F.max_by(F.struct("summary", "severity_rank"), F.struct("severity_rank", -F.col("place")))
    by_model = counted.groupBy("root_urn", "model_urn").agg(worst.alias("worst"), F.min_by("path_owners", "place").alias("own"))
    grouped = by_model.groupBy("root_urn").agg(
        F.count(F.lit(1)).alias("model_count"),
        F.max("worst.severity_rank").alias("rank"),
        F.min_by("own", "model_urn").alias("owners"),
        F.array_sort(F.collect_list(F.struct("model_urn", F.col("worst.summary").alias("summary")))).alias("affected"),
    )
    return grouped.filter("model_count > 1").select("root_urn", "model_count", X.severity_name(F.col("rank")).alias("worst_severity"), "owners", "affected")


# -- history ------------------------------------------------------------------


def runs_of(events: DataFrame) -> DataFrame:
    """Recorded runs from raw events (model_urn, run_id, millis, result, native map of text)."""
    native = lambda key: F.try_element_at("native", F.lit(key))
    count = lambda key: F.coalesce(native(key).try_cast("bigint"), F.lit(0))
    kinds = F.filter(F.split(F.coalesce(native("warning_kinds"), F.lit("")), ","), lambda k: k != "")
    return events.filter(F.col("result").isNotNull()).select(
        "model_urn",
        F.coalesce("run_id", F.lit("")).alias("run_id"),
        F.timestamp_millis(F.coalesce("millis", F.lit(0))).alias("checked_at"),
        "result",
        F.coalesce(native("severity"), F.lit("")).alias("severity"),
        count("blocking_count").alias("blocking"),
        count("warning_count").alias("warning"),
        count("assets_checked").alias("assets_checked"),
        kinds.alias("warning_kinds"),
        (F.col("result") != "FAILURE").alias("passed"),
        F.when(native("severity") == BLOCK, 1).otherwise(0).alias("exit_code"),
    )


def recent(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest ``limit`` runs of each model."""
    newest = Window.partitionBy("model_urn").orderBy(F.desc("checked_at"), F.desc("run_id"))
    return runs.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= limit)


def history_summary(runs: DataFrame) -> DataFrame:
    """(model_urn, runs, blocked, days, summary) of recorded runs."""
    seconds = F.unix_seconds(F.max("checked_at").cast("timestamp")) - F.unix_seconds(F.min("checked_at").cast("timestamp"))
    out = runs.groupBy("model_urn").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("severity") == BLOCK).alias("blocked"), F.floor(seconds / 86400).alias("days")
    )
    span = F.when(F.col("runs") < 2, "").when(F.col("days") > 0, F.concat(F.lit(" over "), F.col("days").cast("string"), F.lit(" day(s)"))).otherwise(" today")
    return out.withColumn("summary", F.concat(F.col("runs").cast("string"), F.lit(" run(s)"), span, F.lit(", "), F.col("blocked").cast("string"), F.lit(" blocked.")))


def calibrate(runs: DataFrame) -> DataFrame:
    """(model_urn, kind, warn_count, total_runs, rate): kinds that warned in half the runs or more."""
    totals = runs.groupBy("model_urn").agg(F.count(F.lit(1)).alias("total_runs")).filter(F.col("total_runs") >= LEAST_RUNS)
    warned = runs.select("model_urn", F.explode(F.array_distinct("warning_kinds")).alias("kind"))
    counted = warned.groupBy("model_urn", "kind").agg(F.count(F.lit(1)).alias("warn_count")).join(totals, "model_urn")
    rated = counted.withColumn("rate", F.col("warn_count") / F.col("total_runs"))
    return rated.filter(F.col("rate") >= CHRONIC_RATE)

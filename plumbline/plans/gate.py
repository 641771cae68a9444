"""The gate: resolve, guard, diff, attribute, rule and report, for one model or an inventory at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.durable import cut
from plumbline.operators import diff, graph, profile, verdict
from plumbline.operators.policy import Policy
from plumbline.operators.snapshot import Snapshot
from plumbline.sources.catalog import Catalog


@dataclass(frozen=True)
class Gate:
    """The result of one run, lazily: tables by model_urn."""

    footprint: DataFrame
    snapshot: Snapshot
    findings: DataFrame
    verdicts: DataFrame
    coverage: DataFrame
    incidents: DataFrame
    #: Levels of the walk, ends of edges that it fetched, and how many of them it had met before.
    walked: dict[str, int] = field(default_factory=dict)

    def exit_code(self) -> int:
        """2 if any model is an error, else 1 if any blocks, else 0."""
        return verdict.sweep_exit(self.verdicts).first()["exit_code"]


def resolve(catalog: Catalog, models: DataFrame, max_hops: int = 5, counters: graph.Counters | None = None) -> tuple[DataFrame, Snapshot]:
    """The models' footprints and the snapshot of all assets on them."""
    found = cut(catalog.footprint(models, max_hops, counters), "footprint")
    return found, catalog.snapshot(found, max_hops).durable()


def check(catalog: Catalog, models: DataFrame, baseline: Snapshot, policy: Policy | None = None, now: datetime | None = None, fail_on_warn: bool = False, require_baseline: bool = False, queries: DataFrame | None = None) -> Gate:
    """Gates all ``models`` (column model_urn) against their baselines.

    A model whose footprint has one asset at most is an error. So is one whose walk was cut short if
    the policy says so, and one without a baseline if ``require_baseline``; else a missing baseline
    is a finding that warns.
    """
    policy, now = policy or Policy(), now or datetime.now(UTC)
    models = models.select("model_urn").distinct()
    counters = graph.Counters()
    found, current = resolve(catalog, models, policy.max_hops, counters)
    known = baseline.assets.select("model_urn").distinct()
    differences = diff.diff_all(baseline, current, policy.thresholds, policy.sensitive_tags)
    bare = diff.missing_baselines(models, baseline, current)
    owners = current.assets.select("model_urn", "urn", "owners")
    attributed = graph.attribute(differences.unionByName(bare), found, owners, queries)
    listed = cut(verdict.listed(verdict.rule(attributed, policy, now)), "findings")
    inventory = models.join(
        found.groupBy("model_urn").agg(F.count(F.lit(1)).alias("assets_checked"), F.max("truncated").alias("truncated")), "model_urn", "left"
    ).withColumn("assets_checked", F.coalesce("assets_checked", F.lit(0)))
    stop = F.coalesce("truncated", F.lit(False)) & F.lit(policy.fail_on_truncation)
    if require_baseline:
        inventory = inventory.join(known.withColumn("has_baseline", F.lit(True)), "model_urn", "left")
        stop = stop | F.col("has_baseline").isNull()
    ruled = verdict.verdicts(inventory.withColumn("truncated_stop", stop), listed, fail_on_warn)
    common = diff.column_pairs(baseline, current).select("model_urn", "urn", "path")
    covered = profile.coverage(common, baseline.profiles, current.profiles, diff.shared_assets(baseline, current))
    return Gate(found, current, listed, ruled, covered, verdict.incidents(listed), counters.totals())

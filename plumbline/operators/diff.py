"""Differs: schema, governance and statistics of a current snapshot against a baseline.

The assets that both snapshots have are paired once, and so are their columns, with the profiles beside them; assets of one
side only are skipped. A finding kind is an expression over a pair's row, so that one pass over the asset pairs and one
over the column pairs give the findings of all kinds. A statistic that is missing on either side gives no
finding. All findings share one shape (FINDINGS) and come with the order in which an asset's findings are listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.functions.kinds import SENSITIVE_TAGS
from plumbline.operators.policy import Thresholds
from plumbline.operators.snapshot import Snapshot

FINDINGS = (
    "model_urn", "kind", "subject_urn", "subject_column", "affected_feature_urn", "on_feature_path", "features",
    "summary", "evidence", "family_ord", "ord", "kind_ord",
)
_KEYS = ["model_urn", "urn"]
_COLUMN = ["model_urn", "urn", "path"]


def _prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keys))


#: Where a summary names the features that its subject feeds; the last step fills it in.
FEEDS = "\x00"


def _finding(met: Column, kind: str, summary: Column, evidence: dict[str, Column], family: int, kind_ord: int, column: str | None = "path", order: Column | None = None) -> Column:
    """The finding of one kind on a pair's row, null where the condition is not met."""
    entries = [x for name, value in evidence.items() for x in (F.lit(name), value.cast("string"))]
    row = F.struct(
        F.lit(kind).alias("kind"),
        (F.col(column) if column else F.lit(None).cast("string")).alias("subject_column"),
        summary.alias("summary"),
        F.create_map(*entries).alias("evidence"),
        F.lit(family).alias("family_ord"),
        (order if order is not None else F.lit(0)).cast("int").alias("ord"),
        F.lit(kind_ord).alias("kind_ord"),
    )
    return F.when(met, row)


def _found(pairs: DataFrame, one: list[Column], many: list[Column] | None = None) -> DataFrame:
    """The findings of all kinds on each row: ``one`` has a finding at most each, ``many`` are arrays of them."""
    rows = [F.filter(F.array(*one), lambda x: x.isNotNull())] if one else []
    rows = F.concat(*rows, *many) if many else rows[0]
    return pairs.select("model_urn", F.col("urn").alias("subject_urn"), F.inline(rows))


def finished(found: DataFrame, current: Snapshot) -> DataFrame:
    """Findings with the features that their subjects feed, by the current snapshot: FINDINGS.

    Where an asset has column features, a column without an entry feeds none; where it has none at
    all, the asset's own features count. Findings on assets use the asset's own. One set of joins
    serves all kinds.
    """
    keys = ["model_urn", "subject_urn"]
    named = lambda df, *more: df.select("model_urn", F.col("urn").alias("subject_urn"), *more)
    own = named(current.assets, F.array_sort("feeds_features").alias("asset_feeds"))
    mapped = named(current.col_features).distinct().withColumn("column_level", F.lit(True))
    of_column = named(current.col_features, F.col("path").alias("subject_column"), F.array_sort("features").alias("column_feeds"))
    df = found.join(own, keys, "left").join(mapped, keys, "left").join(of_column, [*keys, "subject_column"], "left")
    level = F.coalesce("column_level", F.lit(False))
    feeds = F.when(F.col("subject_column").isNotNull() & level, F.col("column_feeds")).otherwise(F.col("asset_feeds"))
    df = df.withColumn("feeds", F.coalesce(feeds, F.array().cast("array<string>")))
    count = F.size("feeds")
    clause = (
        F.when(count == 0, "")
        .when(count == 1, F.concat(F.lit(", which feeds "), X.finding_name(F.element_at("feeds", 1))))
        .otherwise(F.concat(F.lit(", which feeds "), count.cast("string"), F.lit(" live features")))
    )
    shared = F.create_map(F.lit("on_feature_path"), (count > 0).cast("string"), F.lit("features"), F.nullif(F.array_join("feeds", ", "), F.lit("")))
    lineage = F.create_map(F.lit("column_level_lineage"), level.cast("string"))
    evidence = F.when(F.col("family_ord") == 0, F.map_concat(shared, lineage, "evidence")).otherwise(F.map_concat(shared, "evidence"))
    out = df.select(
        "model_urn",
        "kind",
        "subject_urn",
        "subject_column",
        F.array_min("feeds").alias("affected_feature_urn"),
        (count > 0).alias("on_feature_path"),
        F.nullif(F.array_join("feeds", ","), F.lit("")).alias("features"),
        F.replace("summary", F.lit(FEEDS), clause).alias("summary"),
        evidence.alias("evidence"),
        "family_ord",
        "ord",
        "kind_ord",
    )
    return out.select(*FINDINGS)


def shared_assets(baseline: Snapshot, current: Snapshot) -> DataFrame:
    """The assets of both snapshots, with old_ and new_ attributes."""
    return _prefixed(baseline.assets, "old_", _KEYS).join(_prefixed(current.assets, "new_", _KEYS), _KEYS)


def column_pairs(baseline: Snapshot, current: Snapshot) -> DataFrame:
    """Columns that both sides of a shared asset have, with old_ and new_ attributes."""
    return _prefixed(baseline.columns, "old_", _COLUMN).join(_prefixed(current.columns, "new_", _COLUMN), _COLUMN)


def compared_columns(baseline: Snapshot, current: Snapshot) -> DataFrame:
    """Every column of a shared asset once: its attributes and profile of either side, and its asset's.

    ``had`` and ``has`` say on which sides the column is, ``measured`` that both sides have a profile to compare.
    """
    here = F.lit(True)
    both = _prefixed(baseline.columns, "old_", _COLUMN).withColumn("had", here).join(_prefixed(current.columns, "new_", _COLUMN).withColumn("has", here), _COLUMN, "full")
    asset = shared_assets(baseline, current)
    out = both.join(asset.select(*_KEYS, "new_entity_type", "old_profiled", "new_profiled", "old_row_count", "new_row_count"), _KEYS)
    for side, of in (("old", baseline), ("new", current)):
        out = out.join(_prefixed(of.profiles, f"{side}_", _COLUMN).withColumn(f"{side}_measured", here), _COLUMN, "left")
    for side in ("old", "new"):
        for s in ("min", "max", "mean", "stdev"):
            out = out.withColumn(f"{side}_{s}", X.finite(F.col(f"{side}_{s}")))
        out = out.withColumn(f"{side}_rate", X.null_rate(*(F.col(f"{side}_{c}") for c in ("null_proportion", "null_count", "row_count"))))
    sides = [F.coalesce(F.col(c), F.lit(False)) for c in ("had", "has", "old_measured", "new_measured", "old_profiled", "new_profiled")]
    return out.withColumns({"had": sides[0], "has": sides[1], "measured": reduce(Column.__and__, sides)})


# -- schema -------------------------------------------------------------------


def _dropped_column() -> Column:
    text = F.concat(F.lit("Column `"), "path", F.lit("` was dropped from "), X.finding_name(F.col("urn")), F.lit(FEEDS))
    evidence = {"column": F.col("path"), "data_type": F.col("old_data_type"), "native_type": F.col("old_native_type")}
    return _finding(F.col("had") & ~F.col("has"), "COLUMN_DROPPED", text, evidence, 0, 0, order=F.col("old_ord"))


def _added_column() -> Column:
    text = F.concat(F.lit("Column `"), "path", F.lit("` was added to "), X.finding_name(F.col("urn")))
    evidence = {"column": F.col("path"), "data_type": F.col("new_data_type"), "native_type": F.col("new_native_type")}
    return _finding(F.col("has") & ~F.col("had"), "COLUMN_ADDED", text, evidence, 0, 1, order=F.col("new_ord"))


def _changed_type() -> Column:
    fits = X.lossless_change(*(F.col(c) for c in ("old_data_type", "old_native_type", "new_data_type", "new_native_type")))
    respelled = ~F.col("old_data_type").eqNullSafe(F.col("new_data_type")) | ~F.col("old_native_type").eqNullSafe(F.col("new_native_type"))
    shown = lambda side: F.coalesce(F.nullif(F.col(f"{side}_native_type"), F.lit("")), F.col(f"{side}_data_type"))
    text = F.concat(
        F.lit("Column `"), "path", F.lit("` on "), X.finding_name(F.col("urn")), F.lit(" changed type "), shown("old"), F.lit(" → "), shown("new"),
        F.lit("; not all old values fit"), F.lit(FEEDS),
    )
    evidence = {"column": F.col("path")}
    evidence |= {c: F.col(c) for c in ("old_data_type", "new_data_type", "old_native_type", "new_native_type")} | {"compatible": F.lit(False)}
    return _finding(F.col("had") & F.col("has") & respelled & ~fits, "COLUMN_TYPE_CHANGED", text, evidence, 0, 2, order=F.col("new_ord"))


def _relaxed_nullability() -> Column:
    met = F.col("had") & F.col("has") & F.col("new_nullable") & ~F.col("old_nullable")
    text = F.concat(F.lit("Column `"), "path", F.lit("` on "), X.finding_name(F.col("urn")), F.lit(" may hold nulls now"), F.lit(FEEDS))
    evidence = {"column": F.col("path"), "old_nullable": F.lit(False), "new_nullable": F.lit(True)}
    return _finding(met, "COLUMN_NULLABILITY_RELAXED", text, evidence, 0, 2, order=F.col("new_ord"))


def _schema_kinds() -> list[Column]:
    return [_dropped_column(), _added_column(), _changed_type(), _relaxed_nullability()]


# -- governance ---------------------------------------------------------------


def _newly_deprecated() -> Column:
    note = F.nullif(F.col("new_deprecation_note"), F.lit(""))
    text = F.concat(
        X.entity_label(F.col("new_entity_type")), F.lit(" "), X.finding_name(F.col("urn")), F.lit(" is deprecated now"), F.lit(FEEDS),
        F.coalesce(F.concat(F.lit(" — "), note), F.lit("")),
    )
    evidence = {"entity_type": F.col("new_entity_type"), "was_deprecated": F.lit(False), "is_deprecated": F.lit(True), "note": F.col("new_deprecation_note")}
    return _finding(F.col("new_deprecated") & ~F.col("old_deprecated"), "ASSET_DEPRECATED", text, evidence, 1, 0, None)


def _lost_owner() -> Column:
    text = F.concat(
        X.entity_label(F.col("new_entity_type")), F.lit(" "), X.finding_name(F.col("urn")), F.lit(" has no owner any more"), F.lit(FEEDS),
    )
    evidence = {
        "entity_type": F.col("new_entity_type"),
        "previous_owners": F.array_join(F.array_sort("old_owners"), ", "),
        "previous_owner_count": F.size("old_owners"),
        "current_owner_count": F.lit(0),
    }
    return _finding((F.size("old_owners") > 0) & (F.size("new_owners") == 0), "OWNERSHIP_LOST", text, evidence, 1, 1, None)


def _sensitive_tags(column: str | None, sensitive: tuple[str, ...], kind_ord: int) -> Column:
    """A finding for each of ``new_tags`` whose normalised name is new and sensitive; an array."""
    names = [t.strip().lower() for t in sensitive]
    known = F.transform("old_tags", lambda t: X.tag_name(t))
    place = X.finding_name(F.col("urn"))
    where = F.concat(F.lit("`"), F.col(column), F.lit("` on "), place) if column else place

    def finding(tag: Column, i: Column) -> Column:
        met = ~F.array_contains(known, X.tag_name(tag)) & X.tag_name(tag).isin(*names)
        text = F.concat(F.lit("Sensitive tag "), X.finding_name(tag), F.lit(" is new on "), where, F.lit(FEEDS))
        evidence = {"entity_type": F.col("new_entity_type"), "tag": X.finding_name(tag), "tag_urn": tag}
        if column:
            evidence["column"] = F.col(column)
        return _finding(met, "NEW_SENSITIVE_TAG", text, evidence, 1, kind_ord, column, F.col("new_ord") * 1000 + i if column else i)

    tags = F.coalesce("new_tags", F.array().cast("array<string>"))
    if column:
        tags = F.filter(tags, lambda t: F.col("had") & F.col("has"))
    return F.filter(F.transform(tags, finding), lambda x: x.isNotNull())


# -- statistics ---------------------------------------------------------------


def profile_pairs(baseline: Snapshot, current: Snapshot) -> DataFrame:
    """Common columns with a profile on both sides, with numbers parsed and row counts attached."""
    return compared_columns(baseline, current).filter("measured")


def _percent(change: Column) -> Column:
    return F.format_string("%+.0f%%", change)


def _grouped(count: Column) -> Column:
    return F.format_number(count, 0)


def _null_rate_jump(limits: Thresholds) -> Column:
    jump = (F.col("new_rate") - F.col("old_rate")) * 100.0
    share = lambda c: F.format_string("%.1f%%", F.col(c) * 100.0)
    text = F.concat(
        F.lit("Null rate on `"), "path", F.lit("` rose "), share("old_rate"), F.lit(" → "), share("new_rate"),
        F.format_string(" (%+.1fpp) in ", jump), X.finding_name(F.col("urn")),
    )
    evidence = {
        "column": F.col("path"),
        "old_null_proportion": F.round("old_rate", 6),
        "new_null_proportion": F.round("new_rate", 6),
        "jump_pp": F.round(jump, 3),
        "threshold_pp": F.lit(limits.null_rate_jump_pp),
        "old_null_count": F.col("old_null_count"),
        "new_null_count": F.col("new_null_count"),
    }
    return _finding(F.col("measured") & (jump > limits.null_rate_jump_pp), "NULL_RATE_JUMP", text, evidence, 2, 1, order=F.col("old_ord"))


def _cardinality_change(limits: Thresholds) -> Column:
    change = X.relative_change(F.col("old_unique_count").cast("double"), F.col("new_unique_count").cast("double")) * 100.0
    way = F.when(change < 0, "collapsed").otherwise("exploded")
    text = F.concat(
        F.lit("Cardinality of `"), "path", F.lit("` "), way, F.lit(" "), _grouped(F.col("old_unique_count")), F.lit(" → "), _grouped(F.col("new_unique_count")),
        F.lit(" ("), _percent(change), F.lit(") in "), X.finding_name(F.col("urn")),
    )
    evidence = {
        "column": F.col("path"),
        "old_unique_count": F.col("old_unique_count"),
        "new_unique_count": F.col("new_unique_count"),
        "change_pct": F.round(change, 2),
        "threshold_pct": F.lit(limits.cardinality_change_pct),
        "direction": way,
    }
    return _finding(F.col("measured") & (F.abs(change) > limits.cardinality_change_pct), "CARDINALITY_CHANGE", text, evidence, 2, 2, order=F.col("old_ord"))


def _mean_shift(limits: Thresholds) -> Column:
    """Shifts of the mean in standard deviations of the baseline; a constant baseline has none, and any shift counts."""
    delta = F.col("new_mean") - F.col("old_mean")
    constant = F.col("old_stdev") <= 0
    sigma = F.when(~constant, F.try_divide(delta, F.col("old_stdev")))
    moved = F.when(constant, delta != 0).otherwise(F.abs(sigma) > limits.mean_shift_sigma)
    size = F.coalesce(F.format_string("%+.1fσ", sigma), F.lit(""))
    size = F.when(sigma.isNull(), "the baseline was constant").otherwise(size)
    text = F.concat(
        F.lit("Mean of `"), "path", F.lit("` moved "), X.plain(F.col("old_mean")), F.lit(" → "), X.plain(F.col("new_mean")), F.lit(" ("), size,
        F.lit(") in "), X.finding_name(F.col("urn")),
    )
    evidence = {c: F.col(c) for c in ("old_mean", "new_mean", "old_stdev", "new_stdev")}
    evidence |= {"column": F.col("path"), "sigma": F.round(sigma, 3), "threshold_sigma": F.lit(limits.mean_shift_sigma)}
    return _finding(F.col("measured") & moved, "MEAN_SHIFT", text, evidence, 2, 3, order=F.col("old_ord"))


def _range_violation() -> Column:
    """New bounds outside the baseline's; needs both old bounds, and each new one by itself."""
    known = F.col("old_min").isNotNull() & F.col("old_max").isNotNull()
    low = F.when(F.col("new_min") < F.col("old_min"), F.col("old_min") - F.col("new_min"))
    high = F.when(F.col("new_max") > F.col("old_max"), F.col("new_max") - F.col("old_max"))
    moved = lambda s: F.concat(F.lit(f"{s} "), X.plain(F.col(f"old_{s}")), F.lit(" → "), X.plain(F.col(f"new_{s}")))
    breaches = F.concat_ws(", ", F.when(low.isNotNull(), moved("min")), F.when(high.isNotNull(), moved("max")))
    text = F.concat(F.lit("Values of `"), "path", F.lit("` in "), X.finding_name(F.col("urn")), F.lit(" are outside the baseline: "), breaches)
    evidence = {
        "column": F.col("path"),
        "baseline_min": F.col("old_min"),
        "baseline_max": F.col("old_max"),
        "new_min": F.col("new_min"),
        "new_max": F.col("new_max"),
        "min_breach": F.round(low, 6),
        "max_breach": F.round(high, 6),
    }
    return _finding(F.col("measured") & known & (low.isNotNull() | high.isNotNull()), "RANGE_VIOLATION", text, evidence, 2, 4, order=F.col("old_ord"))


def _row_count_change(limits: Thresholds) -> Column:
    change = X.relative_change(F.col("old_row_count").cast("double"), F.col("new_row_count").cast("double")) * 100.0
    way = F.when(change < 0, "dropped").otherwise("grew")
    text = F.concat(
        F.lit("Row count of "), X.finding_name(F.col("urn")), F.lit(" "), way, F.lit(" "), _grouped(F.col("old_row_count")), F.lit(" → "),
        _grouped(F.col("new_row_count")), F.lit(" ("), _percent(change), F.lit(")"),
    )
    evidence = {
        "old_row_count": F.col("old_row_count"),
        "new_row_count": F.col("new_row_count"),
        "change_pct": F.round(change, 2),
        "threshold_pct": F.lit(limits.row_count_change_pct),
        "direction": way,
    }
    return _finding(F.col("old_profiled") & F.col("new_profiled") & (F.abs(change) > limits.row_count_change_pct), "ROW_COUNT_CHANGE", text, evidence, 2, 0, None)


def _statistics_kinds(limits: Thresholds) -> list[Column]:
    return [_null_rate_jump(limits), _cardinality_change(limits), _mean_shift(limits), _range_violation()]


# -- the differs as they are called -------------------------------------------


def _of_columns(baseline: Snapshot, current: Snapshot, *kinds: Column) -> DataFrame:
    return finished(_found(compared_columns(baseline, current), list(kinds)), current)


def _of_assets(baseline: Snapshot, current: Snapshot, *kinds: Column) -> DataFrame:
    return finished(_found(shared_assets(baseline, current), list(kinds)), current)


def dropped_columns(baseline: Snapshot, current: Snapshot) -> DataFrame:
    return _of_columns(baseline, current, _dropped_column())


def added_columns(baseline: Snapshot, current: Snapshot) -> DataFrame:
    return _of_columns(baseline, current, _added_column())


def changed_types(baseline: Snapshot, current: Snapshot) -> DataFrame:
    return _of_columns(baseline, current, _changed_type())


def relaxed_nullability(baseline: Snapshot, current: Snapshot) -> DataFrame:
    return _of_columns(baseline, current, _relaxed_nullability())


def newly_deprecated(baseline: Snapshot, current: Snapshot) -> DataFrame:
    return _of_assets(baseline, current, _newly_deprecated())


def lost_owners(baseline: Snapshot, current: Snapshot) -> DataFrame:
    return _of_assets(baseline, current, _lost_owner())


def _tags(baseline: Snapshot, current: Snapshot, sensitive: tuple[str, ...]) -> DataFrame:
    assets = _found(shared_assets(baseline, current), [], [_sensitive_tags(None, sensitive, 2)])
    return assets.unionByName(_found(compared_columns(baseline, current), [], [_sensitive_tags("path", sensitive, 3)]))


def new_sensitive_tags(baseline: Snapshot, current: Snapshot, sensitive: tuple[str, ...] = SENSITIVE_TAGS) -> DataFrame:
    """Sensitive tags that appeared on shared assets and on their common columns."""
    return finished(_tags(baseline, current, sensitive), current)


def null_rate_jumps(pairs: DataFrame, current: Snapshot, limits: Thresholds) -> DataFrame:
    return finished(_found(pairs, [_null_rate_jump(limits)]), current)


def cardinality_changes(pairs: DataFrame, current: Snapshot, limits: Thresholds) -> DataFrame:
    return finished(_found(pairs, [_cardinality_change(limits)]), current)


def mean_shifts(pairs: DataFrame, current: Snapshot, limits: Thresholds) -> DataFrame:
    return finished(_found(pairs, [_mean_shift(limits)]), current)


def range_violations(pairs: DataFrame, current: Snapshot) -> DataFrame:
    return finished(_found(pairs, [_range_violation()]), current)


def row_count_changes(baseline: Snapshot, current: Snapshot, limits: Thresholds) -> DataFrame:
    return _of_assets(baseline, current, _row_count_change(limits))


def diff_schema(baseline: Snapshot, current: Snapshot) -> DataFrame:
    """Dropped, added, retyped and newly nullable columns."""
    return _of_columns(baseline, current, *_schema_kinds())


def diff_governance(baseline: Snapshot, current: Snapshot, sensitive: tuple[str, ...] = SENSITIVE_TAGS) -> DataFrame:
    """New deprecations, lost owners and new sensitive tags."""
    assets = _found(shared_assets(baseline, current), [_newly_deprecated(), _lost_owner()])
    return finished(assets.unionByName(_tags(baseline, current, sensitive)), current)


def diff_statistics(baseline: Snapshot, current: Snapshot, limits: Thresholds | None = None) -> DataFrame:
    """Changes of volume, null rate, cardinality, mean and range."""
    limits = limits or Thresholds()
    assets = _found(shared_assets(baseline, current), [_row_count_change(limits)])
    return finished(assets.unionByName(_found(compared_columns(baseline, current), _statistics_kinds(limits))), current)


def missing_baselines(models: DataFrame, baseline: Snapshot, current: Snapshot) -> DataFrame:
    """One finding for each model (model_urn) of which the baseline has no asset."""
    bare = models.select("model_urn").distinct().join(baseline.assets.select("model_urn"), "model_urn", "left_anti")
    text = F.concat(F.lit("No approved baseline exists for "), X.finding_name(F.col("urn")))
    found = _finding(F.lit(True), "OWNERSHIP_LOST", text, {"missing_baseline": F.lit(True)}, 1, 0, None)
    return finished(_found(bare.withColumn("urn", F.col("model_urn")), [found]), current)


def diff_all(baseline: Snapshot, current: Snapshot, limits: Thresholds | None = None, sensitive: tuple[str, ...] = SENSITIVE_TAGS) -> DataFrame:
    """All differs, schema first, then governance, then statistics: one pass over the asset pairs, one over the column pairs."""
    limits = limits or Thresholds()
    of_asset = [_newly_deprecated(), _lost_owner(), _row_count_change(limits)]
    assets = _found(shared_assets(baseline, current), of_asset, [_sensitive_tags(None, sensitive, 2)])
    columns = _found(compared_columns(baseline, current), [*_schema_kinds(), *_statistics_kinds(limits)], [_sensitive_tags("path", sensitive, 3)])
    return finished(assets.unionByName(columns), current)

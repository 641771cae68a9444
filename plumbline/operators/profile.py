"""Profiling of tables, the latest profile of each asset, and the coverage of a comparison.

Statistics follow the snapshot's shape: counts are numbers, minimum, maximum, mean and standard
deviation are text. The standard deviation is that of a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("null_count", "null_proportion", "unique_count", "unique_proportion", "min", "max", "mean", "stdev")
COMPARABLE = ("null_proportion", "unique_count", "mean", "min", "max")


def same(low: Column, high: Column) -> Column:
    """Whether values between these two are all one finite number."""
    return (low == high) & (F.abs(low.cast("double")) < float("inf"))


def profile(df: DataFrame, keys: list[str], columns: list[str], approximate: bool = False) -> DataFrame:
    """A row per key and column: row_count, the statistics, and path.

    One aggregation over the table for all columns together, then an unpivot of its one row per
    key. ``approximate`` counts distinct values by a sketch, whose partial states stay small. Where all values are the same
    number, that number is their mean and 0 their deviation, without what adding up partial states rounds.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    numeric = {name for name, kind in kinds.items() if kind in {"byte", "short", "integer", "long", "float", "double", "decimal"}}
    aggregates: list[Column] = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(columns):
        col = F.col(c)
        if c in numeric:
            constant, mean = same(F.min(col), F.max(col)), F.avg(col)
            # The average of decimals is exact.
            mean = mean if kinds[c] == "decimal" else F.when(constant, F.min(col).cast("double")).otherwise(mean)
            stdev = F.when(constant & (F.count(col) > 1), 0.0).otherwise(F.stddev_samp(col))
        aggregates += [
            F.count_if(col.isNull()).alias(f"null_count_{i}"),
            distinct(col).alias(f"unique_count_{i}"),
            F.min(col).cast("string").alias(f"min_{i}"),
            F.max(col).cast("string").alias(f"max_{i}"),
            (mean.cast("string") if c in numeric else F.lit(None).cast("string")).alias(f"mean_{i}"),
            (stdev.cast("string") if c in numeric else F.lit(None).cast("string")).alias(f"stdev_{i}"),
        ]
    wide = df.groupBy(*keys).agg(*aggregates)
    rows = F.col("row_count")
    entries = F.array(
        *(
            F.struct(
                F.lit(c).alias("path"),
                F.col(f"null_count_{i}").alias("null_count"),
                F.try_divide(F.col(f"null_count_{i}"), rows).alias("null_proportion"),
                F.col(f"unique_count_{i}").alias("unique_count"),
                F.try_divide(F.col(f"unique_count_{i}"), rows - F.col(f"null_count_{i}")).alias("unique_proportion"),
                *(F.col(f"{s}_{i}").alias(s) for s in ("min", "max", "mean", "stdev")),
            )
            for i, c in enumerate(columns)
        )
    )
    return wide.select(*keys, "row_count", F.inline(entries))


def latest(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key; ties go to the largest row in column order."""
    rest = [c for c in events.columns if c not in keys]
    newest = events.groupBy(*keys).agg(F.max(F.struct(at, *(c for c in rest if c != at))).alias("newest"))
    return newest.select(*keys, *(F.col("newest")[c].alias(c) for c in rest))


def coverage(common_columns: DataFrame, old: DataFrame, new: DataFrame, shared_assets: DataFrame) -> DataFrame:
    """Per model: how much of the comparison had statistics on both sides.

    ``common_columns``: (model_urn, urn, path); ``old``, ``new``: profiles by the same keys;
    ``shared_assets``: (model_urn, urn, old_profiled, new_profiled).
    """
    keys = ["model_urn", "urn", "path"]
    named = lambda df, side: df.select(*keys, *(F.col(s).alias(f"{side}_{s}") for s in COMPARABLE))
    matched = common_columns.select(*keys).join(named(old, "old"), keys, "left").join(named(new, "new"), keys, "left")
    comparable = F.lit(False)
    for s in COMPARABLE:
        comparable = comparable | (F.col(f"old_{s}").isNotNull() & F.col(f"new_{s}").isNotNull())
    by_column = matched.groupBy("model_urn").agg(F.count(F.lit(1)).alias("columns_total"), F.count_if(comparable).alias("columns_compared"))
    by_asset = shared_assets.groupBy("model_urn").agg(
        F.count(F.lit(1)).alias("assets_total"), F.count_if(F.col("old_profiled") & F.col("new_profiled")).alias("assets_profiled")
    )
    out = by_asset.join(by_column, "model_urn", "full")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("columns_total", "columns_compared", "assets_total", "assets_profiled")]
    return out.select("model_urn", *counts).select(
        "*",
        F.coalesce(F.try_divide("columns_compared", "columns_total"), F.lit(0.0)).alias("ratio"),
        (F.col("columns_compared") == 0).alias("is_blind"),
    )

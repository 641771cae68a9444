"""Profiles as mergeable states, so that those of partitions, days and sources add up without their rows.

A state is a row per key and column: counts, extremes, the mean with its sum of squared deviations, a HyperLogLog sketch of
the distinct values and, of numbers, a KLL sketch of their distribution. States of the same columns merge
in any order and grouping; what a sketch loses is bounded by its size, everything else is exact (means and
deviations to rounding). No value is kept or expanded, so a table is read once for all columns with partial
states of a few kilobytes.

Defined results: nulls count in null_count only, an infinite or undefined number in no mean; a column of nulls has no extremes, mean or
quantiles and 0 distinct values; an empty table has no states; merging nothing gives nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.profile import same

WHOLE = {"byte", "short", "integer", "long"}
NUMBERS = WHOLE | {"float", "double", "decimal"}

#: Logarithm of the registers of a distinct count, and the largest relative error to reckon with: three standard ones.
LG_K, DISTINCT_ERROR = 12, 3 * 1.04 / 64

#: Size of a distribution sketch, and the largest error of a rank to reckon with, as a share of the values.
KLL_K, RANK_ERROR = 200, 0.0266

#: Shares of the quantiles that a profile has unless others are asked for.
QUARTILES = (0.25, 0.5, 0.75)

#: Columns of a state besides its keys.
STATE = ("path", "row_count", "null_count", "measured", "mean", "m2", "low", "high", "distinct", "spread")


def sketch(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """States of the columns by key: ``keys`` and STATE, from one aggregation over the rows."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    # Each value is turned into text once, for its extremes and its sketch alike.
    values = df.select(*keys, *(x for i, c in enumerate(columns) for x in (F.col(c).alias(f"value_{i}"), F.col(c).cast("string").alias(f"text_{i}"))))
    aggregates: list[Column] = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(columns):
        col, text = F.col(f"value_{i}"), F.col(f"text_{i}")
        extreme = F.when(col.isNotNull(), F.struct((col.cast("double") if kinds[c] in NUMBERS else F.lit(None).cast("double")).alias("value"), text.alias("text")))
        if kinds[c] in WHOLE:
            low, high = (F.when(m.isNotNull(), F.struct(m.cast("double").alias("value"), m.cast("string").alias("text"))) for m in (F.min(col), F.max(col)))
        else:
            low, high = F.min(extreme), F.max(extreme)
        aggregates += [
            F.count_if(col.isNull()).alias(f"null_count_{i}"),
            low.alias(f"low_{i}"),
            high.alias(f"high_{i}"),
            # The sketch leaves empty texts out, so each value gets a letter before it.
            F.hll_sketch_agg(F.concat(F.lit("v"), text), LG_K).alias(f"distinct_{i}"),
        ]
        if kinds[c] in NUMBERS:
            number = col.cast("double")
            if kinds[c] not in WHOLE:
                number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
            aggregates += [
                F.count(number).alias(f"measured_{i}"),
                F.avg(number).alias(f"mean_{i}"),
                (F.var_pop(number) * F.count(number)).alias(f"m2_{i}"),
                F.kll_sketch_agg_double(number, KLL_K).alias(f"spread_{i}"),
            ]
    wide = values.groupBy(*keys).agg(*aggregates)
    none = {"measured": F.lit(0).cast("bigint"), "mean": F.lit(None).cast("double"), "m2": F.lit(None).cast("double"), "spread": F.lit(None).cast("binary")}
    entry = lambda i, c, name: F.col(f"{name}_{i}") if kinds[c] in NUMBERS or name not in none else none[name]
    entries = F.array(*(F.struct(F.lit(c).alias("path"), *(entry(i, c, name).alias(name) for name in STATE if name not in ("path", "row_count"))) for i, c in enumerate(columns)))
    return wide.select(*keys, "row_count", F.inline(entries)).select(*keys, *STATE)


def merge(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state for each of the (coarser) ``keys`` and column, from states of parts.

    The deviation from the common mean needs that mean first, so states are read twice: cut those that are not written yet, or
    their rows are.
    """
    by = [*keys, "path"]
    own = F.col("measured") * F.col("mean")
    means = states.groupBy(*by).agg(F.try_divide(F.sum(own), F.sum("measured")).alias("mean"), F.count(F.lit(1)).alias("parts"))
    renamed = means.select(*(F.col(c).alias(f"{c}_of") for c in by), F.col("mean").alias("mean_of"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by))
    away = F.col("mean") - F.col("mean_of")
    return (
        states.join(renamed, same)
        .groupBy(*by)
        .agg(
            F.sum("row_count").alias("row_count"),
            F.sum("null_count").alias("null_count"),
            F.sum("measured").alias("measured"),
            F.first("mean_of", ignorenulls=True).alias("mean"),
            F.sum(F.col("m2") + F.col("measured") * away * away).alias("m2"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.hll_union_agg("distinct").alias("distinct"),
            F.kll_merge_agg_double("spread", KLL_K).alias("spread"),
        )
        .select(*keys, *STATE)
    )


def finish(states: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUARTILES) -> DataFrame:
    """Profiles in the shape of ``profile.profile``, with ``quantiles`` (a map from share to value) of numbers.

    unique_count is the sketch's estimate, never above the number of values that are not null.
    """
    filled = F.col("row_count") - F.col("null_count")
    unique = F.least(F.hll_sketch_estimate("distinct"), filled)
    number = F.col("measured") > 0
    # Rounding of merged states is no deviation: where all values are one number, that is the mean.
    constant = number & same(F.col("low.value"), F.col("high.value"))
    stdev = F.when(constant, 0.0).otherwise(F.sqrt(F.col("m2") / (F.col("measured") - 1)))
    at = F.create_map(*(x for q in quantiles for x in (F.lit(q), F.kll_sketch_get_quantile_double("spread", F.lit(q)))))
    return states.select(
        *keys,
        "row_count",
        "path",
        "null_count",
        F.try_divide("null_count", "row_count").alias("null_proportion"),
        unique.alias("unique_count"),
        F.try_divide(unique, filled).alias("unique_proportion"),
        F.col("low.text").alias("min"),
        F.col("high.text").alias("max"),
        F.when(constant, F.col("low.value")).otherwise(F.col("mean")).cast("string").alias("mean"),
        F.when(F.col("measured") > 1, stdev).cast("string").alias("stdev"),
        F.when(number, at).alias("quantiles"),
    )


def put(states: DataFrame, path: str, part: str) -> None:
    """Stores the states of one part, a day or a load; putting a part again replaces it."""
    states.write.mode("overwrite").parquet(f"{path}/part={part}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored states of all parts, with the column part."""
    return spark.read.option("inferSchema", False).parquet(path).withColumn("part", F.col("part").cast("string"))

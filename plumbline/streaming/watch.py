"""A drift watch on a stream: windowed profiles against a baseline, ruled like any other findings.

An extension: the batch gate has no streaming side. Windows close behind a watermark; each batch of
closed windows joins the static baseline and appends its findings.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions import exprs as X
from plumbline.operators.policy import Policy, Thresholds
from plumbline.operators.profile import same


def windowed_profile(events: DataFrame, at: str, key: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """A row per window and key: row_count, null_count, low, high, mean, stdev. Works on batch and stream alike."""
    timed = events.withColumn("at_", F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at_", late)
    grouped = timed.groupBy(F.window("at_", window).alias("w"), F.col(key).alias("asset"))
    constant = same(F.min(value), F.max(value))
    stats = grouped.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(value).isNull()).alias("null_count"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.when(constant, F.min(value)).otherwise(F.avg(value)).alias("mean"),
        F.when(constant & (F.count(value) > 1), 0.0).otherwise(F.stddev_samp(value)).alias("stdev"),
    )
    return stats.select(F.col("w.start").alias("window_start"), "asset", "row_count", "null_count", "low", "high", "mean", "stdev")


def drift(profiles: DataFrame, baseline: DataFrame, limits: Thresholds | None = None) -> DataFrame:
    """Findings of windows against a baseline (asset, base_rows, base_low, base_high, base_mean, base_stdev, base_null_rate).

    ``base_rows`` are rows per window. One row per finding: window_start, asset, kind, magnitude.
    """
    return drifted(profiles.join(baseline, "asset"), limits)


def drifted(joined: DataFrame, limits: Thresholds | None = None) -> DataFrame:
    """The findings of ``drift`` over profiles that stand beside their baseline's columns."""
    limits = limits or Thresholds()
    volume = X.relative_change(F.col("base_rows"), F.col("row_count").cast("double")) * 100
    sigma = F.when(F.col("base_stdev") > 0, (F.col("mean") - F.col("base_mean")) / F.col("base_stdev"))
    jump = (X.null_rate(F.lit(None).cast("double"), F.col("null_count"), F.col("row_count")) - F.col("base_null_rate")) * 100
    beyond = F.greatest(F.col("base_low") - F.col("low"), F.col("high") - F.col("base_high"))
    kinds = F.array(
        F.struct(F.lit("ROW_COUNT_CHANGE").alias("kind"), F.when(F.abs(volume) > limits.row_count_change_pct, volume).alias("magnitude")),
        F.struct(F.lit("NULL_RATE_JUMP").alias("kind"), F.when(jump > limits.null_rate_jump_pp, jump).alias("magnitude")),
        F.struct(F.lit("MEAN_SHIFT").alias("kind"), F.when(F.abs(sigma) > limits.mean_shift_sigma, sigma).alias("magnitude")),
        F.struct(F.lit("RANGE_VIOLATION").alias("kind"), F.when(beyond > 0, beyond).alias("magnitude")),
    )
    return joined.select("window_start", "asset", F.inline(kinds)).filter("magnitude is not null")


def watch(events: DataFrame, baseline: DataFrame, at: str, key: str, value: str, path: str, checkpoint: str, policy: Policy | None = None, now: datetime | None = None, window: str = "1 day") -> StreamingQuery:
    """Starts a watch that writes findings to Parquet as windows close, and stops when the input is used up.

    Each batch has a folder of its own (column epoch), which a replay of the batch after a failure writes
    again; ``now``, for exemptions, is the same for all batches.
    """
    from plumbline.operators.verdict import rule

    policy, now = policy or Policy(), now or datetime.now().astimezone()
    profiles = windowed_profile(events, at, key, value, window)

    def write(batch: DataFrame, epoch: int) -> None:
        found = drift(batch, baseline, policy.thresholds).withColumn("subject_urn", F.col("asset")).withColumn("subject_column", F.lit(value))
        rule(found, policy, now).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return profiles.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

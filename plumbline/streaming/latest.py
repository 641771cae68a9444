"""A drift watch with state: each window of an asset against the asset's window before.

The state has one row an asset, its latest closed profile, so it grows with the assets and not with the
events. Events are aggregated to windows first, by built-in functions with partial sums; only profiles, a row a
window and asset, meet the stateful operator, which does nothing but put the profile before beside each.

Defined results: an asset's first window has no findings; a null asset is an asset; a window without rows isn't
there, so the one before the gap stands beside the next; rows behind the watermark are left out, as their window
is closed; the stream's rows are those of the batch, as far as windows have closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.functions import exprs as X
from plumbline.operators import verdict
from plumbline.operators.policy import Policy
from plumbline.sources import sinks
from plumbline.streaming.watch import drifted, windowed_profile

#: A profile as the stream carries and keeps it.
PROFILE = "window_start timestamp, row_count bigint, null_count bigint, low double, high double, mean double, stdev double"
_KEPT = [c.split()[0] for c in PROFILE.split(", ")]
_PAIRED = f"asset string, {PROFILE}, " + ", ".join(f"last_{c}" for c in PROFILE.split(", "))

#: The store of state that ``transformWithState`` needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestProfile(StatefulProcessor):
    """Puts the asset's profile before beside each, in the order of windows, and keeps the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", PROFILE)
        self.paired = Row("asset", *_KEPT, *(f"last_{c}" for c in _KEPT))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = tuple(self.latest.get()) if self.latest.exists() else (None,) * len(_KEPT)
        # Windows that close in one batch: a few an asset.
        for profile in sorted((tuple(r[c] for c in _KEPT) for r in rows), key=lambda p: p[0]):
            yield self.paired(key[0], *profile, *before)
            before = profile
        self.latest.update(before)

    def close(self) -> None:
        pass


def successive(profiles: DataFrame) -> DataFrame:
    """Profiles of ``windowed_profile`` with those of the asset's window before as base_rows, base_low and so on, null for the first.

    A stream keeps the latest in state; a batch has them by a window function.
    """
    typed = profiles.select("asset", *(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in PROFILE.split(", ")))
    if profiles.isStreaming:
        paired = typed.groupBy("asset").transformWithState(LatestProfile(), _PAIRED, "Append", "None")
    else:
        order = Window.partitionBy("asset").orderBy("window_start")
        paired = typed.select("*", *(F.lag(c).over(order).alias(f"last_{c}") for c in _KEPT))
    base_rows = F.col("last_row_count").cast("double")
    return paired.select(
        "asset",
        *_KEPT,
        base_rows.alias("base_rows"),
        *(F.col(f"last_{c}").alias(f"base_{c}") for c in ("low", "high", "mean", "stdev")),
        (F.col("last_null_count") / base_rows).alias("base_null_rate"),
    )


def ruled_runs(paired: DataFrame, column: str, policy: Policy, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Ruled findings of ``successive``, and a verdict for each window of an asset, with or without findings.

    The key of a verdict, ``model_urn``, is the struct of asset and window_start. ``paired`` is read for both: write it out
    first (``cut``) where it comes from events.
    """
    key = F.struct("asset", "window_start").alias("model_urn")
    found = drifted(paired, policy.thresholds).withColumn("subject_urn", F.col("asset")).withColumn("subject_column", F.lit(column))
    ruled = verdict.rule(found, policy, now)
    return ruled, verdict.verdicts(paired.select(key), ruled.withColumn("model_urn", key))


def runs_of_windows(verdicts: DataFrame, scope: str = "watch") -> DataFrame:
    """Verdicts of ``ruled_runs`` as history events of the assets, each at its window's start."""
    at = verdicts.select(F.col("model_urn.asset").alias("model_urn"), F.col("model_urn.window_start").alias("window_start"), *(c for c in verdicts.columns if c != "model_urn"))
    return sinks.runs_from(at.withColumn("assets_checked", F.lit(1)), datetime.fromtimestamp(0).astimezone(), scope, F.unix_millis("window_start"))


def watch_latest(events: DataFrame, at: str, key: str, value: str, path: str, checkpoint: str, policy: Policy | None = None, now: datetime | None = None, window: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Starts a watch that writes ``findings`` and ``verdict_runs`` below ``path`` as windows close, and stops when the input is used up.

    Each batch has its own folder (column epoch) in both, which a replay after a failure writes again. The session's
    ``spark.sql.streaming.stateStore.providerClass`` must be STORE. The state lives in ``checkpoint``, a shared folder.
    """
    policy, now = policy or Policy(), now or datetime.now().astimezone()
    paired = successive(windowed_profile(events, at, key, value, window, late))

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            ruled, verdicts = ruled_runs(batch, value, policy, now)
            ruled.write.mode("overwrite").parquet(f"{path}/findings/epoch={epoch}")
            runs_of_windows(verdicts).write.mode("overwrite").parquet(f"{path}/verdict_runs/epoch={epoch}")
        finally:
            batch.unpersist()

    return paired.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

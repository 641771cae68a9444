"""Sinks: approved baselines, verdict history and the status of models.

Tables are Parquet. A baseline is written whole, as one version of its four tables, and becomes valid with its
entry in a log: until then, and if a write fails, the models keep their
old one; a table that has no rows for a model is empty in the new version. Properties are a log of patches that a read folds
together. A model's status is replaced by overwriting
its partition. Every write back is tried, and failures are reported together; to repeat one changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import exprs as X
from plumbline.functions.durable import cut
from plumbline.functions.kinds import BLOCK, CLEAR
from plumbline.operators.snapshot import ASSETS, COL_FEATURES, COLUMNS, PROFILES, Snapshot
from plumbline.sources import manifest

_TABLES = {"assets": ASSETS, "columns": COLUMNS, "profiles": PROFILES, "col_features": COL_FEATURES}

#: Properties of a model that a write back sets.
PROPERTIES = ("gate_severity", "gate_blocking", "gate_warning", "gate_checked_at")


class WriteError(RuntimeError):
    """Some writes failed: ``written`` went through, ``failures`` has the reasons."""

    def __init__(self, written: list[str], failures: dict[str, str]):
        super().__init__(f"written: {written}; failed: {failures}")
        self.written, self.failures = written, failures


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_urn").parquet(path)


def write_baseline(snapshot: Snapshot, path: str) -> None:
    """Makes the snapshot the approved baseline of its models; other models keep theirs.

    The version counts from its entry in the log. If another writer committed one meanwhile for any of the same models, this one is
    withdrawn and ConflictError raised; writers of different models don't disturb each other.
    """
    spark, version = snapshot.assets.sparkSession, uuid.uuid4().hex
    seen = manifest.last(spark, path)
    _write_version(snapshot, path, version)
    while True:
        try:
            manifest.append(spark, path, version, seen)
            return
        except manifest.ConflictError:
            since = [e for e in manifest.entries(spark, path) if e.sequence > seen]
            # Numbers that a checkpoint has made away with can't be told apart any more.
            known = since and since[0].sequence == seen + 1 and not any(e.checkpoint for e in since)
            if not known or _models(spark, path, [version]).join(_models(spark, path, [e.version for e in since]), "model_urn", "left_semi").limit(1).count():
                _remove_version(spark, path, version)
                raise
            seen = since[-1].sequence


def _write_version(snapshot: Snapshot, path: str, version: str) -> None:
    spark = snapshot.assets.sparkSession
    for name in _TABLES:
        getattr(snapshot, name).write.parquet(manifest.folder(f"{path}/{name}", version))
    written = spark.read.schema(_TABLES["assets"]).parquet(manifest.folder(f"{path}/assets", version))
    written.select("model_urn").distinct().write.parquet(manifest.folder(f"{path}/models", version))


def _remove_version(spark: SparkSession, path: str, version: str) -> None:
    for name in (*_TABLES, "models"):
        manifest.remove(spark, manifest.folder(f"{path}/{name}", version))


def _models(spark: SparkSession, path: str, versions: list[str]) -> DataFrame:
    return manifest.read(spark, f"{path}/models", "model_urn string, version string", versions).select("model_urn", "version")


def live_versions(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(model_urn, version) of each model's newest version, and those that any model has."""
    entries = manifest.entries(spark, path)
    if not entries:
        return spark.createDataFrame([], "model_urn string, version string"), []
    order = spark.createDataFrame([(e.version, e.sequence) for e in entries], "version string, sequence long")
    models = _models(spark, path, [e.version for e in entries]).join(F.broadcast(order), "version")
    newest = cut(models.groupBy("model_urn").agg(F.max_by("version", "sequence").alias("version")), "live")
    return newest, [r["version"] for r in newest.select("version").distinct().collect()]


def read_baseline(spark: SparkSession, path: str) -> Snapshot:
    """The approved baselines, each model's latest version; none where nothing was ever approved.

    Only folders of versions that some model still has are opened. Anything that keeps one from being read is an error: a
    baseline that cannot be read is not a missing one.
    """
    newest, versions = live_versions(spark, path)
    if not versions:
        return Snapshot.of(*(spark.createDataFrame([], t) for t in _TABLES.values()))

    def table(name):
        schema = T.StructType([*_TABLES[name], T.StructField("version", T.StringType())])
        rows = manifest.read(spark, f"{path}/{name}", schema, versions)
        return rows.join(newest, ["model_urn", "version"], "left_semi").select(_TABLES[name].names)

    return Snapshot.of(*map(table, _TABLES))


def compact_baseline(spark: SparkSession, path: str) -> list[str]:
    """Writes what counts as one version that stands for all before it, and removes those; their names.

    ConflictError, and nothing changed, if a version is committed meanwhile. Whoever was reading the old versions has to start again.
    """
    seen, entries, version = manifest.last(spark, path), manifest.entries(spark, path), uuid.uuid4().hex
    if not entries or entries[-1].sequence != seen:
        return []
    _write_version(read_baseline(spark, path), path, version)
    try:
        at = manifest.append(spark, path, version, seen, checkpoint=True)
    except manifest.ConflictError:
        _remove_version(spark, path, version)
        raise
    manifest.forget(spark, path, at)
    for e in entries:
        _remove_version(spark, path, e.version)
    return [e.version for e in entries]


def first_of(places: list[Snapshot]) -> Snapshot:
    """Each model's part from the first of the snapshots that has assets of it."""
    found, *others = places
    for more in others:
        known = found.assets.select("model_urn").distinct()
        found = Snapshot.of(*(getattr(found, n).unionByName(getattr(more, n).join(known, "model_urn", "left_anti")) for n in _TABLES))
    return found


def read_first_baseline(spark: SparkSession, paths: list[str]) -> Snapshot:
    """Each model's baseline from the first of several places that has one."""
    return first_of([read_baseline(spark, path) for path in paths])


def runs_from(verdicts: DataFrame, now: datetime, scope: str = "gate", at: Column | None = None) -> DataFrame:
    """Verdicts as history events (model_urn, assertion, run_id, millis, result, native), of the moment ``now`` or each of its own, ``at`` (milliseconds)."""
    millis = F.lit(int(now.timestamp() * 1000)) if at is None else at
    native = F.create_map(
        *(
            x
            for key, value in {
                "severity": F.col("severity"),
                "blocking_count": F.col("blocking").cast("string"),
                "warning_count": F.col("warning").cast("string"),
                "assets_checked": (F.col("assets_checked") if "assets_checked" in verdicts.columns else F.lit(0)).cast("string"),
                "warning_kinds": F.col("warning_kinds"),
            }.items()
            for x in (F.lit(key), value)
        )
    )
    return verdicts.filter("status <> 'ERROR'").select(
        "model_urn",
        X.assertion_id(F.col("model_urn"), scope).alias("assertion"),
        F.concat(F.lit("run-"), millis.cast("string"), F.lit("-"), F.substring(F.md5("model_urn"), 1, 8)).alias("run_id"),
        millis.cast("long").alias("millis"),
        F.when(F.col("severity") == BLOCK, "FAILURE").otherwise("SUCCESS").alias("result"),
        native.alias("native"),
    )


def root_dataset(ruled: DataFrame) -> DataFrame:
    """(model_urn, dataset): of the first finding's path the first dataset, else its subject."""
    dataset = F.get(F.filter("hops", lambda h: h["entity_type"] == "dataset"), F.lit(0))["urn"]
    return ruled.filter("place = 1").select("model_urn", F.coalesce(dataset, "subject_urn").alias("dataset"))


def write_back(verdicts: DataFrame, ruled: DataFrame, path: str, now: datetime, pr_url: str | None = None) -> list[str]:
    """Writes the runs, and replaces the status, tags and gate properties of the models; returns what was written.

    Runs are a folder per moment of the gate, so that a repeated write replaces its own; properties that other
    writers have set stay.
    """
    status = verdicts.select(
        "model_urn",
        "severity",
        "blocking",
        "warning",
        F.when(F.col("severity") == CLEAR, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("urn:li:tag:gate_"), F.lower("severity")))).alias("tags"),
        F.lit(now.isoformat()).alias("checked_at"),
        F.lit(pr_url).cast("string").alias("pr_url"),
    ).join(root_dataset(ruled), "model_urn", "left")
    define_properties(verdicts.sparkSession, path)
    values = [F.col("severity"), F.col("blocking").cast("string"), F.col("warning").cast("string"), F.lit(now.isoformat())]
    pairs = dict(zip(PROPERTIES, values, strict=True))
    changes = verdicts.select("model_urn", F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))).alias("properties"))
    steps: dict[str, Callable[[], None]] = {
        "verdict_runs": lambda: runs_from(verdicts, now).write.mode("overwrite").parquet(f"{path}/verdict_runs/moment={int(now.timestamp() * 1000)}"),
        "model_status": lambda: _replace(status, f"{path}/model_status"),
        "model_properties": lambda: patch_properties(changes, path),
    }
    written, failures = [], {}
    for name, step in steps.items():
        try:
            step()
            written.append(name)
        except Exception as e:  # one failed write must not lose the others; all are raised below
            failures[name] = str(e).splitlines()[0]
    if failures:
        raise WriteError(written, failures)
    return written


def define_properties(spark: SparkSession, path: str) -> bool:
    """Writes the definitions of the gate's properties unless they are there; whether they are now.

    Best effort: a failure here keeps no write back from being tried, which then reports its own.
    """
    rows = [(name, name.replace("_", " ").capitalize(), "string", "mlModel", "SINGLE") for name in PROPERTIES]
    defined = spark.createDataFrame(rows, "name string, display_name string, value_type string, entity_type string, cardinality string")
    try:
        defined.coalesce(1).write.mode("ignore").parquet(f"{path}/property_definitions")
    except Exception:  # whatever the place answers
        return False
    return True


def patch_properties(changes: DataFrame, path: str) -> None:
    """Appends changes (model_urn, properties) to the patch log of the models' properties; a null value unsets its name.

    Only the changes are written. Writers at the same time all keep their patches, in the order of the log.
    """
    spark, version = changes.sparkSession, uuid.uuid4().hex
    log = f"{path}/model_properties"
    changes.select("model_urn", "properties").write.parquet(manifest.folder(log, version))
    while True:
        try:
            manifest.append(spark, log, version, manifest.last(spark, log))
            return
        except manifest.ConflictError:
            continue


def properties(spark: SparkSession, path: str) -> DataFrame:
    """The models' properties as patched so far: model_urn, properties; models without any have no row."""
    log = f"{path}/model_properties"
    entries = manifest.entries(spark, log)
    if not entries:
        return spark.createDataFrame([], "model_urn string, properties map<string,string>")
    order = spark.createDataFrame([(e.version, e.sequence) for e in entries], "version string, sequence long")
    patches = manifest.read(spark, log, "model_urn string, properties map<string,string>, version string", [e.version for e in entries])
    flat = patches.join(F.broadcast(order), "version").select("model_urn", "sequence", F.explode("properties").alias("name", "value"))
    # Of a name that one patch sets twice for a model, the largest value counts.
    newest = flat.groupBy("model_urn", "name").agg(F.max(F.struct("sequence", "value")).alias("newest")).filter("newest.value is not null")
    return newest.groupBy("model_urn").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "newest.value")))).alias("properties"))


def compact_properties(spark: SparkSession, path: str) -> None:
    """Folds the patch log into one version; ConflictError, and nothing changed, if a patch is committed meanwhile."""
    log, version = f"{path}/model_properties", uuid.uuid4().hex
    seen, entries = manifest.last(spark, log), manifest.entries(spark, log)
    if not entries or entries[-1].sequence != seen:
        return
    properties(spark, path).write.parquet(manifest.folder(log, version))
    try:
        at = manifest.append(spark, log, version, seen, checkpoint=True)
    except manifest.ConflictError:
        manifest.remove(spark, manifest.folder(log, version))
        raise
    manifest.forget(spark, log, at)
    for e in entries:
        manifest.remove(spark, manifest.folder(log, e.version))


def patched(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Property maps (model_urn, properties) with changes laid over them; names that no change has stay."""
    new = changes.select("model_urn", F.col("properties").alias("changed"))
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("properties", none), lambda k, _: ~F.map_contains_key(F.coalesce("changed", none), k))
    return old.join(new, "model_urn", "full").select("model_urn", F.map_concat(kept, F.coalesce("changed", none)).alias("properties"))

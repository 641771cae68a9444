"""Snapshots as JSON documents, and baselines kept inside a catalog's own records.

A document has one model: {model_urn, assets: [...], columns: [...], profiles: [...], col_features: [...]}. A
catalog may keep it as the value of a property, or in the text of a note beside other words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.snapshot import ASSETS, COL_FEATURES, COLUMNS, PROFILES, Snapshot

_TABLES = {"assets": ASSETS, "columns": COLUMNS, "profiles": PROFILES, "col_features": COL_FEATURES}
_DOCUMENT = T.StructType([T.StructField("model_urn", T.StringType())] + [T.StructField(n, T.ArrayType(s)) for n, s in _TABLES.items()])


def to_documents(snapshot: Snapshot) -> DataFrame:
    """(model_urn, document): each model's part of the snapshot as JSON."""
    out = snapshot.assets.select("model_urn").distinct()
    for name in _TABLES:
        table = getattr(snapshot, name)
        packed = table.groupBy("model_urn").agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias(name))
        out = out.join(packed, "model_urn", "left")
    return out.select("model_urn", F.to_json(F.struct("model_urn", *_TABLES)).alias("document"))


def from_documents(documents: DataFrame) -> Snapshot:
    """The snapshot in a column ``document``; texts that are no document give nothing."""
    parsed = documents.select(F.from_json("document", _DOCUMENT).alias("d")).filter("d.model_urn is not null")
    return Snapshot.of(*(parsed.select(F.inline(F.col(f"d.{name}"))) for name in _TABLES))


def embedded(records: DataFrame) -> DataFrame:
    """(model_urn, document) from records (urn, property_urn, value, description).

    The value of a property whose name has "baseline" comes first, then the braces in a description that
    mentions model_urn.
    """
    value = F.when(F.col("property_urn").contains("baseline"), F.nullif("value", F.lit("")))
    note = F.when(F.col("description").contains("model_urn"), F.nullif(F.regexp_extract("description", r"(?s)\{.*\}", 0), F.lit("")))
    ranked = records.select("urn", value.alias("value"), note.alias("note")).groupBy("urn").agg(F.max("value").alias("value"), F.max("note").alias("note"))
    document = F.coalesce("value", "note")
    return ranked.filter(document.isNotNull()).select(F.col("urn").alias("model_urn"), document.alias("document"))


RECORDS = "urn string, property_urn string, value string, description string"


def from_records(records: DataFrame) -> Snapshot:
    """The baselines embedded in a catalog's records; a document counts only in the record of its own model."""
    return from_documents(embedded(records).filter(F.get_json_object("document", "$.model_urn") == F.col("model_urn")))

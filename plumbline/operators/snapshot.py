"""Snapshots of many models at once, as tables keyed by model_urn.

assets       (model_urn, urn, entity_type, owners, tags, deprecated, deprecation_note,
              feeds_features, profiled, row_count)
columns      (model_urn, urn, ord, path, data_type, native_type, nullable, tags)
profiles     (model_urn, urn, path, null_count, null_proportion, unique_count, min, max, mean, stdev)
col_features (model_urn, urn, path, features)

Absent columns are added as nulls, null lists become empty ones, and of columns with one path the
first stays, so the differs below can rely on the shape.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.durable import cut

_TEXTS = T.ArrayType(T.StringType())


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_KEYS = (("model_urn", T.StringType()), ("urn", T.StringType()))
ASSETS = _schema(
    *_KEYS,
    ("entity_type", T.StringType()),
    ("owners", _TEXTS),
    ("tags", _TEXTS),
    ("deprecated", T.BooleanType()),
    ("deprecation_note", T.StringType()),
    ("feeds_features", _TEXTS),
    ("profiled", T.BooleanType()),
    ("row_count", T.LongType()),
)
COLUMNS = _schema(
    *_KEYS,
    ("ord", T.IntegerType()),
    ("path", T.StringType()),
    ("data_type", T.StringType()),
    ("native_type", T.StringType()),
    ("nullable", T.BooleanType()),
    ("tags", _TEXTS),
)
PROFILES = _schema(
    *_KEYS,
    ("path", T.StringType()),
    ("null_count", T.LongType()),
    ("null_proportion", T.DoubleType()),
    ("unique_count", T.LongType()),
    *((s, T.StringType()) for s in ("min", "max", "mean", "stdev")),
)
COL_FEATURES = _schema(*_KEYS, ("path", T.StringType()), ("features", _TEXTS))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the schema's columns in order; missing ones are null, null lists are empty."""
    out = []
    for field in schema:
        col = F.col(field.name) if field.name in df.columns else F.lit(None)
        col = col.cast(field.dataType)
        if isinstance(field.dataType, T.ArrayType):
            col = F.coalesce(col, F.array().cast(field.dataType))
        elif field.name in ("deprecated", "nullable", "profiled"):
            col = F.coalesce(col, F.lit(False))
        elif field.name == "data_type":
            col = F.coalesce(col, F.lit("unknown"))
        out.append(col.alias(field.name))
    return df.select(*out)


@dataclass(frozen=True)
class Snapshot:
    """State of all assets of all models at one time."""

    assets: DataFrame
    columns: DataFrame
    profiles: DataFrame
    col_features: DataFrame

    @classmethod
    def of(cls, assets: DataFrame, columns: DataFrame | None = None, profiles: DataFrame | None = None, col_features: DataFrame | None = None) -> Snapshot:
        spark = assets.sparkSession
        table = lambda df, schema: conform(df if df is not None else spark.createDataFrame([], schema), schema)
        columns = table(columns, COLUMNS)
        rest = [c for c in columns.columns if c not in ("model_urn", "urn", "path")]
        first = columns.groupBy("model_urn", "urn", "path").agg(F.min_by(F.struct(*rest), "ord").alias("first"))
        columns = first.select("model_urn", "urn", "path", *(F.col("first")[c].alias(c) for c in rest)).select(*COLUMNS.fieldNames())
        return cls(table(assets, ASSETS), columns, table(profiles, PROFILES), table(col_features, COL_FEATURES))

    def durable(self) -> Snapshot:
        """The same with its tables written out, all at a time, so that the differs don't recompute them."""
        names = ("assets", "columns", "profiles", "col_features")
        with ThreadPoolExecutor(len(names)) as pool:
            return Snapshot(*pool.map(lambda t: cut(getattr(self, t), t), names))

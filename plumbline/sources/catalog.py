"""A catalog's tables, and the snapshot of all models' footprints built from them.

assets       (urn, entity_type, owners, tags, deprecated, deprecation_note)
columns      (urn, ord, path, data_type, native_type, nullable, tags)
profiles     (urn, ts, row_count, fields: array of statistics)
edges        (src, dst, relationship, seq)
column_edges (down_urn, down_col, up_urn, up_col)

A source that knows no profiles or no column lineage leaves those tables empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import exprs as X
from plumbline.operators import graph, profile
from plumbline.operators.snapshot import Snapshot

EDGES = "src string, dst string, relationship string, seq int"
COLUMN_EDGES = "down_urn string, down_col string, up_urn string, up_col string"
FIELD = "path string, null_count bigint, null_proportion double, unique_count bigint, unique_proportion double, min string, max string, mean string, median string, stdev string"
PROFILES = f"urn string, ts bigint, row_count bigint, column_count bigint, fields array<struct<{FIELD.replace(' ', ':').replace(',:', ',')}>>"


@dataclass(frozen=True)
class Catalog:
    assets: DataFrame
    columns: DataFrame
    profiles: DataFrame
    edges: DataFrame
    column_edges: DataFrame

    @classmethod
    def of(cls, assets: DataFrame, edges: DataFrame, columns: DataFrame | None = None, profiles: DataFrame | None = None, column_edges: DataFrame | None = None) -> Catalog:
        spark = assets.sparkSession
        empty = lambda schema: spark.createDataFrame([], schema)
        no_columns = "urn string, ord int, path string, data_type string, native_type string, nullable boolean, tags array<string>"
        return cls(
            assets,
            columns if columns is not None else empty(no_columns),
            profiles if profiles is not None else empty(PROFILES),
            edges,
            column_edges if column_edges is not None else empty(COLUMN_EDGES),
        )

    def footprint(self, models: DataFrame, max_hops: int = 5, counters: graph.Counters | None = None) -> DataFrame:
        return graph.footprint(models, self.edges, max_hops, counters)

    def snapshot(self, found: DataFrame, max_hops: int = 5) -> Snapshot:
        """The snapshot of a footprint. Profiles count for datasets alone; of several the newest."""
        nodes = found.select("model_urn", "urn", "entity_type")
        newest = profile.latest(self.profiles, ["urn"], "ts")
        sources = graph.feature_sources(found, self.edges, max_hops)
        kept = self.assets.select("urn", *(c for c in ("owners", "tags", "deprecated", "deprecation_note") if c in self.assets.columns))
        profiled = newest.select("urn", F.lit(True).alias("profiled"), "row_count")
        assets = nodes.join(kept, "urn", "left").join(sources, ["model_urn", "urn"], "left").join(profiled, "urn", "left")
        dataset = F.col("entity_type") == "dataset"
        assets = assets.withColumn("profiled", dataset & F.coalesce("profiled", F.lit(False))).withColumn("row_count", F.when(dataset, F.col("row_count")))
        columns = nodes.select("model_urn", "urn").join(self.columns, "urn")
        fields = newest.select("urn", F.inline("fields"))
        profiles = nodes.filter(dataset).select("model_urn", "urn").join(fields, "urn")
        reached = graph.column_features(found, sources, columns, self.column_edges)
        return Snapshot.of(assets, columns, profiles, reached)


def columns_of_schema(spark: SparkSession, urn: str, schema: T.StructType) -> DataFrame:
    """A table's columns from its Spark schema. Parquet loses nullability, so all of it is as declared."""
    logical = {
        "string": "string", "boolean": "boolean", "date": "date", "timestamp": "time", "timestamp_ntz": "time", "binary": "bytes",
        "byte": "number", "short": "number", "integer": "number", "long": "number", "float": "number", "double": "number", "decimal": "number",
    }
    rows = [(urn, i, f.name, logical.get(f.dataType.typeName(), "unknown"), f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema)]
    return spark.createDataFrame(rows, "urn string, ord int, path string, data_type string, native_type string, nullable boolean")


def column_edges_of(aspects: DataFrame) -> DataFrame:
    """Column lineage from (urn, fine array<struct<upstreams array<string>, downstreams array<string>>>).

    Ends that name no column are left out, and so are downstream ends of other datasets.
    """
    flat = aspects.select("urn", F.explode("fine").alias("f"))
    flat = flat.select("urn", F.explode("f.downstreams").alias("down"), F.col("f.upstreams").alias("ups")).select("urn", "down", F.explode("ups").alias("up"))
    out = flat.select(
        F.col("urn").alias("down_urn"),
        X.field_column(F.col("down")).alias("down_col"),
        X.field_dataset(F.col("up")).alias("up_urn"),
        X.field_column(F.col("up")).alias("up_col"),
    )
    return out.filter("down_col is not null and up_urn is not null and up_col is not null").distinct()

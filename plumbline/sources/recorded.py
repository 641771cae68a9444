"""A recorded graph: one JSON document with the states before and after a change.

{before: {entities, lineage, schemas, profiles}, after: {...}}, each a map by identity. The document
is read with a fixed schema, and every map is exploded to a table.

Catalogs of any size are recorded in parts: a line per asset and state, {urn, entities, lineage, schemas, profiles} with that
asset's values, in folders of=<parts>/state=<state>/part=<hash of the identity modulo parts>. Tasks write and read parts side by
side, and a load of named assets opens their parts alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import profile
from plumbline.sources.catalog import Catalog, column_edges_of

_FIELD = "field_path:string,data_type:string,native_type:string,nullable:boolean,tags:array<string>"
_EDGE = "source_urn:string,target_urn:string,relationship:string,via:string"
_STATS = (
    "fieldPath:string,nullCount:bigint,nullProportion:double,uniqueCount:bigint,uniqueProportion:double,"
    "min:string,max:string,mean:string,median:string,stdev:string"
)
_PROFILE = f"timestampMillis:bigint,rowCount:bigint,columnCount:bigint,fieldProfiles:array<struct<{_STATS}>>"
_ASPECTS = (
    "ownership:struct<owners:array<struct<owner:string>>>,globalTags:struct<tags:array<struct<tag:string>>>,"
    "deprecation:struct<deprecated:boolean,note:string>,"
    "upstreamLineage:struct<fineGrainedLineages:array<struct<upstreams:array<string>,downstreams:array<string>>>>"
)
_VALUES = {
    "entities": f"struct<entity_type:string,aspects:struct<{_ASPECTS}>>",
    "lineage": f"struct<UPSTREAM:array<struct<{_EDGE}>>,DOWNSTREAM:array<struct<{_EDGE}>>>",
    "schemas": f"array<struct<{_FIELD}>>",
    "profiles": f"struct<{_PROFILE}>",
}
_STATE = ",".join(f"{name}:map<string,{value}>" for name, value in _VALUES.items())


def load(spark: SparkSession, path: str, state: str) -> Catalog:
    """The catalog in one state of a recording; ValueError if the recording has no such state."""
    whole = spark.read.option("multiLine", True).schema(f"`{state}` struct<{_STATE}>").json(path).select(F.col(f"`{state}`").alias("s"))
    if not whole.filter("s is not null").limit(1).count():
        raise ValueError(f"the recording has no state {state!r}")
    return _catalog({name: whole.select(F.explode(F.col(f"s.{name}")).alias("urn", "v")) for name in _VALUES})


#: Assets that ``load_parts`` takes by name at most; for more, load all and semi join the tables.
MOST_NAMED = 1_000


def load_parts(spark: SparkSession, path: str, state: str, urns: list[str] | None = None) -> Catalog:
    """The catalog in one state of a recording in parts, of all assets or of those named.

    Only the state's folders are opened, and of them the parts that a named asset can be in. A name that was not recorded gives
    no rows, an empty list empty tables. ValueError if no asset was recorded in this state, or with more than MOST_NAMED names.
    """
    values = ", ".join(f"{name} {value}" for name, value in _VALUES.items())
    rows = spark.read.schema(f"urn string, {values}, of int, state string, part int").json(path).filter(F.col("state") == state)
    if not rows.limit(1).count():
        raise ValueError(f"the recording has no state {state!r}")
    if urns is not None:
        if len(urns) > MOST_NAMED:
            raise ValueError(f"{MOST_NAMED} assets can be named at most")
        within = reduce(lambda a, b: a | b, (F.col("part") == _part_of(F.lit(u), F.col("of")) for u in urns), F.lit(False))
        rows = rows.filter(within).filter(F.col("urn").isin(list(urns)))
    return _catalog({name: rows.filter(F.col(name).isNotNull()).select("urn", F.col(name).alias("v")) for name in _VALUES})


def _part_of(urn: F.Column, parts: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(urn), parts).cast("int")


def _catalog(tables: dict[str, DataFrame]) -> Catalog:
    """The catalog of recorded values: a table (urn, v) each of entities, lineage, schemas and profiles."""
    entities = tables["entities"]
    assets = entities.select(
        "urn",
        F.coalesce(F.nullif(F.col("v.entity_type"), F.lit("")), X.entity_type(F.col("urn"))).alias("entity_type"),
        F.filter(F.coalesce("v.aspects.ownership.owners.owner", F.array().cast("array<string>")), lambda o: F.coalesce(o, F.lit("")) != "").alias("owners"),
        F.filter(F.coalesce("v.aspects.globalTags.tags.tag", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("tags"),
        F.coalesce("v.aspects.deprecation.deprecated", F.lit(False)).alias("deprecated"),
        F.col("v.aspects.deprecation.note").alias("deprecation_note"),
    )
    columns = tables["schemas"].select("urn", F.posexplode("v").alias("ord", "c")).select("urn", "ord", F.col("c.field_path").alias("path"), "c.data_type", "c.native_type", "c.nullable", "c.tags")
    stats = F.transform(
        "v.fieldProfiles",
        lambda p: F.struct(
            p["fieldPath"].alias("path"),
            p["nullCount"].alias("null_count"),
            p["nullProportion"].alias("null_proportion"),
            p["uniqueCount"].alias("unique_count"),
            p["uniqueProportion"].alias("unique_proportion"),
            *(p[s].alias(s) for s in ("min", "max", "mean", "median", "stdev")),
        ),
    )
    profiles = tables["profiles"].select("urn", F.col("v.timestampMillis").alias("ts"), F.col("v.rowCount").alias("row_count"), F.col("v.columnCount").alias("column_count"), stats.alias("fields"))
    edges = _edges(tables["lineage"])
    fine = entities.select("urn", F.col("v.aspects.upstreamLineage.fineGrainedLineages").alias("fine"))
    return Catalog.of(assets, edges, columns, profiles, column_edges_of(fine))


#: Assets of a recording at most: it is one document, so one task writes it.
MOST_ASSETS = 10_000


def record(states: dict[str, Catalog], urns: DataFrame, path: str) -> None:
    """Writes the named assets (column urn) of each state's catalog as a recording that ``load`` reads.

    Edges keep their order and column lineage the columns it names; of several profiles the newest is recorded. ValueError
    beyond MOST_ASSETS assets.
    """
    named = urns.select("urn").distinct()
    if named.limit(MOST_ASSETS + 1).count() > MOST_ASSETS:
        raise ValueError(f"a recording has {MOST_ASSETS} assets at most")
    whole = _beside([_state_of(catalog, named).withColumnRenamed("state", state) for state, catalog in states.items()])
    whole.select(F.to_json(F.struct(*states)).alias("value")).coalesce(1).write.text(path)


#: Rows of a catalog's tables that a part has on average at most, so that one fits a task, and the number of parts at least.
PART_ROWS, LEAST_PARTS = 200_000, 64


def record_parts(states: dict[str, Catalog], path: str, urns: DataFrame | None = None, parts: int | None = None) -> None:
    """Writes each state's assets, or the named ones (column urn), as a recording in parts that ``load_parts`` reads.

    Values are as ``record`` writes them. There is no limit of assets; one asset is one line. The number of parts follows the
    rows of the largest state's tables, which are counted for it, unless ``parts`` is given. A task joins and writes a part at a
    time. An error if something is at ``path``.
    """
    tasks = parts or max(1, -(-max(sum(t.count() for t in vars(c).values()) for c in states.values()) // PART_ROWS))
    parts = parts or max(LEAST_PARTS, tasks)
    lines = []
    for i, (state, catalog) in enumerate(states.items()):
        named = (catalog.assets if urns is None else urns).select("urn").distinct().repartition(tasks, "urn")
        lines.append(_lines_of(catalog, named).withColumn("state", F.lit(state)).withColumn("nth", F.lit(i)))
    rows = reduce(DataFrame.unionByName, lines).withColumn("of", F.lit(parts)).withColumn("part", _part_of(F.col("urn"), F.lit(parts)))
    dealt = rows.repartitionById(parts * len(states), F.col("nth") * parts + F.col("part")).drop("nth")
    # Identities begin alike and come again and again, so compressed lines take a small part of the disk.
    dealt.write.partitionBy("of", "state", "part").option("compression", "gzip").json(path)


def _lines_of(catalog: Catalog, named: DataFrame) -> DataFrame:
    """A row per named asset: urn and its values, null where it has none."""
    return reduce(lambda all, name: all.join(name[1].withColumnRenamed(name[1].columns[1], name[0]), "urn", "left"), _values_of(catalog, named).items(), named)


def _beside(rows: list[DataFrame]) -> DataFrame:
    """Tables of one row and one column each, as one row."""
    names = [df.columns[0] for df in rows]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return every.agg(*(F.first(n, ignorenulls=True).alias(n) for n in names))


def _state_of(catalog: Catalog, named: DataFrame) -> DataFrame:
    """One row: the state as a struct of maps by identity."""
    mapped = _values_of(catalog, named)
    return _beside([df.agg(F.map_from_entries(F.collect_list(F.struct(*df.columns))).alias(name)) for name, df in mapped.items()]).select(F.struct(*mapped).alias("state"))


def _values_of(catalog: Catalog, named: DataFrame) -> dict[str, DataFrame]:
    """The named assets' values as tables of two columns, urn and the value; only their own rows are grouped."""
    own = lambda df, urn: df.withColumnRenamed(urn, "urn").join(named, "urn", "left_semi")
    field = lambda urn, column: F.concat(F.lit("urn:li:schemaField:("), urn, F.lit(","), column, F.lit(")"))
    listed = lambda column, name: F.transform(column, lambda x: F.struct(x.alias(name)))
    fine = own(catalog.column_edges, "down_urn").groupBy("urn").agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.array(field(F.col("up_urn"), F.col("up_col"))).alias("upstreams"), F.array(field(F.col("urn"), F.col("down_col"))).alias("downstreams"))
            )
        ).alias("fine")
    )
    aspects = F.struct(
        F.struct(listed("owners", "owner").alias("owners")).alias("ownership"),
        F.struct(listed("tags", "tag").alias("tags")).alias("globalTags"),
        F.struct(F.col("deprecated"), F.col("deprecation_note").alias("note")).alias("deprecation"),
        F.struct(F.col("fine").alias("fineGrainedLineages")).alias("upstreamLineage"),
    )
    entity = F.struct("entity_type", aspects.alias("aspects"))
    entities = catalog.assets.join(named, "urn", "left_semi").join(fine, "urn", "left").select("urn", entity.alias("entity"))
    # Grouped edges have their other end alone; the asset's own is added behind.
    ends = lambda at, other, name: own(catalog.edges.select(at, F.struct("seq", F.col(other).alias("other"), "relationship").alias("end")), at).groupBy("urn").agg(F.array_sort(F.collect_list("end")).alias(name))
    ways = named.join(ends("src", "dst", "UPSTREAM"), "urn", "left").join(ends("dst", "src", "DOWNSTREAM"), "urn", "left")
    edge = lambda source, target, e: F.struct(source.alias("source_urn"), target.alias("target_urn"), e["relationship"].alias("relationship"))
    up, down = F.transform("UPSTREAM", lambda e: edge(F.col("urn"), e["other"], e)), F.transform("DOWNSTREAM", lambda e: edge(e["other"], F.col("urn"), e))
    lineage = ways.select("urn", F.struct(up.alias("UPSTREAM"), down.alias("DOWNSTREAM")).alias("lineage"))
    column = F.struct("ord", F.col("path").alias("field_path"), "data_type", "native_type", "nullable", "tags")
    columns = catalog.columns.join(named, "urn", "left_semi").groupBy("urn").agg(F.array_sort(F.collect_list(column)).alias("schema"))
    schemas = columns.select("urn", F.transform("schema", lambda c: c.dropFields("ord")).alias("schema"))
    statistics = {"path": "fieldPath", "null_count": "nullCount", "null_proportion": "nullProportion", "unique_count": "uniqueCount", "unique_proportion": "uniqueProportion"}
    statistics |= {s: s for s in ("min", "max", "mean", "median", "stdev")}
    fields = F.transform("fields", lambda f: F.struct(*(f[a].alias(b) for a, b in statistics.items())))
    newest = profile.latest(catalog.profiles.join(named, "urn", "left_semi"), ["urn"], "ts")
    measured = F.struct(F.col("ts").alias("timestampMillis"), F.col("row_count").alias("rowCount"), F.col("column_count").alias("columnCount"), fields.alias("fieldProfiles"))
    profiles = newest.select("urn", measured.alias("profile"))
    return {"entities": entities, "lineage": lineage, "schemas": schemas, "profiles": profiles}


def _edges(lineage: DataFrame) -> DataFrame:
    """Upstream edges of each anchor, to the end that is not the anchor."""
    flat = lineage.select(F.col("urn").alias("src"), F.posexplode("v.UPSTREAM").alias("seq", "e"))
    other = F.when(F.col("e.source_urn") == F.col("src"), F.col("e.target_urn")).otherwise(F.col("e.source_urn"))
    return flat.select("src", other.alias("dst"), F.coalesce("e.relationship", F.lit("DownstreamOf")).alias("relationship"), "seq").filter("dst is not null and dst <> src")

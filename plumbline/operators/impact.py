"""Impact of a changed SQL statement, before it is merged, and of a column that might go.

The statement goes through Spark's own parser and analyzer against the catalog's views; nothing runs.
The output columns of the analyzed query are compared with those the catalog has for the table that
the statement builds, and if any are gone, the lineage graph is walked down to the models: from the table, or, where the
catalog's column lineage is given, from the columns that go.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.functions.durable import cut
from plumbline.operators import graph, lineage


@dataclass(frozen=True)
class Proposal:
    """What a statement would build: its table and columns, or why that can't be told."""

    table: str
    columns: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    #: (output column, input table, input column, whether it is a plain copy), through all of the plan.
    lineage: tuple[tuple[str, str, str, bool], ...] = ()
    error: str | None = None

    @property
    def sources(self) -> tuple[tuple[str, str, bool], ...]:
        """(output column, input column, whether it is a plain copy)."""
        return tuple((o, c, copied) for o, _, c, copied in self.lineage)


def propose(spark: SparkSession, sql: str) -> Proposal | None:
    """The table and columns that a statement builds, and where they come from; None if it builds none."""
    state = spark._jsparkSession.sessionState()
    try:
        plan = state.sqlParser().parsePlan(sql)
    except Exception as e:  # the parser's own error classes live in the JVM
        return Proposal("", error=str(e).strip().splitlines()[0])
    kind = plan.getClass().getSimpleName()
    if kind not in ("CreateTableAsSelect", "ReplaceTableAsSelect", "CreateView", "InsertIntoStatement"):
        return Proposal("", error=f"{kind} is not understood") if kind in ("CreateViewCommand", "MergeIntoTable") else None
    target = plan.table() if kind == "InsertIntoStatement" else plan.name() if kind.endswith("AsSelect") else plan.child()
    table = ".".join(_name_parts(target))
    try:
        skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
        analyzed = state.executePlan(plan.query(), skip).analyzed()
        fields = analyzed.schema().fields()
    except Exception as e:
        return Proposal(table, error=str(e).strip().splitlines()[0])
    columns = tuple(f.name() for f in fields)
    return Proposal(table, columns, tuple(f.dataType().simpleString() for f in fields), lineage.of_plan(analyzed))


def _name_parts(target) -> list[str]:
    for attribute in ("nameParts", "multipartIdentifier"):
        if hasattr(target, attribute):
            try:
                parts = getattr(target, attribute)()
                return [parts.apply(i) for i in range(parts.size())]
            except Exception:  # an object of the JVM answers to any name
                continue
    return [target.toString()]


def schema_impact(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """(table_urn, dropped, added): columns that go, in catalog order, and come, in the proposal's.

    Both have (table_urn, ord, path); a table that the catalog doesn't know drops nothing.
    """
    pack = lambda df, name: df.groupBy("table_urn").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias(name))
    both = pack(proposed, "new").join(pack(current, "old"), "table_urn", "left").withColumn("old", F.coalesce("old", F.array().cast("array<string>")))
    return both.select("table_urn", F.array_except("old", "new").alias("dropped"), F.array_except("new", "old").alias("added"))


def tables_of(columns: DataFrame, platform: str | None = None, env: str | None = None) -> DataFrame:
    """(table, table_urn, ord, path): a catalog's columns with the name that SQL has for their table.

    ``platform`` and ``env`` leave out the tables of others, of which one can have the same name.
    """
    urn = F.col("urn")
    out = columns
    if platform:
        out = out.filter(F.contains(urn, F.lit(f":dataPlatform:{platform},")))
    if env:
        out = out.filter(F.endswith(urn, F.lit(f",{env})")))
    return out.select(X.report_name(urn).alias("table"), urn.alias("table_urn"), "ord", "path")


def sql_impact(
    spark: SparkSession, statements: dict[str, str], catalog: DataFrame, edges: DataFrame, owners: DataFrame, max_hops: int = 6, column_edges: DataFrame | None = None
) -> DataFrame:
    """A row per statement that builds a table: sql_file, table_urn, dropped, added, inputs, impacted, parse_error, breaking.

    ``statements``: text by file; ``catalog``: (table, table_urn, ord, path); ``owners``: (urn, owners). ``inputs`` are the
    table.column that the statement's columns come from. ``impacted`` lists the models downstream of a table that loses columns, with owners
    and route; with ``column_edges`` only those that the lost columns feed.
    """
    proposals = {f: p for f, s in statements.items() if (p := propose(spark, s)) is not None}
    inputs = {f: sorted({f"{t}.{c}" for _, t, c, _ in p.lineage}) for f, p in proposals.items()}
    named = spark.createDataFrame([(f, p.table, p.error, inputs[f]) for f, p in proposals.items()], "sql_file string, table string, parse_error string, inputs array<string>")
    columns = [(f, i, c) for f, p in proposals.items() for i, c in enumerate(p.columns)]
    proposed = spark.createDataFrame(columns, "table_urn string, ord int, path string")
    tables = named.join(catalog.select("table", "table_urn").distinct(), "table", "left")
    current = tables.join(catalog, ["table", "table_urn"]).select(F.col("sql_file").alias("table_urn"), "ord", "path")
    changes = schema_impact(proposed, current).withColumnRenamed("table_urn", "sql_file")
    changed = tables.join(changes, "sql_file", "left")
    if column_edges is not None:
        changed = cut(changed, "changes")
    losing = changed.filter((F.size("dropped") > 0) & F.col("table_urn").isNotNull()).select("sql_file", F.col("table_urn").alias("seed"))
    found = losing.join(impacted_models(losing.select("seed"), edges, owners, max_hops), "seed")
    if column_edges is not None:
        lost = changed.filter("table_urn is not null").select("sql_file", "table_urn", F.explode("dropped").alias("path"))
        fed = lineage.column_impact(lost, edges, column_edges, max_hops)
        found = found.join(lost.join(fed, ["table_urn", "path"]).select("sql_file", "model_urn"), ["sql_file", "model_urn"], "left_semi")
    impacted = found.groupBy("sql_file").agg(F.array_sort(F.collect_list(F.struct("model_urn", "owners", "route"))).alias("impacted"))
    out = changed.join(impacted, "sql_file", "left")
    drops = F.size(F.coalesce("dropped", F.array().cast("array<string>"))) > 0
    out = out.withColumn("impacted", F.when(drops, F.col("impacted")))
    broken = drops & F.col("impacted").isNotNull()
    return out.select("sql_file", "table_urn", "dropped", "added", "inputs", "impacted", "parse_error", broken.alias("breaking"))


def impacted_models(seeds: DataFrame, edges: DataFrame, owners: DataFrame, max_hops: int = 6) -> DataFrame:
    """Models downstream of each seed (column seed): seed, model_urn, depth, route, owners."""
    found = graph.downstream_models(seeds, edges, max_hops)
    own = owners.select(F.col("urn").alias("model_urn"), "owners")
    joined = found.join(own, "model_urn", "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))
    return joined.select("seed", "model_urn", "depth", graph.route(F.col("path")).alias("route"), "owners")


def what_if(spark: SparkSession, table_urn: str, column: str, edges: DataFrame, owners: DataFrame, max_hops: int = 6) -> DataFrame:
    """Models that losing ``column`` of a table would reach; the column itself isn't looked up."""
    seeds = spark.createDataFrame([(table_urn,)], "seed string")
    return impacted_models(seeds, edges, owners, max_hops).withColumn("column", F.lit(column))


def read_statements(paths: list[str | Path]) -> dict[str, str]:
    """SQL files on the driver, by name."""
    return {Path(p).as_posix(): Path(p).read_text(encoding="utf-8") for p in paths}

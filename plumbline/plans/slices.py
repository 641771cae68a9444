"""Snapshots, graphs and histories derived from the test tables, so that every operator has input
whose size follows the scale factor."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.durable import cut
from plumbline.operators import profile
from plumbline.operators.snapshot import Snapshot

SPLIT = "1998-04-15"
NOW = datetime(2026, 8, 3, 12, tzinfo=UTC)
MODEL = "urn:li:mlModel:(urn:li:dataPlatform:spark,orders_model,PROD)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(name) -> F.Column:
    return F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:spark,"), name, F.lit(",PROD)"))


def model(name) -> F.Column:
    return F.concat(F.lit("urn:li:mlModel:(urn:li:dataPlatform:spark,"), name, F.lit(",PROD)"))


def feature(name) -> F.Column:
    return F.concat(F.lit("urn:li:mlFeature:(store,"), name, F.lit(")"))


# -- statistics: order prices per nation, one period against another -----------


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by nation in the baseline period and, disturbed in a fixed way, in the current one."""
    rows = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_nationkey", "n_name", "n_regionkey", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    )
    current = F.col("o_orderdate") >= F.lit(SPLIT).cast("timestamp_ntz")
    lost = current & (F.col("n_nationkey") % 6 == 2) & (F.col("o_orderkey") % 10 < 6)
    price = (
        F.when(current & (F.col("n_nationkey") % 7 == 1) & (F.col("o_custkey") % 3 == 0), None)
        .when(current & (F.col("n_nationkey") % 5 == 0), F.col("o_totalprice") * 6)
        .when(~current & (F.col("n_nationkey") % 11 == 3), 1000.0)
        .otherwise(F.col("o_totalprice"))
    )
    bucket = F.when(current & (F.col("n_nationkey") % 8 == 4), F.col("o_orderkey") % 5).otherwise(F.col("o_orderkey") % 40)
    return rows.filter(~lost).select(
        F.when(current, "new").otherwise("old").alias("side"), "n_nationkey", "n_name", "n_regionkey", price.alias("price"), bucket.alias("bucket")
    )


def order_snapshots(spark: SparkSession, sf_dir: str, per_region: bool = False) -> tuple[Snapshot, Snapshot]:
    """Baseline and current snapshot: an asset per nation, columns price and bucket.

    One model has them all, or each region's model has its own and those of the next region's
    nations.
    """
    rows = order_rows(spark, sf_dir)
    stats = profile.profile(rows, ["side", "n_nationkey", "n_name", "n_regionkey"], ["price", "bucket"])
    if per_region:
        both = F.explode(F.array(F.col("n_regionkey"), (F.col("n_regionkey") + 1) % 5))
        stats = stats.withColumn("owner_region", both).withColumn("model_urn", model(F.concat(F.lit("region_"), F.col("owner_region").cast("string"))))
    else:
        stats = stats.withColumn("model_urn", F.lit(MODEL))
    # Nations of one key class were never profiled in the baseline.
    stats = stats.filter(~((F.col("side") == "old") & (F.col("n_nationkey") % 12 == 9) & (F.col("path") == "bucket")))
    # The profile is written once; assets, columns and both sides come from it without another pass over the orders.
    stats = cut(stats.withColumn("urn", dataset(F.concat(F.lit("orders."), "n_name"))), "profile")
    return _side(stats, "old"), _side(stats, "new")


def _side(stats: DataFrame, side: str) -> Snapshot:
    own = stats.filter(F.col("side") == side)
    assets = own.groupBy("model_urn", "urn").agg(F.max("row_count").alias("row_count"), F.max("n_nationkey").alias("key")).select(
        "model_urn", "urn", F.lit("dataset").alias("entity_type"), F.array(F.concat(F.lit("urn:li:corpuser:u"), (F.col("key") % 4).cast("string"))).alias("owners"),
        F.lit(True).alias("profiled"), "row_count",
    )
    columns = own.select("model_urn", "urn", F.when(F.col("path") == "price", 0).otherwise(1).alias("ord"), "path", F.lit("number").alias("data_type"), F.lit("double").alias("native_type"), F.lit(True).alias("nullable"))
    every = assets.select("model_urn", "urn").crossJoin(F.broadcast(columns.sparkSession.createDataFrame([(1, "bucket")], "ord int, path string")))
    columns = columns.unionByName(every.select("model_urn", "urn", "ord", "path", F.lit("number").alias("data_type"), F.lit("double").alias("native_type"), F.lit(True).alias("nullable")))
    return Snapshot.of(assets, columns, own).durable()


# -- schema: part brands as assets, part types as columns -----------------------


TYPES = (
    "int", "bigint", "smallint", "decimal(10,2)", "decimal(12,2)", "decimal(8,4)", "decimal", "varchar(16)", "varchar(64)",
    "varchar(max)", "text", "float", "double", "int(11)", "timestamp_ntz", "number(5)", "decimal(6,0)",
)


def part_snapshots(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    """Brands as assets; the types of a brand's even parts are the old columns, of its odd parts the new."""
    part = table(spark, sf_dir, "part")
    native = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("k") % len(TYPES) + 1).cast("int"))
    out = []
    for side, parity in (("old", 0), ("new", 1)):
        own = part.filter(F.col("p_partkey") % 2 == parity)
        columns = own.groupBy("p_brand", F.concat_ws("_", "p_type", "p_size").alias("path")).agg(F.sum("p_size").alias("k"), F.min("p_partkey").alias("ord"))
        columns = columns.select(
            F.lit(MODEL).alias("model_urn"), dataset(F.concat(F.lit("parts."), "p_brand")).alias("urn"), F.col("ord").cast("int").alias("ord"),
            "path", F.lit("NumberType" if side == "old" else "number").alias("data_type"), native.alias("native_type"),
            (F.col("k") % 3 == 0).alias("nullable"),
        )
        assets = columns.select("model_urn", "urn").distinct().withColumn("entity_type", F.lit("dataset"))
        assets = assets.withColumn("feeds_features", F.array(F.concat(F.lit("urn:li:mlFeature:(parts,"), F.regexp_extract("urn", "#([0-9]+)", 1), F.lit(")"))))
        out.append(Snapshot.of(assets, columns).durable())
    return out[0], out[1]


# -- governance: sources of documents ------------------------------------------


def document_snapshots(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    """Groups of documents as assets; flags, owners and tags come from counts of the group's rows."""
    docs = table(spark, sf_dir, "documents").withColumn("name", F.concat("source", F.lit("_"), "lang"))
    counted = docs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    urn = dataset(F.concat(F.lit("docs."), "name"))
    owner = F.array(F.concat(F.lit("urn:li:corpuser:"), "name"))
    none = F.array().cast("array<string>")
    tag = lambda *t: F.array(*map(F.lit, t))
    old = counted.select(
        F.lit(MODEL).alias("model_urn"), urn.alias("urn"), F.lit("dataset").alias("entity_type"), (F.col("n") % 5 == 0).alias("deprecated"),
        F.when(F.col("c") % 4 == 0, none).otherwise(owner).alias("owners"),
        F.when(F.col("n") % 2 == 0, tag("urn:li:tag:Legacy.pii")).otherwise(none).alias("tags"),
    )
    new = counted.select(
        F.lit(MODEL).alias("model_urn"), urn.alias("urn"), F.lit("dataset").alias("entity_type"), (F.col("n") % 3 == 0).alias("deprecated"),
        F.when(F.col("c") % 2 == 0, none).otherwise(owner).alias("owners"),
        F.when(F.col("c") % 3 == 0, tag("urn:li:tag:PII", "urn:li:tag:blue")).when(F.col("c") % 3 == 1, tag("urn:li:glossaryTerm:Class.Restricted")).otherwise(none).alias("tags"),
        F.when(F.col("n") % 2 == 1, F.lit("use the new one")).alias("deprecation_note"),
    )
    column = lambda df, tags: df.select("model_urn", "urn", F.lit(0).alias("ord"), F.lit("text").alias("path"), tags.alias("tags"))
    old_columns = column(old, none)
    new_columns = column(new, F.when(F.size("owners") == 0, tag("GDPR")).otherwise(none))
    return Snapshot.of(old, old_columns).durable(), Snapshot.of(new, new_columns).durable()


# -- lineage: regions, nations, suppliers and parts -----------------------------


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model of a region → feature of a nation → supplier → part → another part, with cycles among parts."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").count()
    text = lambda c: F.col(c).cast("string")
    part = lambda c: dataset(F.concat(F.lit("part."), c.cast("string")))
    of_region = nation.select(model(F.concat(F.lit("region_"), text("n_regionkey"))).alias("src"), feature(text("n_nationkey")).alias("dst"), F.lit("Consumes").alias("relationship"), F.col("n_nationkey").cast("long").alias("seq"))
    of_nation = supplier.select(feature(text("s_nationkey")).alias("src"), dataset(F.concat(F.lit("supplier."), text("s_suppkey"))).alias("dst"), F.lit(None).cast("string").alias("relationship"), F.col("s_suppkey").alias("seq"))
    # Keys are made distinct, not the names made of them; hardly any come twice, so no task gathers its own first.
    pairs = lines.select("l_suppkey", "l_partkey").repartition("l_suppkey", "l_partkey").distinct()
    of_supplier = pairs.select(dataset(F.concat(F.lit("supplier."), text("l_suppkey"))).alias("src"), part(F.col("l_partkey")).alias("dst"), F.lit(None).cast("string").alias("relationship"), F.col("l_partkey").alias("seq"))
    of_part = lines.select("l_partkey").distinct().select(part(F.col("l_partkey")).alias("src"), part((F.col("l_partkey") * 7 + 3) % parts).alias("dst"), F.lit("DownstreamOf").alias("relationship"), ((F.col("l_partkey") * 7 + 3) % parts).alias("seq"))
    return of_region.unionByName(of_nation).unionByName(of_supplier).unionByName(of_part)


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without parts: every node has one way to its model."""
    return edges(spark, sf_dir).filter("dst not like '%,part.%' and src not like '%,part.%'")


def region_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(model(F.concat(F.lit("region_"), F.col("r_regionkey").cast("string"))).alias("model_urn"))


def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier columns from part columns, part columns from other parts' columns; one that several line items have can come as often."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").count()
    column = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    supplier = dataset(F.concat(F.lit("supplier."), F.col("l_suppkey").cast("string")))
    keys = lines.select("l_suppkey", (F.col("l_linenumber") % 3).alias("c"), "l_partkey", (F.col("l_linenumber") % 2).alias("p"))
    down = keys.select(supplier.alias("down_urn"), column("c", "c").alias("down_col"), _part("l_partkey").alias("up_urn"), column("p", "p").alias("up_col"))
    chain = lines.select("l_partkey").distinct().select(_part("l_partkey").alias("down_urn"), F.lit("p0").alias("down_col"), _part((F.col("l_partkey") * 7 + 3) % parts).alias("up_urn"), F.lit("p1").alias("up_col"))
    return down.unionByName(chain)


def fed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_urn, path): the columns that others come from by ``column_edges``."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").count()
    used = lines.select(F.col("l_partkey").alias("k"), (F.col("l_linenumber") % 2).alias("p")).repartition("k").distinct()
    chain = lines.select("l_partkey").distinct().select(((F.col("l_partkey") * 7 + 3) % parts).alias("k"), F.lit(1).alias("p"))
    return used.unionByName(chain).distinct().select(_part("k").alias("table_urn"), F.concat(F.lit("p"), F.col("p").cast("string")).alias("path"))


def _part(key) -> F.Column:
    return dataset(F.concat(F.lit("part."), (F.col(key) if isinstance(key, str) else key).cast("string")))


def supplier_columns(found: DataFrame) -> DataFrame:
    """Columns c0 to c2 of every supplier in a footprint."""
    own = found.filter("urn like '%,supplier.%'").select("model_urn", "urn")
    return own.select("model_urn", "urn", F.explode(F.array(*(F.lit(f"c{i}") for i in range(3)))).alias("path"))


# -- history: events as recorded runs --------------------------------------------


def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as verdict events: 20 models, severity by event type, counts from the JSON properties."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    severity = F.when(F.col("event_id") % 7 == 0, "BLOCK").when(F.col("event_id") % 3 == 0, "WARN").otherwise("CLEAR")
    kinds = F.when(severity == "WARN", F.concat_ws(",", F.upper("event_type"), F.when(k % 2 == 0, F.lit("MEAN_SHIFT")))).otherwise("")
    native = F.create_map(
        F.lit("severity"), severity, F.lit("blocking_count"), F.when(k % 5 == 0, F.lit("many")).otherwise(k.cast("string")),
        F.lit("warning_count"), (k % 4).cast("string"), F.lit("warning_kinds"), kinds,
    )
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("model_urn"), F.col("event_id").cast("string").alias("run_id"), millis.alias("millis"),
        F.when(F.col("event_id") % 11 == 0, None).when(severity == "BLOCK", "FAILURE").otherwise("SUCCESS").alias("result"), native.alias("native"),
    )

"""Shared helpers: hold-out folds, fresh names and a global row order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.durable import cut as materialize
from plumbline.functions.durable import made, shared_dir

__all__ = ["bucketed", "carried", "fold", "fresh", "global_index", "levels_of", "lower_ascii", "made", "materialize", "plainly", "shared_dir", "where"]


#: Buckets of a written table at most; Spark takes 100,000.
MAX_BUCKETS = 1 << 16


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """``df`` as a written table bucketed by ``key``, so that grouping by it needs no shuffle.

    A bucket holds several keys where there are more of them than MAX_BUCKETS.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"plumbline_{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", made(spark, label, table=name))
    writer.bucketBy(min(max(least, buckets), MAX_BUCKETS), key).saveAsTable(name)
    return spark.table(name)


def levels_of(nodes: int, fan: int) -> list[int]:
    """Ranges of keys at each level of the tree that brings ``fan`` nodes, then ``fan`` groups of them, together.

    A sender has rows for ``fan`` ranges or so, whatever the nodes; each level's ranges divide the next one's.
    """
    out, left = [], nodes
    while left > fan:
        out.append((out[-1] if out else 1) * fan)
        left = -(-left // fan)
    return [*out, (out[-1] if out else 1) * left]


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 5; a null identifier is in no fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)), F.lit(-1))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def where(df: DataFrame, name: str) -> int:
    """The place of the column ``name``: that of exactly this name, else one that differs in case only."""
    names = df.columns
    if name in names:
        return names.index(name)
    return [c.lower() for c in names].index(name.lower())


def carried(df: DataFrame, *made: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``df`` with its columns as c0, c1, ... by place, and (safe name, given name) of those that stay.

    Columns that ``made`` replaces don't stay, whatever the case of their letters; names with dots, quotes or
    blanks, and names that are there twice, travel under their safe names.
    """
    given, taken = df.columns, {m.lower() for m in made}
    safe = [f"c{i}" for i in range(len(given))]
    return df.toDF(*safe), [(s, g) for s, g in zip(safe, given) if g.lower() not in taken]


def plainly(df: DataFrame, *used: str) -> DataFrame:
    """``df`` with the columns ``used`` under just these names, and all others by place; ``toDF`` with the old names turns it back."""
    at = {where(df, u): u for u in used}
    return df.toDF(*(at.get(i, f"c{i}_") for i in range(len(df.columns))))


def global_index(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Adds ``out``, the row's place (from 0, gapless) in the order of the columns ``order``.

    A range partitioning sorts the rows; each partition numbers its own and adds the row counts
    of those before it. Ties are broken by the row's place in the input, so that a key that
    holds many rows is split over partitions too. Only the counts, one per partition, meet
    on the driver. The result is a written table.
    """
    spark = df.sparkSession
    tie, place = fresh(df, "tie_", "place_")
    keys = [F.col(c) for c in order] + [F.col(tie)]
    ranged = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop(tie)
        .withColumn(place, F.monotonically_increasing_id())
    )
    ranged = materialize(ranged, "ranged")
    part = F.shiftright(F.col(place), 33)
    before, offsets = 0, []
    for row in sorted(ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((row["part"], before))
        before += row["n"]
    (pid, base) = fresh(ranged, "part_", "base_")
    table = spark.createDataFrame(offsets or [(0, 0)], f"{pid} long, {base} long")
    return (
        ranged.withColumn(pid, part)
        .join(F.broadcast(table), pid)
        .withColumn(out, F.col(base) + F.col(place).bitwiseAND((1 << 33) - 1))
        .drop(pid, base, place)
    )

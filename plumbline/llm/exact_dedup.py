"""Exact deduplication by a log-structured merge index of text digests.

Built from DataFrame functions only. Writing goes through memtables: each input partition sorts
its (digest, identifier) entries and flushes them as a run of level 0. Compaction merges all runs by digest, each
task its own part of them first; of each digest it keeps the identifier at one end of the order (``keep``) and the
number of entries. Digests with two entries or more are hits. The filter of the compacted level, a bitmap over
the hits, is probed with every text's digest in a second scan and picks out the texts to verify, and
the bytes of all texts under a digest are compared. Where they differ, the texts themselves decide.

Defined results: null text counts as empty; a null identifier stays only where no other does; of repeated
rows (equal identifier and text) one stays; very long texts are hashed and compared in whole; other columns are carried
under any names; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, lower_ascii, materialize, plainly

#: Bits of the bitmap filter over hit digests at most (64 MB, for some 34 million hits); it is as small as the hits allow. Beyond it the filter lets more rows through; results do not change.
FILTER_BITS = 1 << 29
BUCKET_BITS = 32768


def digest_of(norm: Column) -> Column:
    """SHA-256 of the normalised text, as bytes."""
    return F.unhex(F.sha2(norm, 256))


def _slot(digest: Column, bits: int) -> Column:
    """A digest's place in the filter; taken from its last bytes."""
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def hit_filter(digests: DataFrame, count: int, bits_each: int = 16) -> tuple[DataFrame, int]:
    """Bitmap filter, a row per 32768 bits, over a table with the column ``digest``; about 1 in ``bits_each`` others pass."""
    bits = min(FILTER_BITS, max(BUCKET_BITS, 1 << math.ceil(math.log2(bits_each * count + 1))))
    slot = _slot(F.col("digest"), bits)
    table = (
        digests.select(slot.alias("slot"))
        .groupBy(F.expr(f"slot div {BUCKET_BITS}").alias("filter_bucket"))
        .agg(F.expr(f"bitmap_construct_agg(slot % {BUCKET_BITS})").alias("filter_bits"))
    )
    return table, bits


def flagged(df: DataFrame, digest: str, table: DataFrame, bits: int, flag: str) -> DataFrame:
    """Adds ``flag``: whether the digest may be in the filter, whose size FILTER_BITS bounds."""
    bucket, place, held = fresh(df, "bucket_", "slot_", "held_")
    small = table.select(F.col("filter_bucket").alias(bucket), F.col("filter_bits").alias(held))
    slot = F.col(place) % BUCKET_BITS
    byte = F.conv(F.hex(F.substring(F.col(held), (slot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), slot % 8)), F.lit(2)) == 1
    return (
        df.withColumn(place, _slot(F.col(digest), bits))
        .withColumn(bucket, F.expr(f"`{place}` div {BUCKET_BITS}"))
        .join(F.broadcast(small), bucket, "left")
        .withColumn(flag, F.coalesce(bit, F.lit(False)))
        .drop(bucket, place, held)
    )


def _normal(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def _best(keep: str) -> Column:
    if keep == "largest":
        return F.max(F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "row"))
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))


def flush_runs(docs: DataFrame, normalise=_normal, digest=digest_of) -> DataFrame:
    """Level 0: (doc_id, row, n_bytes, digest) of every row, each partition's run sorted by digest; a written table.

    ``row`` numbers the rows, to tell repeated ones apart; ``n_bytes`` is the text's size.
    """
    norm = normalise(F.col("text"))
    entries = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.octet_length(norm).cast("long").alias("n_bytes"), digest(norm).alias("digest")
    ).sortWithinPartitions("digest")
    return materialize(entries, "level0")


def compact(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Merges all runs: (digest, keep_id, keep_row, group_size), an entry per digest."""
    merged = runs.groupBy("digest").agg(_best(keep).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return merged.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


class Index:
    """The runs, the compacted level and the filter over hits of one table's texts."""

    def __init__(self, runs: DataFrame, level: DataFrame, normalise, digest, keep: str):
        self.runs, self.level, self.normalise, self.digest, self.keep = runs, level, normalise, digest, keep
        self.hits = level.filter("group_size > 1")
        self.hit_count = self.hits.count()
        self.filter = hit_filter(self.hits, self.hit_count) if self.hit_count else None

    @classmethod
    def build(cls, docs: DataFrame, keep: str = "smallest", normalise=_normal, digest=digest_of) -> Index:
        """``keep``: which identifier of equal texts stays, "smallest" or "largest"."""
        runs = flush_runs(docs, normalise, digest)
        return cls(runs, materialize(compact(runs, keep), "level1"), normalise, digest, keep)

    def rows(self) -> DataFrame:
        """Every row with the entry of its digest."""
        return self.runs.join(self.level, "digest")

    def texts_of_hits(self, docs: DataFrame) -> DataFrame:
        """(doc_id, norm, digest) of the rows that pass the hit filter: a second scan of the texts."""
        texts = docs.select("doc_id", self.normalise(F.col("text")).alias("norm")).withColumn("digest", self.digest(F.col("norm")))
        return flagged(texts, "digest", *self.filter, "hit").filter("hit").drop("hit")

    def differing(self, docs: DataFrame) -> DataFrame:
        """Digests under which the bytes of the texts differ.

        The smallest and the largest text of a digest, in byte order, are the same text only if all
        are. Each task reduces its own hits to these two before they are shuffled, so a text with
        very many copies is sent once per task.
        """
        ends = self.texts_of_hits(docs).groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        return ends.filter(F.col("low") != F.col("high")).select("digest")

    def collisions(self, docs: DataFrame) -> DataFrame | None:
        """The written table of ``differing``, or None where every hit is a true copy."""
        if not self.hit_count:
            return None
        found = materialize(self.differing(docs), "differing")
        return found if found.limit(1).count() else None

    def drop_copies(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the copies of any text, all columns kept.

        Rows of texts that occur once pass the filter without a shuffle; of the others, only the
        row with the kept identifier meets the index entry.
        """
        if not self.hit_count:
            return docs
        digest, flag, key, kept_id, norm, found = fresh(docs, "digest_", "hit_", "key_", "kept_id_", "norm_", "found_")
        named = docs.withColumn(norm, self.normalise(F.col("text")))
        named = flagged(named.withColumn(digest, self.digest(F.col(norm))), digest, *self.filter, flag)
        hits = named.filter(F.col(flag))
        collided = self.collisions(docs)
        clashed = None
        if collided is not None:
            # Texts under one digest that differ: there the text is the key.
            other = collided.select(F.col("digest").alias(found))
            clashed = hits.join(other, F.col(digest) == F.col(found), "left_semi")
            hits = hits.join(other, F.col(digest) == F.col(found), "left_anti")
        entries = flagged(self.level, "digest", *self.filter, "hit").filter("hit")
        entries = entries.select(F.col("digest").alias(key), F.col("keep_id").alias(kept_id))
        stays = hits.join(entries, (F.col(digest) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(kept_id))).dropDuplicates([key])
        out = named.filter(~F.col(flag)).select(docs.columns).unionByName(stays.select(docs.columns))
        if clashed is not None:
            best = F.max if self.keep == "largest" else F.min
            order = F.struct(F.col("doc_id").isNotNull() if self.keep == "largest" else F.col("doc_id").isNull(), "doc_id")
            own = clashed.groupBy(norm).agg(best(order)["doc_id"].alias(kept_id)).withColumnRenamed(norm, found)
            one = clashed.join(own, (F.col(norm) == F.col(found)) & F.col("doc_id").eqNullSafe(F.col(kept_id))).dropDuplicates([found])
            out = out.unionByName(one.select(docs.columns))
        return out


def exact_groups(docs: DataFrame, keep: str = "smallest", digest=digest_of) -> DataFrame:
    """A row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select("doc_id", "text")
    index = Index.build(docs, keep, digest=digest)
    kept = (F.col("row") == F.col("keep_row")).alias("kept")
    found = index.rows()
    collided = index.collisions(docs)
    if collided is None:
        return found.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))
    # Some digest holds several texts: there the texts themselves are the key.
    split = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("norm", _normal(F.col("text")))
    split = materialize(split.withColumn("digest", digest(F.col("norm"))).join(collided, "digest", "left_semi"), "collided")
    own = split.groupBy("digest", "norm").agg(_best(keep).alias("best"), F.count(F.lit(1)).alias("group_size"))
    redone = split.join(own, ["digest", "norm"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    rest = found.join(collided, "digest", "left_anti")
    return rest.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256")).unionByName(redone)


def drop_copies(docs: DataFrame, keep: str = "smallest", digest=digest_of) -> DataFrame:
    """``docs`` without the copies of any text (equal after lower-casing A-Z), all columns kept."""
    plain = plainly(docs, "doc_id", "text")
    return Index.build(plain, keep, digest=digest).drop_copies(plain).toDF(*docs.columns)

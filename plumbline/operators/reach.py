"""Walks of many seeds at once, by bitmap frontiers.

Seeds are numbered from 0, and SEEDS of them share a block. A level of a walk is a table of (urn, block, bits): bit
i says that seed i of the block reaches the node within so many hops. The next level sends the bits of
the nodes that have gained some along the edges, and takes their union by node and block with those seen
before; a node goes on only if its bits grew. So a level has a row per node and block, whatever the number of seeds in
it, and no row per seed and node; bitmaps are as wide as the seeds need, and mostly zeros shrink away in
a shuffle. The first level has one bit a seed and is built from single bits, not from bitmaps.

Only nodes of the wanted type are opened again, to a row per seed and node with the level at which the
bit came. Their paths are found backwards: from a node at level k to those at level k - 1 that have
the seed's bit and lead to it, keeping of several ways the one whose edges come first. Rows are then only on shortest ways to the
nodes that were found.

A bitmap of Spark takes its full width while it is added up, so where at most FEW nodes of the wanted type, or seeds,
are given, walks go by words: a long has the bits of WORD of them, and the level keeps which are new. From few wanted
nodes they go upwards, so that a million seeds need a row each, not one for each node that each of them reaches. Up to FORWARD seeds
for each wanted node go down, as what lies above all wanted nodes can be the whole graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.functions.durable import cut
from plumbline.functions.kinds import TRAVERSABLE

#: Seeds of a block: the bits of Spark's bitmap functions.
SEEDS = 1 << 15

#: Starts of a word: the bits of a long.
WORD = 64

#: Starts of a walk by words, at most, where it can go by bitmaps.
FEW = 1 << 10

#: Seeds for each wanted node up to which a walk by words goes down from the seeds.
FORWARD = 8


def numbered(seeds: DataFrame, size: int | None = None) -> DataFrame:
    """(seed, block, bit): the distinct seeds with gapless numbers, seeds of one partition side by side.

    A block has ``size`` of them, SEEDS if none is given. The driver gets the row counts of the partitions.
    """
    spark, size = seeds.sparkSession, size or SEEDS
    rows = cut(seeds.select("seed").filter("seed is not null").distinct().withColumn("at", F.monotonically_increasing_id()), "seeds")
    part = F.shiftright("at", 33)
    before, starts = 0, []
    for row in sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((row["part"], before))
        before += row["n"]
    base = spark.createDataFrame(starts or [(0, 0)], "part long, base long")
    placed = rows.withColumn("part", part).join(F.broadcast(base), "part")
    number = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.select("seed", F.floor(number / size).cast("int").alias("block"), (number % size).cast("int").alias("bit"))


def has_bit(bits: Column, bit: Column) -> Column:
    """Whether bit ``bit`` of a bitmap is set; beyond its end none is."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))


def levels_of(seeds: DataFrame, ways: DataFrame, max_hops: int) -> list[DataFrame]:
    """Level by level the nodes that gained seeds, (urn, block, bits); bits has all seeds met so far.

    ``seeds``: as of ``numbered``; ``ways``: (from, to, to_type). A seed's own node is walked whatever
    its type, others only if their type is TRAVERSABLE.
    """
    if max_hops < 1:
        return []
    most = seeds.agg(F.max(F.when(F.col("block") == 0, F.col("bit")))).first()[0]
    width = SEEDS // 8 if most is None else most // 8 + 1
    narrow = F.substring("bits", 1, width)
    first = seeds.select(F.col("seed").alias("from"), "block", "bit").join(ways, "from").groupBy("to", "to_type", "block")
    # A state has one row per node and block that any seed has reached, and says whether it gained seeds at this level.
    state = cut(first.agg(F.bitmap_construct_agg("bit").alias("bits")).select("to", "to_type", "block", narrow.alias("bits"), F.lit(True).alias("grown")), "level")
    levels = []
    for _ in range(max_hops):
        level = state.filter("grown").drop("grown")
        if not level.limit(1).count():
            break
        levels.append(level)
        if len(levels) == max_hops:
            break
        walked = level.filter(F.col("to_type").isin(*TRAVERSABLE)).select(F.col("to").alias("from"), "block", "bits")
        sent = walked.join(ways, "from").select("to", "to_type", "block", "bits", F.lit(0).alias("had"))
        both = sent.unionByName(state.select("to", "to_type", "block", "bits", F.bitmap_count("bits").alias("had"))).groupBy("to", "to_type", "block")
        now = both.agg(F.bitmap_or_agg("bits").alias("bits"), F.max("had").alias("had"))
        state = cut(now.select("to", "to_type", "block", narrow.alias("bits"), (F.bitmap_count("bits") > F.col("had")).alias("grown")), "level")
    return levels


def opened(levels: list[DataFrame], wanted: str) -> DataFrame:
    """(block, bit, urn, depth) of the nodes of the wanted type, each seed at the level where it came."""
    rows = [x.filter(F.col("to_type") == wanted).select("to", "block", F.lit(i + 1).alias("depth"), "bits") for i, x in enumerate(levels)]
    # Per node and block a row of bits for each level at most.
    grouped = reduce(DataFrame.unionByName, rows).groupBy("to", "block").agg(F.array_sort(F.collect_list(F.struct("depth", "bits"))).alias("came"))

    def run(batches):
        for b in batches:
            for to, block, came in zip(b.column("to").to_pylist(), b.column("block").to_pylist(), b.column("came").to_pylist()):
                seen = np.zeros(0, dtype=np.uint8)
                for step in came:
                    bits = np.frombuffer(step["bits"], dtype=np.uint8).copy()
                    now = bits.copy()
                    now[: len(seen)] &= ~seen[: len(now)]
                    fresh = np.flatnonzero(np.unpackbits(now, bitorder="little")).astype(np.int32)
                    n = len(fresh)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, block, dtype=np.int32)), pa.array(fresh), pa.array([to] * n, pa.string()), pa.array(np.full(n, step["depth"], dtype=np.int32))],
                        ["block", "bit", "urn", "depth"],
                    )
                    seen = bits

    return grouped.mapInArrow(run, "block int, bit int, urn string, depth int")


def walk(starts: DataFrame, ways: DataFrame, max_hops: int, through: tuple[str, ...] | None = None, count: Callable[[DataFrame], DataFrame] | None = None) -> list[DataFrame]:
    """Level by level from 0, the starts, (to, block, bits, fresh): which starts have met a node so far, and which first at this level.

    ``starts``: as of ``numbered`` with WORD; ``ways``: (from, to). Nodes are walked through if their type is one of ``through``, the starts
    always. ``count`` gets the ends of the edges of each level (to, block, bits, had) to observe them; had has the starts that met the end before.
    """
    none = F.lit(0).cast("bigint")
    bits = F.expr("shiftleft(1L, bit)")
    state = cut(starts.select(F.col("seed").alias("to"), "block", bits.alias("bits"), bits.alias("fresh")), "level")
    levels = [state]
    for depth in range(max_hops):
        front = state.filter("fresh <> 0")
        if depth and through is not None:
            front = front.filter(X.entity_type(F.col("to")).isin(*through))
        sent = front.select(F.col("to").alias("from"), "block", F.col("fresh").alias("bits")).join(ways, "from").select("to", "block", "bits")
        met = state.select("to", "block", F.col("bits").alias("had"))
        if count is None:
            sent = sent.withColumn("had", none)
        else:
            sent = count(sent.join(met, ["to", "block"], "left").withColumn("had", F.coalesce("had", none)))
        both = sent.unionByName(met.withColumn("bits", none)).groupBy("to", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("had").alias("had"))
        had, now = F.col("had"), F.col("bits")
        state = cut(both.select("to", "block", now.bitwiseOR(had).alias("bits"), now.bitwiseAND(F.bitwise_not(had)).alias("fresh")), "level")
        if not state.filter("fresh <> 0").limit(1).count():
            break
        levels.append(state)
    return levels


def spelled(levels: list[DataFrame], starts: DataFrame, first: int = 0) -> DataFrame:
    """(block, bit, start, urn, depth): the levels of ``walk`` from ``first`` on, a row for each start that came to a node."""
    rows = reduce(DataFrame.unionByName, (x.filter("fresh <> 0").select(F.col("to").alias("urn"), "block", "fresh", F.lit(i + first).alias("depth")) for i, x in enumerate(levels[first:])))
    bit = F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(fresh, i) & 1L) = 1L)"))
    return rows.select("urn", "block", "depth", bit.alias("bit")).join(starts.withColumnRenamed("seed", "start"), ["block", "bit"])


def reached(seeds: DataFrame, edges: DataFrame, wanted: str = "mlModel", max_hops: int = 6, paths: bool = True) -> DataFrame:
    """Nodes of the wanted type downstream of each seed: seed, urn, depth, and with ``paths`` path (from the seed on).

    ``edges``: (src, dst, seq), src depends on dst; walks go from dst to src. A seed doesn't reach itself. Walks go upwards
    from the wanted nodes where these are fewer and the seeds many.
    """
    ways = cut(edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), X.entity_type(F.col("src")).alias("to_type"), F.col("seq").cast("bigint").alias("seq")), "edges")
    named = cut(seeds.select("seed").filter("seed is not null").distinct(), "named")
    ends = cut(ways.filter(F.col("to_type") == wanted).select(F.col("to").alias("seed")).distinct(), "ends")
    n_seeds, n_ends = named.count(), ends.count()
    if not n_seeds or not n_ends or max_hops < 1:
        empty = named.limit(0).select("seed", F.col("seed").alias("urn"), F.lit(0).alias("depth"))
        return empty.withColumn("path", F.array("seed")) if paths else empty
    up, by_words = n_ends < n_seeds and n_seeds > min(FORWARD * n_ends, FEW), min(n_seeds, n_ends) <= FEW
    if by_words:
        starts = cut(numbered(ends if up else named, WORD), "numbered")
        along = ways.select(F.col("to").alias("from"), F.col("from").alias("to")) if up else ways.select("from", "to")
        levels = walk(starts, along, max_hops, TRAVERSABLE)
        if len(levels) == 1:
            levels.append(levels[0].limit(0))
        held = [x.filter(X.entity_type(F.col("to")).isin(*TRAVERSABLE)).select(F.col("to").alias("node"), "block", F.col("fresh").alias("bits")) for x in levels[1:]]
        if up:
            of_seeds = [x.join(named.select(F.col("seed").alias("to")), "to", "left_semi") for x in levels]
            found = spelled(of_seeds, starts, 1).select("block", "bit", F.col("urn").alias("seed"), F.col("start").alias("urn"), "depth")
        else:
            of_type = [x.filter(X.entity_type(F.col("to")) == wanted) for x in levels]
            found = spelled(of_type, starts, 1).withColumnRenamed("start", "seed")
            if paths:  # They are read for each level, and only those of met nodes can be on a path.
                met = reduce(DataFrame.unionByName, (x.select(F.col("to").alias("from")) for x in levels)).distinct()
                ways = cut(ways.join(met, "from", "left_semi"), "met")
    else:
        up, starts = False, cut(numbered(named), "numbered")
        levels = levels_of(starts, ways.select("from", "to", "to_type"), max_hops)
        held = [x.filter(F.col("to_type").isin(*TRAVERSABLE)).select(F.col("to").alias("node"), "block", "bits") for x in levels]
        found = opened(levels, wanted).join(starts, ["block", "bit"])
    found = found.filter(F.col("urn") != F.col("seed")).select("block", "bit", "seed", "urn", "depth")
    if not paths:
        return found.select("seed", "urn", "depth")
    return _with_paths(cut(found, "found"), held, ways, up, (lambda bits, bit: F.expr("shiftright(bits, bit) & 1L") == 1) if by_words else has_bit)


def _with_paths(found: DataFrame, held: list[DataFrame], ways: DataFrame, up: bool, has: Callable[[Column, Column], Column]) -> DataFrame:
    """``found`` (block, bit, urn, depth, seed) with the first of the shortest paths from the seed.

    ``held``: by level (node, block, bits) of the nodes that a path can go through. Paths are found from the node back to the seed,
    or, if the walk went ``up`` from the nodes, from the seed on.
    """
    keys = ["block", "bit", "seed", "urn", "depth"]
    here, there = ("from", "to") if up else ("to", "from")
    step = ways.select(F.col(here).alias("node"), F.col(there).alias("next"), "seq")
    none = F.array().cast("array<bigint>")
    begin, end = ("seed", "urn") if up else ("urn", "seed")
    start = lambda k: found.filter(F.col("depth") == k).select(*keys, F.col(begin).alias("node"), F.struct(none.alias("place"), F.array(begin).alias("path")).alias("way"))
    joined = lambda new, old: F.concat(old, F.array(new)) if up else F.concat(F.array(new), old)
    at = None
    for k in range(len(held), 0, -1):
        at = start(k) if at is None else at.unionByName(start(k))
        before = at.join(step, "node").select(
            *keys, F.col("next").alias("node"), F.struct(joined("seq", F.col("way.place")).alias("place"), joined("next", F.col("way.path")).alias("path")).alias("way")
        )
        if k == 1:
            before = before.filter(F.col("node") == F.col(end))
        else:
            before = before.join(held[k - 2], ["node", "block"]).filter(has(F.col("bits"), F.col("bit")))
        at = cut(before.groupBy(*keys, "node").agg(F.min("way").alias("way")), "ways")
    return at.select("seed", "urn", "depth", F.col("way.path").alias("path"))

"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of the ring; a row's identifier hashes to a place, and the next
point clockwise names its shard. Loads are bounded: what a full shard can't take continues
clockwise to the next shard with room, arc after arc, so that no shard holds more than its bound.
With ``slack`` 0 the bounds add up to the rows, and counts are at most one apart; a larger
slack moves fewer rows when shards are added. Ring, bounds and overflow need only the row
counts of the arcs, shards x vnodes numbers; rows find their place by their global rank.

Defined results: a null identifier hashes like any other value; rows are placed by their key alone, so empty and
very long texts are rows like others; rows with one key are split where a bound cuts them, and go by the columns
``order``, then by their place in the input; repeated rows get slots of their own; columns named shard or slot, in letters of any case, give way
to the result's, others may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import carried, global_index, where


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ring in order, and the shard that owns each."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            place = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big", signed=True)
            points.append((place, shard))
    points.sort()
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int64)


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold; they add up to ``total`` at least."""
    if slack <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [int(np.ceil(total / shards * (1 + slack)))] * shards


def overflow(counts: np.ndarray, owners: np.ndarray, capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank in the arc, rows, shard): who holds which ranks of each arc.

    Arcs offer their rows to their own shard first, in ring order; what is left then goes, arc by arc, to the next
    shards clockwise that have room. A point whose shard is full leads on to the next one.
    """
    n, room, left, taken = len(owners), list(capacity), counts.tolist(), [0] * len(owners)
    onward, out = list(range(n)), []

    def free(point):
        start = point
        while onward[point] != point or not room[owners[point]]:
            if onward[point] == point:
                onward[point] = (point + 1) % n
            point = onward[point]
        while start != point:
            onward[start], start = point, onward[start]
        return point

    def take(arc, shard):
        got = min(left[arc], room[shard])
        if got:
            out.append((arc, taken[arc], got, shard))
            room[shard] -= got
            left[arc] -= got
            taken[arc] += got

    for arc in range(n):
        take(arc, int(owners[arc]))
    for arc in range(n):
        while left[arc]:
            take(arc, int(owners[free(arc)]))
    return out


def assign(rows: DataFrame, key: str, shards: int, vnodes: int = 128, slack: float = 0.0, order: list[str] | None = None) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to ``rows``.

    ``order``: columns that order rows with one key; the result doesn't depend on the input's order.
    """
    places, owners = ring(shards, vnodes)
    place, arc_name, idx = "place", "arc", "idx"
    safe, kept = carried(rows, "shard", "slot")
    key, *order = (f"c{where(rows, c)}" for c in (key, *(order or [])))
    columns = [s for s, _ in kept]
    rows = safe.select(*dict.fromkeys([*columns, key, *order]))

    def arcs(batches):
        for b in batches:
            at = np.searchsorted(places, b.column(place).to_numpy(zero_copy_only=False), side="left") % len(places)
            yield b.append_column(arc_name, pa.array(at.astype(np.int32)))

    more = lambda schema, **kinds: T.StructType([*schema, *(T.StructField(n, k) for n, k in kinds.items())])
    hashed = rows.withColumn(place, F.xxhash64(key))
    placed = hashed.mapInArrow(arcs, more(hashed.schema, arc=T.IntegerType()))
    ranked = global_index(placed, [arc_name, place, key, *order], idx)
    counts = np.zeros(len(places), dtype=np.int64)
    for row in ranked.groupBy(F.col(arc_name).alias("arc")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["arc"]] = row["n"]
    starts = np.concatenate([[0], np.cumsum(counts)])
    segments = overflow(counts, owners, bounds(int(counts.sum()), shards, slack))
    filled, begin, slots, shard_of = [0] * shards, [], [], []
    for arc, first, n, shard in segments:
        begin.append(starts[arc] + first)
        slots.append(filled[shard])
        shard_of.append(shard)
        filled[shard] += n
    order_of = np.argsort(begin)
    begin, slots, shard_of = (np.array(x, dtype=np.int64)[order_of] for x in (begin, slots, shard_of))

    def slotted(batches):
        for b in batches:
            rank = b.column(idx).to_numpy(zero_copy_only=False)
            at = np.searchsorted(begin, rank, side="right") - 1
            out = b.append_column("shard", pa.array(shard_of[at].astype(np.int32)))
            yield out.append_column("slot", pa.array(slots[at] + (rank - begin[at])))

    out = ranked.mapInArrow(slotted, more(ranked.schema, shard=T.IntegerType(), slot=T.LongType()))
    return out.select(*columns, "shard", "slot").toDF(*(g for _, g in kept), "shard", "slot")

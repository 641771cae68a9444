"""Best-fit packing of token sequences with large-item matching.

Documents longer than the capacity are cut into pieces of full length; only the first may be
shorter. Added tokens of the vocabulary (``added``) that stand in a text are one identifier each, as the
tokenizers library has them. Lengths are then packed by their histogram: pieces above one third of the capacity,
of which at most two fit a bin, are matched greedily, the largest first with the largest that
fits beside it; smaller ones go, the largest first, into the fullest bin that has room. The
histogram has one number per length, so packing costs the driver the same at any input size;
bins with equal contents are kept as one pattern with a count. Pieces get their places by their
global rank among those of equal length.

Defined results: null text is empty and is one piece, the separator alone; repeated rows are pieces of
their own; ties among equal lengths go by identifier and piece; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe_replay import load_ranks
from plumbline.llm.common import global_index, materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece."""
    n = len(ids)
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def added_tokens(json_path: str) -> dict[str, int]:
    """Added tokens of a tokenizer's JSON file by content; only those that match as plain strings."""
    with open(json_path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    out = {t["content"]: t["id"] for t in tokens}
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens of {json_path} that are no plain strings")
    if any(a != b and a in b for a in out for b in out):
        raise ValueError(f"added tokens of {json_path} that hold each other")
    return out


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, capacity: int, separator: int = 0, added: dict[str, int] | None = None) -> DataFrame:
    """The pieces of every document as a written table: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        import tiktoken

        coder = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens=added or {})
        encode = lambda t: coder.encode(t, allowed_special="all") if any(a in t for a in added or ()) else coder.encode_ordinary(t)
        for b in batches:
            rows = []
            ids_of = (encode(t.as_py() or "") for t in b.column("text"))
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), ids_of):
                ids = np.array([*ids, separator], dtype="<u4")
                for k, (start, length) in enumerate(cut(ids, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return materialize(docs.select("doc_id", "text").mapInArrow(run, PIECES), "pieces")


def match_large(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins of the large lengths, (contents, count); takes them out of ``left``."""
    bins = []
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((s for s in large if s <= capacity - a and left[s] > (s == a)), None)
            if b is None:
                bins.append(((a,), left[a]))
                left[a] = 0
            else:
                n = left[a] // 2 if a == b else min(left[a], left[b])
                bins.append(((a, b), n))
                left[a] -= n
                left[b] -= n
    return bins


def pack(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a bin, in order) with counts, that hold the histogram's pieces."""
    left = defaultdict(int, histogram)
    open_bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    has = np.zeros(capacity + 1, dtype=bool)

    def put(contents, count):
        gap = capacity - sum(contents)
        open_bins[gap][contents] = open_bins[gap].get(contents, 0) + count
        has[gap] = True

    for contents, count in match_large(left, capacity):
        put(contents, count)
    for s in sorted((s for s in left if left[s]), reverse=True):
        n = left[s]
        while n:
            fits = np.flatnonzero(has[s:])
            if not len(fits):
                per = capacity // s
                if n >= per:
                    put((s,) * per, n // per)
                    n %= per
                if n:
                    put((s,) * n, 1)
                    n = 0
                break
            gap = s + int(fits[0])
            contents, count = open_bins[gap].popitem()
            taken = min(n, count)
            if taken < count:
                open_bins[gap][contents] = count - taken
            has[gap] = bool(open_bins[gap])
            put((*contents, s), taken)
            n -= taken
    return sorted(x for bins in open_bins for x in bins.items())


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By rank of pieces ordered by length: (first rank, first sequence, offset) of each segment."""
    segments, sequence = [], 0
    for contents, count in patterns:
        offset = 0
        for s in contents:
            segments.append((s, sequence, offset, count))
            offset += s
        sequence += count
    segments.sort()
    table = np.array(segments, dtype=np.int64).reshape(-1, 4)
    return np.cumsum(table[:, 3]) - table[:, 3], table[:, 1], table[:, 2]


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset (long) to a table with the columns of ``tokenize``."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    begin, first, offset = places(pack(histogram, capacity))
    ranked = global_index(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), ["length", "doc_id", "piece", "ids_crc32"])

    def placed(batches):
        for b in batches:
            idx = b.column("idx").to_numpy(zero_copy_only=False)
            at = np.searchsorted(begin, idx, side="right") - 1
            out = b.append_column("sequence_id", pa.array(first[at] + (idx - begin[at])))
            yield out.append_column("offset", pa.array(offset[at]))

    return ranked.mapInArrow(placed, f"{PIECES}, idx long, sequence_id long, offset long").drop("idx")


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, added: dict[str, int] | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(tokenize(docs, ranks_path, pattern, capacity, added=added), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id"), F.col("offset")
    )

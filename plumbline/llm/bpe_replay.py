"""Byte-level BPE encoding and decoding by merge replay over the corpus' distinct words.

Texts are split once into words (matches of the pattern). A chunk of texts is written as its distinct words and, for
every text, the places of its words among them. Chunks send their distinct words, packed, to ranges of a
hash, FAN chunks at a time in a tree; at its top each distinct word of the corpus is there once, and a range's words are laid out in one
array of byte tokens. An inverted index leads from each mergeable pair, named by its rank, to its positions in
all words. A heap replays the merges in rank order; each updates the pairs to its left and right only. Within a word the
lowest rank goes first, the leftmost first among equals, and a merge that makes a pair of a lower rank yields to it,
which is the order of the rank file's own library.

The ids go back to the chunks the way the words came, in the words' order. Texts themselves are never shuffled.
Decoding goes through the ids' bytes.

Defined results: null text counts as empty and has no ids; words may be as long as a text, in time
n log n, and a very long text is a chunk of its own; repeated rows are encoded each, a null identifier stays null; only
doc_id and text are read, so no other column clashes; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bucketed, levels_of, materialize

#: Pairs of tokens whose ranks are remembered.
CACHE_PAIRS = 400_000
#: Characters of text in a chunk, unless a single text is longer.
CHUNK_CHARS = 16 << 20
#: Chunks, or groups of them, that meet at one place of the tree.
FAN = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def id_type(ranks: dict[bytes, int]) -> type:
    """The smallest type that holds every id of a vocabulary."""
    return np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32


class MergeReplay:
    """Encodes lists of distinct words by replaying merges over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: Rank of each pair of bytes, -1 where the vocabulary has no such merge.
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int64)
        self.shift = max(self.bytes_of).bit_length()
        self.pairs: dict[int, int] = {}

    def rank_of(self, left: int, right: int) -> int:
        """Rank of the merged pair, -1 where the vocabulary has no such merge."""
        key = left << self.shift | right
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.pairs[key] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return rank

    def index(self, words: list[bytes]) -> tuple[list[int], list[int], list[int], dict[int, list[int]]]:
        """The words' byte tokens end to end, the places after and before each, and places by rank."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        n = len(data)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        rank = self.byte_pairs[data[:-1], data[1:]] if n > 1 else np.zeros(0, dtype=np.int64)
        places = np.flatnonzero((rank >= 0) & (after[:-1] >= 0)) if n > 1 else np.zeros(0, dtype=np.int64)
        places = places[np.argsort(rank[places], kind="stable")]
        found, first = np.unique(rank[places], return_index=True)
        where = {r: p.tolist() for r, p in zip(found.tolist(), np.split(places, first[1:]))} if len(found) else {}
        return self.byte_ids[data].tolist(), after.tolist(), before.tolist(), where

    def encode(self, words: list[bytes]) -> list[list[int]]:
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        split = [w for w in words if w not in self.ranks]
        tokens, after, before, where = self.index(split)
        heap = list(where)
        heapify(heap)
        rank_of = self.rank_of
        while heap:
            rank = heappop(heap)
            spots = where.pop(rank, None)
            if spots is None:
                continue
            spots.sort()
            # Ranks met while this one is replayed: of its pair, and of the pairs to its right and left.
            own: tuple[int, int] | None = None
            rights: dict[int, int] = {}
            lefts: dict[int, int] = {}
            for k, i in enumerate(spots):
                j = after[i]
                a = tokens[i]
                if j < 0 or a < 0:
                    continue
                b = tokens[j]
                if (a, b) != own:
                    if rank_of(a, b) != rank:
                        continue
                    own = (a, b)
                tokens[i], tokens[j] = rank, -1
                right = after[i] = after[j]
                left, lower = before[i], False
                if right >= 0:
                    before[right] = i
                    b = tokens[right]
                    new = rights.get(b)
                    if new is None:
                        new = rights[b] = rank_of(rank, b)
                    if new >= 0:
                        if new in where:
                            where[new].append(i)
                        else:
                            where[new] = [i]
                            heappush(heap, new)
                        lower = new <= rank
                if left >= 0:
                    a = tokens[left]
                    new = lefts.get(a)
                    if new is None:
                        new = lefts[a] = rank_of(a, rank)
                    if new >= 0:
                        if new in where:
                            where[new].append(left)
                        else:
                            where[new] = [left]
                            heappush(heap, new)
                        lower = lower or new <= rank
                if lower:
                    if rank not in where:
                        where[rank] = []
                        heappush(heap, rank)
                    where[rank].extend(spots[k + 1 :])
                    break
        out, at = [], 0
        for w in words:
            if w in self.ranks:
                out.append([self.ranks[w]])
            else:
                out.append([t for t in tokens[at : at + len(w)] if t >= 0])
                at += len(w)
        return out


def split_chunks(docs: DataFrame, pattern: str) -> tuple[DataFrame, int]:
    """A table bucketed by chunk, a row per chunk: chunk, doc_ids, sizes (words of each text), places, words; and a bound on chunks.

    ``words``: the distinct words; ``places``: of every word of the texts, its place there, in 2 bytes where they are
    few and in 4 otherwise.
    """

    def run(batches):
        # Two neighbouring chunks of a task have more than CHUNK_CHARS together, so it has fewer than ``stride``.
        split, number = regex.compile(pattern).findall, TaskContext.get().partitionId() * stride
        index: dict[str, int] = {}
        ids, sizes, places, held = [], [], [], 0

        def row():
            kind = np.uint16 if len(index) <= 1 << 16 else np.uint32
            packed = np.concatenate(places).astype(kind) if places else np.zeros(0, kind)
            made = [[number], [ids], [np.array(sizes, dtype=np.int32).tobytes()], [packed.tobytes()], [list(index)]]
            types = [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types)], names=["chunk", "doc_ids", "sizes", "places", "words"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py() or ""
                if ids and held + len(text) > CHUNK_CHARS:
                    yield row()
                    index, ids, sizes, places, held = {}, [], [], [], 0
                    number += 1
                words = split(text)
                ids.append(doc_id)
                sizes.append(len(words))
                places.append(np.array([index.setdefault(w, len(index)) for w in words], dtype=np.uint32))
                held += len(text)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_task = rows.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("size"))
    size, most = by_task.agg(F.sum("size"), F.max("size")).first()
    size, stride = size or 0, 2 * (most or 0) // CHUNK_CHARS + 2
    split = rows.mapInArrow(run, "chunk int, doc_ids array<long>, sizes binary, places binary, words array<string>")
    split = bucketed(split, "chunk", -(-size // CHUNK_CHARS), "chunks")
    return split, (split.agg(F.max("chunk")).first()[0] or 0) + 1


SENT = "node int, bucket long, sizes binary, data binary"


def packed_words(words: list[bytes]) -> tuple[bytes, bytes]:
    """Sizes and bytes of words, end to end."""
    return np.array(list(map(len, words)), dtype=np.uint32).tobytes(), b"".join(words)


def unpacked_words(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, dtype=np.uint32), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def ranges_of(words: list[bytes], ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words by the range of their hash: their order, the ranges in use, and where each begins; one rule for sending and for reading answers."""
    bucket = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % ranges
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    return order, found, begin


def sent_words(node: int, words: list[bytes], ranges: int) -> pa.Table:
    """Rows SENT of a node's distinct words, one per range."""
    order, found, begin = ranges_of(words, ranges)
    packed = [packed_words([words[i] for i in order[a:b].tolist()]) for a, b in zip(begin, [*begin[1:], len(words)])]
    columns = [[node] * len(found), found.tolist(), [x[0] for x in packed], [x[1] for x in packed]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "bucket", "sizes", "data"])


def answers(table: pa.Table, ids: dict[bytes, bytes]) -> pa.Table:
    """For each row SENT the ids of its words, in its order."""
    packed = [packed_words([ids[w] for w in unpacked_words(s, d)]) for s, d in zip(table.column("sizes").to_pylist(), table.column("data").to_pylist())]
    return pa.table([table.column("node"), table.column("bucket"), pa.array([x[0] for x in packed], pa.binary()), pa.array([x[1] for x in packed], pa.binary())], names=["node", "bucket", "sizes", "data"])


def distinct_words(table: pa.Table) -> list[bytes]:
    return list(dict.fromkeys(w for s, d in zip(table.column("sizes").to_pylist(), table.column("data").to_pylist()) for w in unpacked_words(s, d)))


def replayed(sent: DataFrame, levels: list[int], ranks_path: str) -> DataFrame:
    """The rows SENT with ids in place of words: every distinct word of the corpus goes through one replay.

    Up the tree, the nodes of a group send their distinct words on; the top replays them, range by range, and
    the ids go down the same way.
    """
    if len(levels) == 1:

        def top(table: pa.Table) -> pa.Table:
            words, replay = distinct_words(table), replay_of(ranks_path)
            kind = id_type(replay.ranks)
            return answers(table, {w: np.array(i, dtype=kind).tobytes() for w, i in zip(words, replay.encode(words))})

        return sent.groupBy("bucket").applyInArrow(top, SENT)

    def up(table: pa.Table) -> pa.Table:
        return sent_words(table.column("node")[0].as_py() // FAN, distinct_words(table), levels[1])

    def told(table: pa.Table, above: pa.Table) -> pa.Table:
        words = distinct_words(table)
        order = ranges_of(words, levels[1])[0].tolist()
        by_range = above.sort_by("range_")
        got = [i for s, d in zip(by_range.column("sizes").to_pylist(), by_range.column("data").to_pylist()) for i in unpacked_words(s, d)]
        return answers(table, dict(zip((words[i] for i in order), got)))

    sent = materialize(sent.withColumn("above", (F.col("node") / FAN).cast("int")), "sent")
    above = replayed(sent.groupBy("bucket", "above").applyInArrow(up, SENT), levels[1:], ranks_path)
    above = above.withColumn("range_", F.col("bucket")).withColumn("bucket", F.col("bucket") % levels[0])
    return sent.groupBy("bucket", "above").cogroup(above.groupBy("bucket", "node")).applyInArrow(told, SENT)


@functools.lru_cache(maxsize=1)
def replay_of(ranks_path: str) -> MergeReplay:
    """A worker's replay, which stays for its next range."""
    return MergeReplay(load_ranks(ranks_path))


def by_chunk(docs: DataFrame, ranks_path: str, pattern: str, finish: Callable[[list[np.ndarray], list[np.ndarray]], list[pa.Array]], names: str) -> DataFrame:
    """A row per row of ``docs``: doc_id and the columns ``names`` that ``finish`` makes of a chunk.

    ``finish`` gets the ids of each distinct word of the chunk, and for each text the places of its words.
    """
    split, count = split_chunks(docs, pattern)
    levels, kind = levels_of(max(1, count), FAN), id_type(load_ranks(ranks_path))

    def send(table: pa.Table) -> pa.Table:
        rows = zip(table.column("chunk").to_pylist(), table.column("words").to_pylist())
        return pa.concat_tables([sent_words(chunk, [w.encode() for w in words], levels[0]) for chunk, words in rows])

    ids = replayed(split.select("chunk", "words").groupBy("chunk").applyInArrow(send, SENT), levels, ranks_path).withColumnRenamed("node", "chunk")
    schema = pa.schema([("doc_id", pa.int64()), *((n.split()[0], {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[n.split()[1]]) for n in names.split(", "))])

    def assemble(chunk: pa.Table, ids: pa.Table) -> pa.Table:
        (doc_ids,), (sizes,), (places,), (words,) = (chunk.column(c).to_pylist() for c in ("doc_ids", "sizes", "places", "words"))
        order = ranges_of([w.encode() for w in words], levels[0])[0]
        n = len(words)
        del words
        by_range = ids.sort_by("bucket")
        found: list = [None] * n
        got = (i for s, d in zip(by_range.column("sizes").to_pylist(), by_range.column("data").to_pylist()) for i in unpacked_words(s, d))
        for place, packed in zip(order.tolist(), got):
            found[place] = np.frombuffer(packed, dtype=kind)
        places = np.frombuffer(places, dtype=np.uint16 if n <= 1 << 16 else np.uint32)
        texts = np.split(places, np.cumsum(np.frombuffer(sizes, dtype=np.int32))[:-1])
        return pa.table([pa.array(doc_ids, pa.int64()), *finish(found, texts)], schema=schema)

    return split.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(assemble, f"doc_id long, {names}")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """A row per row of ``docs``: doc_id, ids (array)."""

    def finish(found, texts):
        return [pa.array([np.concatenate([found[p] for p in places.tolist()]) if len(places) else np.zeros(0, np.int32) for places in texts], pa.list_(pa.int32()))]

    return by_chunk(docs, ranks_path, pattern, finish, "ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """A row per row of ``encoded``: doc_id, data (binary), the bytes of its ids."""

    def run(batches):
        bytes_of = {rank: token for token, rank in load_ranks(ranks_path).items()}
        for b in batches:
            data = [b"".join(map(bytes_of.__getitem__, ids)) if ids else b"" for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids of a word are written out and decoded once per chunk.
    """
    tokens: dict[int, bytes] = {}

    def finish(found, texts):
        if not tokens:
            tokens.update((rank, token) for token, rank in load_ranks(ranks_path).items())
        ids = [i.tolist() for i in found]
        size = np.array(list(map(len, ids)), dtype=np.int64)
        shown = [" ".join(map(str, i)) for i in ids]
        decoded = [b"".join([tokens[t] for t in i]) for i in ids]
        n_tokens, ids_sha, data_sha = [], [], []
        for places in texts:
            n_tokens.append(int(size[places].sum()))
            own = places.tolist()
            ids_sha.append(hashlib.sha256(" ".join([shown[p] for p in own]).encode()).hexdigest())
            data_sha.append(hashlib.sha256(b"".join([decoded[p] for p in own])).hexdigest())
        return [pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())]

    return by_chunk(docs, ranks_path, pattern, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Language-model scores by subword lattice likelihood.

Pieces come from an existing vocabulary; a piece model gives each a probability, and a text's
score is the log10 probability that any segmentation makes it: the forward recursion in log space sums
over all paths of the lattice. No piece crosses a word's end, so the recursion runs once per
distinct word (with the word-start mark in front), and a text's score is the sum over its words
and its end. Characters without a piece go through the vocabulary's byte pieces.

The vocabulary at hand has merge ranks for scores, not probabilities. They give the first weights;
``ROUNDS`` of expectation maximisation over all distinct words of the training texts, weighted by
their counts, turn them into piece probabilities. The first weights stay in as PRIOR_USES uses, at any size of the
corpus; without training texts they are all there is.

Words of the corpus are counted with a shuffle; their values come back to the texts through a
broadcast of the words most frequent in all texts, within HEAD_WORDS and HEAD_BYTES, and a join for all others.

Defined results: null text is empty and has the end token alone; without training texts the counts
are 0; repeated rows are scored each; a null identifier is a training text; words may be very long, in time
linear in their length; of words equally frequent the broadcast takes the first in order, which changes no score; only
doc_id and text are read, so no other column clashes; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fold, materialize

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WORD_START = "▁"
HELD_OUT_FOLD = 1
#: Words whose values are broadcast at most, and the bytes of all of them; all other words are joined.
HEAD_WORDS = 1 << 17
HEAD_BYTES = 8 << 20
ROUNDS = 2
#: Uses that the first weights count for, beside the expected uses in the training texts.
PRIOR_USES = 320.0
#: Words of one length that the recursion takes at a time.
LATTICE_CHARS = 1 << 17
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 20


def words_of(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased."""
    return WORD.findall((text or "").encode().lower())


class Pieces:
    """The vocabulary: piece strings, found by hash, 256 byte pieces after them, and the end."""

    def __init__(self, strings: list[str], ranks: list[float]):
        self.strings = strings
        self.n = len(strings)
        self.end = self.n + 256
        self.size = self.n + 257
        self.longest = max(map(len, strings), default=1)
        weight = 1.0 / (np.array(ranks, dtype=float) + 10.0)
        first = np.concatenate([weight, np.full(256, weight.min() if self.n else 1.0), [weight.max() if self.n else 1.0]])
        self.first = first / first.sum()
        hashes = np.zeros(self.n, dtype=np.uint64)
        for length in sorted(set(map(len, strings))):
            which = [i for i, s in enumerate(strings) if len(s) == length]
            points = np.array([list(map(ord, strings[i])) for i in which], dtype=np.uint64)
            h = np.zeros(len(which), dtype=np.uint64)
            for k in range(length):
                h = h * BASE + points[:, k] + np.uint64(1)
            hashes[which] = h
        self.levels = []
        left = np.arange(self.n)
        salt = 1
        while len(left):
            multiplier = np.uint64((0xBF58476D1CE4E5B9 * salt) & (2**64 - 1) | 1)
            slot = (hashes[left] * multiplier) >> np.uint64(64 - TABLE_BITS)
            _, at = np.unique(slot, return_index=True)
            held, ids = np.zeros(1 << TABLE_BITS, dtype=np.uint64), np.full(1 << TABLE_BITS, -1, dtype=np.int32)
            held[slot[at]], ids[slot[at]] = hashes[left[at]], left[at]
            self.levels.append((multiplier, held, ids))
            left = np.delete(left, at)
            salt += 2

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls([model.id_to_piece(i) for i in ids], [-model.get_score(i) for i in ids])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        out = np.full(h.shape, -1, dtype=np.int32)
        for multiplier, held, ids in self.levels:
            slot = (h * multiplier) >> np.uint64(64 - TABLE_BITS)
            got = ids[slot]
            out = np.where((held[slot] == h) & (got >= 0), got, out)
        return out

    def edges(self, points: np.ndarray) -> list[np.ndarray]:
        """Piece ids by length - 1 and start, for words of one length (a row of code points each)."""
        n, size = points.shape
        prefix = np.zeros((n, size + 1), dtype=np.uint64)
        for k in range(size):
            prefix[:, k + 1] = prefix[:, k] * BASE + points[:, k].astype(np.uint64) + np.uint64(1)
        out = []
        for length in range(1, min(size, self.longest) + 1):
            power = np.uint64(pow(int(BASE), length, 1 << 64))
            out.append(self.find(prefix[:, length:] - prefix[:, : size + 1 - length] * power))
        return out


def byte_logs(points: np.ndarray, logs: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Log probability of spelling each code point by byte pieces."""
    found, inverse = np.unique(points, return_inverse=True)
    own = np.array([logs[[pieces.n + b for b in chr(p).encode()]].sum() for p in found.tolist()])
    return own[inverse].reshape(points.shape)


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(terms)
    top = stacked.max(axis=0)
    return top + np.log(np.exp(stacked - top).sum(axis=0))


def forward(points: np.ndarray, logs: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Forward sums at every place, the edges and their logs, and the byte pieces' logs."""
    n, size = points.shape
    ids = pieces.edges(points)
    scores = [np.where(i >= 0, logs[i], -np.inf) for i in ids]
    spelled = byte_logs(points, logs, pieces)
    scores[0] = np.logaddexp(scores[0], spelled)
    alpha = np.zeros((n, size + 1))
    for k in range(1, size + 1):
        alpha[:, k] = log_sum([alpha[:, k - length] + scores[length - 1][:, k - length] for length in range(1, min(k, len(ids)) + 1)])
    return alpha, ids, scores, spelled


def expected(points: np.ndarray, weights: np.ndarray, logs: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, float]:
    """Expected uses of every piece over words of one length, each counted ``weights`` times, and the log probability of all."""
    n, size = points.shape
    alpha, ids, scores, spelled = forward(points, logs, pieces)
    beta = np.zeros((n, size + 1))
    for k in range(size - 1, -1, -1):
        beta[:, k] = log_sum([beta[:, k + length] + scores[length - 1][:, k] for length in range(1, min(size - k, len(ids)) + 1)])
    total = alpha[:, -1:]
    out = np.zeros(pieces.size)
    for length, (i, s) in enumerate(zip(ids, scores), start=1):
        share = np.exp(alpha[:, : size + 1 - length] + s + beta[:, length:] - total) * weights[:, None]
        if length == 1:
            by_bytes = share * np.exp(spelled - s)
            found, inverse = np.unique(points, return_inverse=True)
            for p, used in zip(found.tolist(), np.bincount(inverse.ravel(), by_bytes.ravel()).tolist()):
                for b in chr(p).encode():
                    out[pieces.n + b] += used
            share = share - by_bytes
        known = i >= 0
        out += np.bincount(i[known], share[known], pieces.size)
    return out, float(total[:, 0] @ weights)


def by_length(words: list[str]):
    """Groups of words of one length: (indexes, code points with the word-start mark)."""
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lengths.setdefault(len(w) + 1, []).append(i)
    for size, which in lengths.items():
        step = max(1, LATTICE_CHARS // size)
        for at in range(0, len(which), step):
            some = which[at : at + step]
            text = "".join(WORD_START + words[i] for i in some)
            yield some, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(some), size).astype(np.int64)


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(word, n, seen): count of every word in training texts and in all; and the training texts."""

    def run(batches):
        for b in batches:
            counts: Counter = Counter()
            others: Counter = Counter()
            for text, trained in zip(b.column("text").to_pylist(), b.column("trained").to_pylist()):
                (counts if trained else others).update(words_of(text))
            found = list(counts | others)
            numbers = np.array([(counts[w], counts[w] + others[w]) for w in found], dtype=np.int64).reshape(-1, 2)
            words = pa.array(found, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array(numbers[:, 0].copy()), pa.array(numbers[:, 1].copy())], names=["word", "n", "seen"])

    marked = docs.select("text", (fold(F.col("doc_id")) != HELD_OUT_FOLD).alias("trained"))
    counted = marked.mapInArrow(run, "word string, n long, seen long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    return materialize(counted, "words"), docs.filter(fold(F.col("doc_id")) != HELD_OUT_FOLD).count()


def learn(words: DataFrame, texts: int, pieces: Pieces, rounds: int = ROUNDS, likelihoods: list[float] | None = None) -> np.ndarray:
    """Probabilities of the pieces; each round sums expected uses, one number per piece, over all words.

    ``likelihoods`` gets the log10 probability of all training texts under the pieces that each round starts from.
    """
    spark = words.sparkSession
    probabilities = pieces.first
    held = spark.sparkContext.broadcast(pieces)
    for _ in range(rounds):
        logs = spark.sparkContext.broadcast(np.log(probabilities))

        def run(batches, logs=logs):
            pieces, total, whole = held.value, None, 0.0
            for b in batches:
                numbers = b.column("n").to_numpy(zero_copy_only=False).astype(float)
                total = np.zeros(pieces.size) if total is None else total
                for which, points in by_length(b.column("word").to_pylist()):
                    used, log = expected(points, numbers[which], logs.value, pieces)
                    total += used
                    whole += log
            if total is not None:
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int64)), pa.array(np.append(total[used], whole))], names=["piece", "uses"])

        uses = PRIOR_USES * pieces.first
        uses[pieces.end] += texts
        logs_end = texts * np.log(probabilities[pieces.end])
        for row in words.filter("n > 0").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            if row["piece"] < 0:
                logs_end += row["uses"]
            else:
                uses[row["piece"]] += row["uses"]
        if likelihoods is not None:
            likelihoods.append(float(logs_end / np.log(10)))
        probabilities = uses / uses.sum()
    return probabilities


def value_words(words: DataFrame, train_tokens: int, distinct: int, probabilities: np.ndarray, pieces: Pieces) -> DataFrame:
    """(word, n, seen, lattice, base): log10 values of every word, as a written table."""
    spark = words.sparkSession
    held, logs = spark.sparkContext.broadcast(pieces), spark.sparkContext.broadcast(np.log(probabilities))

    def run(batches):
        pieces = held.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for which, points in by_length(b.column("word").to_pylist()):
                out[which] = forward(points, logs.value, pieces)[0][:, -1]
            yield b.append_column("lattice", pa.array(out / np.log(10)))

    base = F.log10((F.col("n") + 0.5) / F.lit(train_tokens + 0.5 * (distinct + 1)))
    return materialize(words.mapInArrow(run, "word string, n long, seen long, lattice double").withColumn("base", base), "values")


def most_frequent(values: DataFrame) -> dict[bytes, tuple[float, float, bool]]:
    """Values (base, lattice, whether it is in a training text) of the words most frequent in all texts, HEAD_WORDS words and HEAD_BYTES bytes at most."""
    out, held = {}, 0
    frequent = values.filter(F.octet_length("word") <= HEAD_BYTES // 64).orderBy(F.desc("seen"), "word").limit(HEAD_WORDS)
    for row in frequent.select("word", "base", "lattice", "n").toLocalIterator():
        word = row["word"].encode()
        held += len(word)
        if held > HEAD_BYTES:
            break
        out[word] = (row["base"], row["lattice"], row["n"] > 0)
    return out


def score_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    pieces = Pieces.from_model(model_path)
    words, texts = count_words(docs)
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    train_tokens, distinct = sums["tokens"] + texts, sums["distinct"] + (texts > 0)
    probabilities = learn(words, texts, pieces)
    values = value_words(words, train_tokens, distinct, probabilities, pieces)
    head = spark.sparkContext.broadcast(most_frequent(values))
    end = (float(np.log10((texts + 0.5) / (train_tokens + 0.5 * (distinct + 1)))), float(np.log10(probabilities[pieces.end])))

    def run(batches):
        known = head.value
        for b in batches:
            rows: list[tuple] = []
            for doc_id, uid, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "uid", "text"))):
                found = words_of(text)
                n_known, base, lattice = int(texts > 0), end[0], end[1]
                for w, n in Counter(found).items():
                    got = known.get(w)
                    if got is None:
                        rows.append((uid, None, w, n, None, None, None))
                    else:
                        n_known += n if got[2] else 0
                        base += n * got[0]
                        lattice += n * got[1]
                # A key with a space is no word: this row meets nothing in the join.
                rows.append((uid, doc_id, b" %d" % uid, len(found) + 1, n_known, base, lattice))
            uid, doc_id, key, k, n_known, base, lattice = list(zip(*rows)) or [()] * 7
            numbers = [pa.array(x, pa.int64()) for x in (uid, doc_id, k, n_known)] + [pa.array(x, pa.float64()) for x in (base, lattice)]
            yield pa.RecordBatch.from_arrays(
                [*numbers, pa.array(key, pa.binary()).cast(pa.string())], names=["uid", "doc_id", "k", "own_known", "own_base", "own_lattice", "key"]
            )

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text")
    parts = numbered.mapInArrow(run, "uid long, doc_id long, k long, own_known long, own_base double, own_lattice double, key string")
    joined = parts.join(values, F.col("key") == F.col("word"), "left")
    tail = F.col("word").isNotNull()
    per = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(~tail, F.col("k"))).alias("n_tokens"),
        F.sum(F.when(tail & (F.col("n") > 0), F.col("k")).when(tail, F.lit(0)).otherwise(F.col("own_known"))).alias("n_known"),
        F.sum(F.when(tail, F.col("k") * F.col("base")).otherwise(F.col("own_base"))).alias("base_score"),
        F.sum(F.when(tail, F.col("k") * F.col("lattice")).otherwise(F.col("own_lattice"))).alias("score"),
    )
    return per.select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )

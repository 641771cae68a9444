"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct lower-cased words and their stems, the first letters of longer words,
each hashed to one of ``DIM`` features. The machine adds to the linear weights of the terms
the inner products of their factors, so that two terms can mean together what neither means
alone. It is fitted in one task on a bounded sample of labelled rows (SAMPLE_PER_CLASS of
either label at most, those with the smallest hash) by minibatches with Adagrad; every text is then scored
in whole.

A term gets weights if it is in MIN_DOCUMENTS sampled texts or more, and either goes with the label by itself
(chi-squared of MIN_ASSOCIATION or more) or goes with it among the texts that hold some other term
(PAIR_ASSOCIATION or more, and a difference of PAIR_EFFECT or more in the share of toxic ones), as a group's name may
among texts with an insult; then both terms of the pair do. All pairs
of terms are looked at, through an inverted index of the sample: for each term the terms of its texts are counted. Only terms too
rare for a chi-squared of PAIR_ASSOCIATION among their texts, which is their number at most, are not tried as the other term. The
sample has not the true share of toxic rows, so the intercept is moved to the share among all labels, and counts
for the screens weight clean texts to that share. Settings were chosen by cross validation within the training
folds (see the README); the held-out fold was scored after that.

Defined results: null and empty texts get the score of the intercept alone; very long texts are scored by all
their distinct terms; repeated rows get equal scores; a score of exactly 0.5 counts as toxic; a document labelled
twice counts as toxic if one label says so; of several rows with one identifier that of the smallest text hash is learnt from; without labels of both kinds the score is the share of toxic labels
(0 without labels); only doc_id and text are read, and other columns are carried by ``drop_toxic`` under
any names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import carried, fold, where

TERM = re.compile(r"[^\W\d_]+")
DIM = 1 << 20
STEM_LETTERS = (4, 5)
#: Clean and toxic rows of the sample.
SAMPLE_PER_CLASS = (16_000, 8000)
MIN_DOCUMENTS = 4
#: Least chi-squared of a term with the label in the sample, and among the texts that hold one other term.
MIN_ASSOCIATION = 16.0
PAIR_ASSOCIATION = 96.0
#: Toxic texts that a pair would have by chance, at least; fewer make chi-squared a matter of luck.
PAIR_EXPECTED = 3.0
#: Difference that one term of a pair makes to the share of toxic texts among those that hold the other, at least.
PAIR_EFFECT = 0.5
FACTORS = 4
#: Share of a text's terms that each step hides, so that a term learns to count without its usual company.
HIDDEN = 0.2
EPOCHS = 20
BATCH = 64
RATE = 0.2
L2_LINEAR, L2_FACTOR = 1e-4, 1e-5
HELD_OUT_FOLD = 0
CACHE_TERMS = 100_000


def terms_of(text: str | None, cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The distinct features of a text, in order."""
    out: set[int] = set()
    for word in set(TERM.findall((text or "").lower())):
        got = cache.get(word)
        if got is None:
            got = (zlib.crc32(word.encode()) % DIM, *(zlib.crc32(b"^" + word[:n].encode()) % DIM for n in STEM_LETTERS if len(word) > n))
            if len(cache) >= CACHE_TERMS:
                cache.clear()
            cache[word] = got
        out.update(got)
    return np.array(sorted(out), dtype=np.int32)


class Machine:
    """score = sigmoid(bias + sum of linear + half of (|sum of factors|^2 - sum of |factor|^2)).

    Kept features are the sorted ids ``ids``; row i of ``weights`` has the linear weight and the factors.
    """

    def __init__(self, bias: float, ids: np.ndarray, weights: np.ndarray):
        self.bias, self.ids, self.weights = bias, ids, weights
        self.row = np.full(DIM, -1, dtype=np.int32)
        self.row[ids] = np.arange(len(ids), dtype=np.int32)

    def logit(self, terms: np.ndarray) -> float:
        rows = self.row[terms]
        w = self.weights[rows[rows >= 0]]
        if not len(w):
            return self.bias
        v = w[:, 1:]
        total = v.sum(axis=0)
        return float(self.bias + w[:, 0].sum() + 0.5 * (total @ total - (v * v).sum()))


def association(toxic: np.ndarray, seen: np.ndarray, all_toxic: np.ndarray | float, n: np.ndarray | float) -> np.ndarray:
    """Chi-squared of each term with the label, from its toxic texts and all its texts."""
    expected = seen * all_toxic / n
    spread = expected * (1 - all_toxic / n) * (1 - seen / n)
    return np.where(spread > 1e-9, (toxic - expected) ** 2 / np.maximum(spread, 1e-9), 0.0)


def paired_terms(terms: list[np.ndarray], labels: np.ndarray, weight: float, enough: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Of the features in ``enough`` (a mask), pairs one of which, not ``alone``, goes with the label among the texts that hold the other.

    For a term with n texts, a share p of them toxic, another can only reach the screens if it is in so many of those
    texts that they would hold PAIR_EXPECTED toxic ones, and s / (1 - s / n) times the odds of p (or their inverse) is
    PAIR_ASSOCIATION: terms are numbered by their texts, so those that are in fewer at all are left out as the tail.
    """
    n_toxic = int(labels.sum())
    # Toxic texts first, so that an entry of the index is two runs of texts.
    order = np.argsort(-labels, kind="stable")
    weights = np.where(labels > 0, 1.0, weight)
    ids = np.flatnonzero(enough)
    totals = np.zeros(len(enough))
    for t, w in zip(terms, weights):
        totals[t] += w
    ids = ids[np.argsort(-totals[ids], kind="stable")]
    totals = totals[ids]
    place = np.full(len(enough), -1)
    place[ids] = np.arange(len(ids))
    texts = [place[terms[d][enough[terms[d]]]] for d in order]
    holder = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    by_term = np.argsort(holder, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(holder, minlength=len(ids)))])
    added = lambda some, m: np.bincount(np.concatenate([texts[d] for d in some]), minlength=m)[:m].astype(float) if len(some) else np.zeros(m)
    out = np.zeros(len(ids), dtype=bool)
    other = ~alone[ids]
    for a in range(len(ids)):
        own = text[by_term[ends[a] : ends[a + 1]]]
        cut = np.searchsorted(own, n_toxic)
        toxic_a, with_a = float(cut), cut + weight * (len(own) - cut)
        p = toxic_a / with_a
        if with_a < PAIR_ASSOCIATION or not 0 < p < 1:
            continue
        least = PAIR_ASSOCIATION * min(p / (1 - p), (1 - p) / p)
        least = max(PAIR_EXPECTED / p, least / (1 + least / with_a)) * (1 - 1e-9)
        m = int(np.searchsorted(-totals, -least, side="right"))
        toxic = added(own[:cut], m)
        seen = toxic + weight * added(own[cut:], m)
        near = np.flatnonzero(other[:m] & (seen >= least))
        t, s = toxic[near], seen[near]
        hit = (association(t, s, toxic_a, with_a) >= PAIR_ASSOCIATION) & (s * toxic_a >= PAIR_EXPECTED * with_a)
        hit &= np.abs(t / s - (toxic_a - t) / np.maximum(with_a - s, 1e-9)) >= PAIR_EFFECT
        if hit.any():
            out[a] = True
            out[near[hit]] = True
    return np.sort(ids[out])


def fit(labels: np.ndarray, terms: list[np.ndarray], prior: float, seed: int = 7) -> Machine:
    """Fits the sample, whose toxic texts may be more or fewer than ``prior``, their share among all labels.

    A logistic score fitted to a sample by class differs by the intercept alone: the difference of the log odds
    of the two shares is added to it. Where nothing can be fitted, ``prior`` is the score.
    """
    n = len(labels)
    none = np.zeros((0, 1 + FACTORS))
    share = labels.mean() if n else 0.0
    if not 0 < share < 1 or not 0 < prior < 1:
        odds = np.clip(prior, 1e-6, 1 - 1e-6)
        return Machine(float(np.log(odds / (1 - odds))), np.zeros(0, dtype=np.int64), none)
    # Counts per feature first: only the terms that stay are laid out for the steps below.
    seen = np.zeros(DIM)
    toxic = np.zeros(DIM)
    for t, label in zip(terms, labels):
        seen[t] += 1
        toxic[t] += label
    # As if the sample's toxic texts came with as many clean ones as the labels have for them.
    weight = share / (1 - share) * (1 - prior) / prior
    n_toxic = labels.sum()
    strength = association(toxic, toxic + weight * (seen - toxic), n_toxic, n_toxic + weight * (n - n_toxic))
    enough = seen >= MIN_DOCUMENTS
    keep = enough & (strength >= MIN_ASSOCIATION)
    keep[paired_terms(terms, labels, weight, enough, keep)] = True
    ids = np.flatnonzero(keep)
    renumber = np.cumsum(keep) - 1
    kept = [renumber[t[keep[t]]] for t in terms]
    sizes = np.array([len(t) for t in kept])
    cols, ends = np.concatenate(kept), np.concatenate([[0], np.cumsum(sizes)])
    rng = np.random.default_rng(seed)
    width = 1 + FACTORS
    w = np.zeros((len(ids), width))
    w[:, 1:] = rng.normal(0, 0.01, (len(w), FACTORS))
    bias, grad2, bias2 = 0.0, np.full_like(w, 1e-2), 1e-2
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            batch = order[at : at + BATCH]
            counts = ends[batch + 1] - ends[batch]
            c = np.concatenate([cols[ends[d] : ends[d + 1]] for d in batch])
            row = np.repeat(np.arange(len(batch)), counts)
            shown = rng.random(len(c)) >= HIDDEN
            c, row = c[shown], row[shown]
            wc = w[c]
            sums = np.zeros((len(batch), width))
            squares = np.zeros(len(batch))
            for k in range(width):
                sums[:, k] = np.bincount(row, wc[:, k], len(batch))
            squares[:] = np.bincount(row, (wc[:, 1:] ** 2).sum(axis=1), len(batch))
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            g = np.empty_like(wc)
            g[:, 0] = error[row]
            g[:, 1:] = error[row, None] * (sums[row, 1:] - wc[:, 1:])
            touched, where = np.unique(c, return_inverse=True)
            total = np.stack([np.bincount(where, g[:, k], len(touched)) for k in range(width)], axis=1).astype(float)
            total[:, 0] += L2_LINEAR * w[touched, 0]
            total[:, 1:] += L2_FACTOR * w[touched, 1:]
            grad2[touched] += total**2
            w[touched] -= RATE * total / np.sqrt(grad2[touched])
            step = error.sum()
            bias2 += step**2
            bias -= RATE * step / np.sqrt(bias2)
    return Machine(float(bias - np.log(weight)), ids, w)


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fits the machine on labelled rows outside the held-out fold.

    Only the sample's identifiers, whose number SAMPLE_PER_CLASS bounds, are broadcast; only hashed terms
    of the sample reach the fitting task, and the driver gets the kept weights.
    """
    known = (
        labels.select("doc_id", "toxic")
        .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return fit(np.zeros(0), [], prior)
    place = F.xxhash64("doc_id", F.lit(11))
    sample = None
    for kind in (0, 1):
        part = known.filter(F.col("toxic") == kind).orderBy(place, "doc_id").limit(SAMPLE_PER_CLASS[kind])
        sample = part if sample is None else sample.unionByName(part)

    def hashed(batches):
        cache: dict = {}
        for b in batches:
            terms = [terms_of(x.as_py(), cache).tobytes() for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("mark"), pa.array(terms, pa.binary())], names=["doc_id", "toxic", "mark", "terms"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("mark"), "text")
    rows = rows.mapInArrow(hashed, "doc_id long, toxic int, mark long, terms binary")
    # One row an identifier, so that the sample's bound is one of rows.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("mark", "terms", "toxic")).alias("one")).select("doc_id", "one.terms", "one.toxic")

    def fitted(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "terms", "toxic"))))
        del table
        model = fit(np.array([r[2] for r in rows], dtype=float), [np.frombuffer(r[1], dtype=np.int32) for r in rows], prior)
        del rows
        pa.default_memory_pool().release_unused()
        weights = model.weights.astype(np.float32)
        return pa.table({"bias": [model.bias], "ids": [model.ids.astype(np.int32).tobytes()], "weights": [weights.tobytes()]})

    found = rows.groupBy(F.lit(0).alias("all_")).applyInArrow(fitted, "bias double, ids binary, weights binary").collect()
    if not found:
        return fit(np.zeros(0), [], prior)
    ids = np.frombuffer(found[0]["ids"], dtype=np.int32).astype(np.int64)
    return Machine(found[0]["bias"], ids, np.frombuffer(found[0]["weights"], dtype=np.float32).reshape(len(ids), 1 + FACTORS).astype(float))


def _scored(docs: DataFrame, model: Machine, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` and the score, as score_; the text goes through the workers once."""
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.ids.astype(np.int32), model.weights.astype(np.float32)))

    def run(batches):
        bias, ids, weights = held.value
        machine, cache = Machine(bias, ids.astype(np.int64), weights.astype(float)), {}
        for b in batches:
            logits = np.array([machine.logit(terms_of(x.as_py(), cache)) for x in b.column(text)], dtype=float)
            scores = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores)], names=[*keep, "score_"])

    schema = T.StructType([*docs.select(*keep).schema, T.StructField("score_", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Machine, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the column ``out`` and without the text."""
    safe, kept = carried(docs, out, text)
    return _scored(safe, model, [s for s, _ in kept], f"c{where(docs, text)}").toDF(*(g for _, g in kept), out)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns kept."""
    safe, kept = carried(docs)
    names = [s for s, _ in kept]
    return _scored(safe, train(docs, labels), names, f"c{where(docs, 'text')}").filter(F.col("score_") < threshold).select(*names).toDF(*docs.columns)

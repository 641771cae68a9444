"""Lattice scores against brute force over all segmentations."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import lattice_lm
from plumbline.llm.queries import vocabulary


def brute(word, table, longest):
    """Sum over all segmentations of the product of their pieces' probabilities."""
    total = [0.0] * (len(word) + 1)
    total[0] = 1.0
    for k in range(1, len(word) + 1):
        for j in range(max(0, k - longest), k):
            total[k] += total[j] * table(word[j:k])
    return total[-1]


def test_forward_and_expected():
    pieces = lattice_lm.Pieces(["▁", "a", "b", "ab", "▁a", "ba", "bab"], [0, 1, 2, 3, 4, 5, 6])
    logs = np.log(pieces.first)

    def table(s):
        own = float(pieces.first[pieces.strings.index(s)]) if s in pieces.strings else 0.0
        return own + (math.prod(float(pieces.first[pieces.n + b]) for b in s.encode()) if len(s) == 1 else 0.0)

    words = ["ab", "bab", "é", "abbabab", "zab", "", "b" * 40]
    for which, points in lattice_lm.by_length(words):
        got = lattice_lm.forward(points, logs, pieces)[0][:, -1]
        for i, z in zip(which, got):
            assert z == pytest.approx(math.log(brute("▁" + words[i], table, 3)))
        uses, whole = lattice_lm.expected(points, np.ones(len(which)), logs, pieces)
        assert whole == pytest.approx(got.sum())
        covered = sum(len(s) * uses[k] for k, s in enumerate(pieces.strings))
        assert covered <= points.size + 1e-9
    lone = next(p for w, p in lattice_lm.by_length(["zab"]))
    assert lattice_lm.expected(lone, np.ones(1), logs, pieces)[0][pieces.n + ord("z")] == pytest.approx(1.0)


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HEAD_WORDS", 20)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (None, "Lone wörd x" * 9), (902, "z" * 3000), (902, "again")]
    got = lattice_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("piece_bpe_32k.model")).collect()
    split = lambda t: [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    value = lambda w: math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1)))
    key = lambda x: (-1 if x[0] is None else x[0], x[2])
    want = sorted(((i, held(i), len(split(t)) + 1, sum(counts.get(w, 0) > 0 for w in [*split(t), None]), n, sum(map(value, [*split(t), None]))) for i, t in rows), key=key)
    got = sorted((tuple(r) for r in got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert all(g[6] < 0 for g in got)
    assert lattice_lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary("piece_bpe_32k.model")).count() == 0


def walked(word, chances, longest):
    """Expected uses of each piece in a word, and its probability, by sums over all segmentations."""
    n = len(word)
    edges = [(j, k, piece, chance) for j in range(n) for k in range(j + 1, min(n, j + longest) + 1) for piece, chance in chances(word[j:k])]
    ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for k in range(1, n + 1):
        ahead[k] = sum(ahead[a] * c for a, b, _, c in edges if b == k)
    for k in range(n - 1, -1, -1):
        behind[k] = sum(behind[b] * c for a, b, _, c in edges if a == k)
    uses = Counter()
    for a, b, piece, chance in edges:
        for p in piece:
            uses[p] += ahead[a] * chance * behind[b] / ahead[n]
    return uses, ahead[n]


def test_score_end_to_end(spark, monkeypatch):
    """The score column against expectation maximisation and sums in plain Python."""
    monkeypatch.setattr(lattice_lm, "HEAD_WORDS", 5)
    model = vocabulary("piece_bpe_32k.model")
    texts = ["the Quick brown fox", "über the lazy dog the", None, "zzz the quickest", "fox fox 123", "held out words the fox", "a", "quick über naïve", "the end", "dog's day"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    pieces = lattice_lm.Pieces.from_model(model)
    place = {s: i for i, s in enumerate(pieces.strings)}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    split = lambda t: [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
    assert any(held(i) for i, _ in rows)
    counts, trained, chance = Counter(), sum(not held(i) for i, _ in rows), pieces.first.tolist()
    for i, t in rows:
        if not held(i):
            counts.update(split(t))

    def chances(s):
        found = [([place[s]], chance[place[s]])] if s in place else []
        if len(s) == 1:
            spelled = [pieces.n + b for b in s.encode()]
            found.append((spelled, math.prod(chance[p] for p in spelled)))
        return found

    for _ in range(lattice_lm.ROUNDS):
        uses = [lattice_lm.PRIOR_USES * f for f in pieces.first.tolist()]
        uses[pieces.end] += trained
        for w, n in counts.items():
            for p, u in walked("▁" + w, chances, pieces.longest)[0].items():
                uses[p] += n * u
        chance = [u / sum(uses) for u in uses]
    value = lambda w: math.log10(walked("▁" + w, chances, pieces.longest)[1])
    want = sorted((i, sum(map(value, split(t))) + math.log10(chance[pieces.end])) for i, t in rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    got = sorted((r["doc_id"], r["score"]) for r in lattice_lm.score_documents(docs, model).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
    words, n = lattice_lm.count_words(docs)
    likelihoods = []
    lattice_lm.learn(words, n, pieces, 4, likelihoods)
    assert all(a < b for a, b in zip(likelihoods, likelihoods[1:]))
    # Nothing to learn from: the first weights stay.
    assert np.allclose(lattice_lm.learn(words.filter("n < 0"), 0, pieces), pieces.first)

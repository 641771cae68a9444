"""Classes of the n-gram join against brute force over all pairs."""

import random

import numpy as np
import pytest

from plumbline.llm import ngram_join


def grams(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(rows):
    """Class of each row: the smallest identifier in its component of pairs at the threshold."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[root(i)] = min(first.get(root(i), d), d)
    return sorted((d, first[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def changed(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def family_rows():
    rng = random.Random(4)
    rows, d = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((d, changed(rng, base, rng.randrange(0, 1 + len(base) // 40))))
            d += 1
    base = [f"v{rng.randrange(500)}" for _ in range(150)]
    for _ in range(150):
        rows.append((d, changed(rng, base, rng.randrange(0, 6))))
        d += 1
    for _ in range(60):
        rows.append((d, " ".join(f"u{rng.randrange(400)}" for _ in range(rng.randrange(1, 60)))))
        d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, "one two"), (d + 3, "One TWO"), (d + 4, "word " * 30000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small,block,size", [(4096, 4096, 16 << 20), (20, 16, 16 << 20), (4096, 4096, 9000)])
def test_classes(spark, monkeypatch, small, block, size):
    """In one block, in blocks of few sets, and in blocks of few bytes."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", size)
    rows = family_rows()
    # A family that runs through many sizes, each text a tenth longer than the one before it.
    words = [f"z{k}" for k in range(400)]
    rows += [(9000 + k, " ".join(words[: int(20 * 1.1**k)])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.classes(docs).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == brute(rows)
    sets = {d: grams(t) for d, t in rows}
    distinct = set(sets.values())
    for r in got:
        own = sets[r["doc_id"]]
        assert r["n_links"] == sum(o != own and 5 * len(own & o) >= 4 * len(own | o) for o in distinct if own and o)


def test_levels_of_blocks(spark, monkeypatch):
    """Sets of a large component meet only sets of their own level of size and of the two beside it."""
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    rows = [(i, 0, 4 + i, None, i) for i in range(300)]
    sets = spark.createDataFrame([(i, n, bytes(4), i) for i, _, n, _, _ in rows], "node long, n int, set_key binary, rep_doc long")
    loose = spark.createDataFrame([(i, 0) for i in range(300)], "node long, root long")
    placed = ngram_join.blocked(sets, loose, 0.8).selectExpr("node", "inline(pairs)").collect()
    groups = {}
    for r in placed:
        groups.setdefault(r[1:2] + r[3:], []).append((r["node"], r["side"]))
    assert max(map(len, groups.values())) < 60 and len(placed) < 300 * 30 / 2
    met = set()
    for (_, cross, x, y), held in groups.items():
        for i, s in held:
            for j, t in held:
                if i < j and (s != t or (not cross and x == y)):
                    assert (i, j) not in met
                    met.add((i, j))
    assert all((i, j) in met for i in range(300) for j in range(i + 1, 300) if 5 * (4 + i) >= 4 * (4 + j))


def test_null_identifiers(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (5, text + " end"), (None, text)], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.classes(docs).collect()} == {(None, 5, 1), (5, 5, 1)}


def test_keep_one(spark):
    rows = family_rows()
    schema = "doc_id long, text string, path string, node int, hit int"
    docs = spark.createDataFrame([(d, t, "p", 1, 2) for d, t in rows] + [(rows[0][0], rows[0][1], "p", 1, 2)], schema)
    kept = ngram_join.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in brute(rows)})
    assert kept[0].asDict().keys() == {"doc_id", "text", "path", "node", "hit"}
    assert ngram_join.keep_one(docs.filter("doc_id < 0")).count() == 0


def test_components(spark):
    rng = random.Random(9)
    for n in (0, 1, 400):
        pairs = [(i, i + 1) for i in range(n // 2)] + [tuple(sorted(rng.sample(range(1000, 1000 + n + 2), 2))) for _ in range(n)]
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in pairs:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
        got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == {x: root(x) for x in parent}


def test_runs_needed():
    assert [ngram_join.runs_needed(0.8, 0.999, depth) for depth in (1, 2, 4, 8)] == [4, 6, 8, 15]
    assert ngram_join.runs_needed(0.8, 0.9, 1) < 4


def family(agreement, n, rng):
    """Signatures that agree pairwise in such a share of positions, through a template that each agrees with by its root."""
    sigs = rng.integers(0, 1 << 16, (n, ngram_join.SAMPLES)).astype(np.uint16)
    return np.where(rng.random(sigs.shape) < agreement**0.5, rng.integers(0, 1 << 16, ngram_join.SAMPLES).astype(np.uint16), sigs)


@pytest.mark.parametrize("agreement", [0.3, 0.42, 0.46, 0.49])
def test_frontier_stays_small(agreement):
    """Paths of a family that shares many tokens: ten times the sets at most on any level, and falling in the end."""
    n, sigs = 20_000, family(agreement, 20_000, np.random.default_rng(3))
    keys = np.repeat(np.arange(ngram_join.RUNS_AT_ONCE, dtype=np.uint64), n)
    node, used, rows = np.tile(np.arange(n), ngram_join.RUNS_AT_ONCE), np.zeros(len(keys), dtype=np.uint64), []
    while len(keys):
        out = list(ngram_join.deeper(keys, used, sigs[node], 0.8))
        node = np.concatenate([node[r] for r, _, _ in out])
        keys, used = (np.concatenate([o[k] for o in out]) for k in (1, 2))
        assert set(np.bitwise_count(used).tolist()) == {len(rows) + 1}
        rows.append(len(keys))
        _, back, size = np.unique(keys, return_inverse=True, return_counts=True)
        large = size[back] > 64
        node, keys, used = node[large], keys[large], used[large]
    assert max(rows) < 10 * n and len(rows) < ngram_join.DEEPEST and rows[-1] < rows[0] / 4


def test_recall_in_a_deep_family(spark, monkeypatch):
    """Pairs at the threshold within a family whose buckets stay large for several levels."""
    monkeypatch.setattr(ngram_join, "SMALL", 256)
    rng = np.random.default_rng(8)
    sigs = family(0.45, 3000, rng)
    twins = np.where(rng.random((400, ngram_join.SAMPLES)) < 0.8, sigs[:400], rng.integers(0, 1 << 16, (400, ngram_join.SAMPLES)).astype(np.uint16))
    sets = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(np.concatenate([sigs, twins]))], "node long, sig binary")
    root = {r["node"]: r["root"] for r in ngram_join.components(ngram_join.candidates(sets)).collect()}
    assert sum(root.get(k, -1) == root.get(3000 + k, -2) for k in range(400)) >= 396

"""The corpus operators against brute force on small tables."""

import base64
import hashlib
import random
import zlib

import pytest

from plumbline.llm import bpe_replay, chat_format, common, exact_dedup, hash_ring, packing, quality_rules, suffix_dedup, toxicity
from plumbline.llm.queries import pattern, vocabulary
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, digest string, part int, row int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash", 7, 8) for i, t in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(["the", "ant", "ré", "Der", "ooze", "q", "ñandú", "x1"]) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared = sentence(rng, 30)
    out = [(i, sentence(rng, rng.randrange(0, 80))) for i in range(60)]
    out += [(100 + i, sentence(rng, 10) + " " + shared + " " + sentence(rng, 5)) for i in range(12)]
    out += [(200 + i, out[i % 5][1]) for i in range(20)]
    out += [(300, None), (301, ""), (302, ""), (None, "alone " + shared), (303, "word " * 5000), (3, out[3][1]), (304, "A" * 300), (305, "a" * 300)]
    rng.shuffle(out)
    return out


def test_exact_groups(spark, rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(-1 if i is None else i)
    want = sorted((-1 if i is None else i, max(groups[low(t)]), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)
    for digest in (exact_dedup.digest_of, lambda n: F.unhex(F.substring(F.sha2(n, 256), 1, 2))):
        got = exact_dedup.exact_groups(table(spark, rows), keep="largest", digest=digest).collect()
        assert sum(r["kept"] for r in got) == len(groups)
        found = sorted((-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2]) for r in got)
        assert found == [w[:3] for w in want]
    assert sorted(r["text_sha256"] for r in exact_dedup.exact_groups(table(spark, rows)).collect()) == sorted(w[3] for w in want)


def test_drop_copies(spark, rows):
    clash = lambda n: F.unhex(F.substring(F.sha2(n, 256), 1, 2))
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    for keep, best in (("smallest", min), ("largest", max)):
        want = {}
        for i, t in rows:
            if i is not None:
                want[low(t)] = best(want.get(low(t), i), i)
        want |= {low(t): None for i, t in rows if low(t) not in want}
        for digest in (exact_dedup.digest_of, clash):
            kept = exact_dedup.drop_copies(table(spark, rows), keep, digest).collect()
            assert sorted((low(r["text"]), r["doc_id"] or -1) for r in kept) == sorted((t, i or -1) for t, i in want.items())
    assert kept[0].asDict().keys() == {"doc_id", "text", "source", "digest", "part", "row"}
    assert exact_dedup.drop_copies(table(spark, [])).count() == 0


def brute_cut(rows):
    first = {}
    last = float("inf")
    key = lambda i: last if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, last), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((key(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("part_bytes,fan", [(2000, 4096), (2000, 3), (1, 4096), (8 << 20, 4096)])
def test_suffix_dedup(spark, rows, monkeypatch, part_bytes, fan):
    """In a few parts, in a tree of parts, in more parts by size than a table may have buckets, and in one."""
    assert common.MAX_BUCKETS <= 100_000
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part_bytes)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    monkeypatch.setattr(suffix_dedup, "FAN", fan)
    monkeypatch.setattr(common, "MAX_BUCKETS", 8)
    if part_bytes == 1:
        rows = [*rows, (400, "long " * 20_000)]
        assert sum(len((t or "").encode()) for _, t in {t: (i, t) for i, t in rows}.values()) > 100_000
    if part_bytes < 8 << 20:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = suffix_dedup.cut_repeats(table(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((float("inf") if r[0] is None else r[0], *r[1:]) for r in got) == brute_cut(rows)


def test_previous_factors(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    for letters, n in ((2, 300), (3, 400), (1, 120)):
        x = rng.integers(97, 97 + letters, n).astype(np.uint8)
        if letters == 3:
            x[200:290] = x[20:110]
        doc = np.sort(rng.integers(0, 6, n))
        rng.shuffle(doc)
        places = np.sort(rng.choice(n - 49, n - 60, replace=False))
        got = suffix_dedup.previous_factors(x, places, doc[places])
        same = lambda a, b: next((k for k in range(50) if x[a + k] != x[b + k]), 50)
        for p, length in zip(places, got):
            assert length == max((same(p, q) for q in places if doc[q] < doc[p]), default=0)
    for _ in range(30):
        values = rng.integers(0, 8, 40)
        want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(40)]
        assert suffix_dedup.nearest_smaller(values).tolist() == want
    assert suffix_dedup.nearest_smaller(np.zeros(0)).tolist() == []


def test_levels():
    for parts in (1, 4096, 4097, 12_500_000, 10**11):
        levels = common.levels_of(parts, suffix_dedup.FAN)
        assert parts <= suffix_dedup.FAN ** len(levels) and levels[-1] >= parts
        assert all(b % a == 0 and b // a <= suffix_dedup.FAN for a, b in zip([1, *levels], levels))


def test_suffix_dedup_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = suffix_dedup.cut_repeats(docs).collect()
    assert sorted(tuple(r) for r in got) == brute_cut([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert suffix_dedup.cut_repeats(table(spark, [])).count() == 0


def test_suffix_dedup_splits_common_phrases(spark, monkeypatch):
    """A phrase of less than 50 bytes in every document doesn't bring all its windows to one bucket."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = [(i, letters(60) + " a phrase of forty bytes in each document " + letters(60)) for i in range(200)]
    rows += [(300 + i, letters(30) + rows[i][1][30:140]) for i in range(40)]
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "OWNER_WINDOWS", 100, raising=False)
    spans, keep = [], suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name: spans.append(keep(df, name)) or spans[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = suffix_dedup.cut_repeats(table(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in got) == brute_cut(rows)
    held = {}
    for r in spans[-1].filter("bucket >= 0").select("bucket", "size").collect():
        held[r["bucket"]] = held.get(r["bucket"], 0) + sum(int.from_bytes(r["size"][k : k + 8], "little") for k in range(0, len(r["size"]), 8))
    assert max(held.values()) < 0.2 * sum(held.values())


def test_shorten_keeps_columns(spark, rows):
    out = suffix_dedup.shorten(table(spark, rows)).collect()
    assert len(out) == len(rows)
    assert out[0].asDict().keys() == {"doc_id", "text", "source", "digest", "part", "row"}
    assert {r["digest"] for r in out} == {"clash"} and {r["part"] for r in out} == {7}


@pytest.mark.parametrize("chunk,fan", [(4 << 20, 4096), (3000, 5)])
def test_bpe_equals_tiktoken(spark, rows, monkeypatch, chunk, fan):
    """In few chunks, and in many that meet in a tree."""
    import tiktoken

    monkeypatch.setattr(bpe_replay, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(bpe_replay, "FAN", fan)

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    texts = [t for _, t in rows] + ["<|endoftext|> aaaaaaaaaaaaaaab \n\n\t  😀é it's 12345", "ab" * 3000, "​́zzzzzz"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = table(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in bpe_replay.digest_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern()).collect()}
    for i, t in enumerate(texts):
        ids = coder.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe_replay.encode_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern())
    for r in bpe_replay.decode_documents(encoded, vocabulary("byte_bpe_50k.tiktoken")).collect():
        assert bytes(r["data"]) == (texts[r["doc_id"]] or "").encode()


def test_bpe_edges(spark):
    """Repeated rows and null identifiers stay rows; each distinct word is replayed once; no rows of no rows."""
    docs = spark.createDataFrame([(1, "ab ab", 7), (1, "ab ab", 7), (None, "ab", 8), (2, None, 9)], "doc_id long, text string, chunk int")
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    got = bpe_replay.digest_documents(docs, ranks, pattern()).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == [(-1, 1), (1, 2), (1, 2), (2, 0)]
    split, count = bpe_replay.split_chunks(docs.repartition(3), pattern())
    assert sorted({w for r in split.collect() for w in r["words"]}) == [" ab", "ab"] and split.agg({"chunk": "max"}).first()[0] < count
    assert bpe_replay.digest_documents(docs.filter("doc_id > 9"), ranks, pattern()).count() == 0


def test_packing(spark, rows):
    import numpy as np
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want, total = [], 0
    for i, t in rows:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        edges = list(range(len(ids), 0, -256))[::-1]
        for k, end in enumerate(edges):
            start = edges[k - 1] if k else 0
            want.append((-1 if i is None else i, k, start, end - start, zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())))
    got = packing.pack_documents(table(spark, rows), vocabulary("byte_bpe_50k.tiktoken"), pattern(), 256).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.03 * total / 256 + 1
    assert packing.pack_documents(table(spark, []), vocabulary("byte_bpe_50k.tiktoken"), pattern()).count() == 0


def test_packing_added_tokens(spark):
    """Against tokenizers with its default setting, which matches added tokens within texts."""
    import numpy as np
    from plumbline.llm.queries import packed
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["plain it's", f"a {end} b", f"a{end}  \n{end}{end}b", end, f"x  {end}", f"<|{end}|> <|endoftext|", f"{end}é\t\t z" * 400, None]
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(ids, 2048))]
    got = packed(table(spark, list(enumerate(texts)))).collect()
    assert sorted(tuple(r[:5]) for r in got) == want


def test_pack_histogram():
    rng = random.Random(1)
    for _ in range(20):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 40) for _ in range(25)}
        bins = packing.pack(histogram, 100)
        found = {}
        for contents, count in bins:
            assert sum(contents) <= 100 and sum(3 * s > 100 for s in contents) <= 2
            for s in contents:
                found[s] = found.get(s, 0) + count
        assert found == histogram


@pytest.mark.parametrize("slack", [0.0, 0.2])
def test_hash_ring(spark, rows, slack):
    docs = table(spark, rows).unionAll(table(spark, [(9, "hot")] * 200))
    got = hash_ring.assign(docs.select("doc_id", "text"), "doc_id", 5, vnodes=16, slack=slack, order=["text"]).collect()
    assert len(got) == len(rows) + 200
    held = {}
    for r in got:
        held.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    sizes = [len(held.get(s, [])) for s in range(5)]
    if slack:
        assert max(sizes) <= -(-len(got) // 5) * (1 + slack) + 1
    else:
        assert max(sizes) - min(sizes) <= 1
    assert hash_ring.assign(table(spark, []).select("doc_id"), "doc_id", 5).count() == 0


def test_hash_ring_moves_few_rows(spark):
    """From 24 to 25 shards: the ideal is 4 % of the rows."""
    docs = spark.range(30_000).withColumnRenamed("id", "doc_id")
    for slack, most, between in ((0.25, 0.05, 0.0), (0.0, 0.09, 0.04)):
        a = {r["doc_id"]: r["shard"] for r in hash_ring.assign(docs, "doc_id", 24, slack=slack).collect()}
        b = {r["doc_id"]: r["shard"] for r in hash_ring.assign(docs, "doc_id", 25, slack=slack).collect()}
        assert sum(a[k] != b[k] for k in a) <= most * len(a)
        assert sum(a[k] != b[k] < 24 for k in a) <= between * len(a)


@pytest.mark.parametrize("slack", [0.0, 0.1, 1.0])
def test_hash_ring_against_brute_force(spark, slack):
    """Row by row: own shards first, then what is left goes clockwise to the next shard with room."""
    docs = spark.createDataFrame([(i * i, f"t{i}") for i in range(500)] + [(7, "hot")] * 150, "doc_id long, text string")
    rows = sorted((r["place"], r["doc_id"], r["text"]) for r in docs.withColumn("place", F.xxhash64("doc_id")).collect())
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(6) for v in range(8))
    room = hash_ring.bounds(len(rows), 6, slack)
    first = [next((k for k, (p, _) in enumerate(points) if p >= place), 0) for place, _, _ in rows]
    want, later = [], []
    for k in range(len(points)):
        for (_, doc, text), at in zip(rows, first):
            if at == k:
                shard = points[k][1]
                if room[shard]:
                    room[shard] -= 1
                    want.append((doc, text, shard))
                else:
                    later.append((k, doc, text))
    for k, doc, text in later:
        while not room[points[k][1]]:
            k = (k + 1) % len(points)
        room[points[k][1]] -= 1
        want.append((doc, text, points[k][1]))
    got = hash_ring.assign(docs, "doc_id", 6, vnodes=8, slack=slack, order=["text"]).collect()
    assert sorted((r["doc_id"], r["text"], r["shard"]) for r in got) == sorted(want)


def test_hash_ring_edges(spark):
    """Columns of any name; null keys, null texts and repeated rows are rows like others."""
    names = "doc_id long, text string, place int, arc string, idx double, shard string, slot int, count int"
    rows = [(None, None, 1, "a", 0.5, "s", 3, 1), (None, None, 1, "a", 0.5, "s", 3, 1), (1, "", 2, "b", 0.5, "s", 3, 1), (2, "x" * 100_000, 2, None, None, None, None, None)]
    got = hash_ring.assign(spark.createDataFrame(rows, names), "doc_id", 3, order=["text"]).collect()
    assert len(got) == 4 and {(r["place"], r["arc"]) for r in got} == {(1, "a"), (2, "b"), (2, None)}
    assert sorted(sum(r["shard"] == s for r in got) for s in range(3)) == [1, 1, 2]


def test_quality_counts():
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice("ab# \n\t\x0bé|") for _ in range(rng.randrange(0, 200)))
        words = [w for w in text.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b")]
        assert quality_rules.counts_of(text) == (len(words), sum(map(len, words)), text.count("#") + text.count("|"), len(lines) - len(set(lines)), len(hit), len(lines))
    assert quality_rules.counts_of(None) == (0, 0, 0, 0, 0, 0)


def test_host_verdict(spark):
    good, bad = "one two three four five six seven eight nine ten eleven twelve " * 1, "spam"
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, long, "good.org") for i in range(40)] + [(100 + i, bad, "bad.org") for i in range(40)] + [(200, long, "bad.org"), (300, bad, "tiny.org"), (301, long, None), (302, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert len(good) and got[0]["kept"] and not got[100]["kept"] and not got[200]["kept"] and not got[200]["base_failed"]
    assert not got[302]["kept"]
    assert quality_rules.apply_rules(docs.filter("doc_id < 0")).count() == 0


def test_host_rules(spark):
    """A host of long texts of symbols, or of repeated lines, fails by the other rules; short hosts of one bad text don't."""
    words = " ".join(f"word{i}" for i in range(60))
    noisy = " ".join(f"wo|#{i}" for i in range(60))
    lined = "\n".join([f"{i}a {i}b {i}c {i}d" for i in range(20)] + ["the same line"] * 20)
    rows = [(h * 100 + i, words, f"good{h}") for h in range(20) for i in range(20)]
    rows += [(5000 + i, noisy, "noisy") for i in range(30)] + [(5100, words, "noisy"), (5101, words, "noisy")]
    rows += [(5200 + i, lined, "lined") for i in range(30)] + [(5300, words, "lined"), (5301, words, "lined"), (5301, words, "lined")]
    rows += [(5400, noisy, "small"), (5401, words, "small"), (5402, " ".join(f"word{i}" for i in range(120_000)), "small")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n_words int, host string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert not got[5000]["base_failed"] and got[5000]["rule_failed"] and got[5200]["rule_failed"] and not got[5100]["rule_failed"]
    assert not any(got[d]["kept"] for d in (5000, 5100, 5101, 5200, 5300, 5301))
    assert all(got[d]["kept"] for d in (0, 1919, 5400, 5401, 5402))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in scored if r["toxic"] == 1]
    clean = [r for r in scored if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_toxicity_interaction():
    import numpy as np

    rng = np.random.default_rng(0)
    labels, terms = [], []
    for i in range(2000):
        insult, group = i % 2, (i // 2) % 2
        noise = rng.choice(np.arange(100, 140), 5, replace=False)
        terms.append(np.sort(np.array([*([1] * insult), *([2] * group), *noise], dtype=np.int32)))
        labels.append(float(insult and group))
    model = toxicity.fit(np.array(labels), terms, 0.25)
    alone = max(model.logit(np.array([1], dtype=np.int32)), model.logit(np.array([2], dtype=np.int32)))
    assert model.logit(np.array([1, 2], dtype=np.int32)) > 0 > alone


def test_toxicity_terms_that_only_pairs_make_toxic():
    """Neither term goes with the label by itself: one alone is toxic, both or none are clean."""
    import numpy as np

    rng = np.random.default_rng(0)
    labels, terms = [], []
    for i in range(4000):
        one, other = i % 2, (i // 2) % 2
        noise = rng.choice(np.arange(100, 140), 5, replace=False)
        terms.append(np.sort(np.array([*([1] * one), *([2] * other), *noise], dtype=np.int32)))
        labels.append(float(one != other))
    model = toxicity.fit(np.array(labels), terms, 0.5)
    z = [model.logit(np.array(t, dtype=np.int32)) for t in ([], [1], [2], [1, 2])]
    assert model.ids.tolist() == [1, 2]
    assert z[0] < 0 < z[1] and z[3] < 0 < z[2]


def test_toxicity_group_mention():
    """A term as common in toxic as in clean texts gets factors, because beside an insult it makes texts toxic."""
    import numpy as np

    rng = np.random.default_rng(1)
    labels, terms = [], []
    for _ in range(6000):
        insult, group = rng.random() < 0.2, rng.random() < 0.2
        toxic = (insult and group) if rng.random() < 0.95 else rng.random() < 0.1
        toxic |= not group and rng.random() < 0.12
        noise = rng.choice(np.arange(100, 140), 5, replace=False)
        terms.append(np.sort(np.array([*([1] * insult), *([2] * group), *noise], dtype=np.int32)))
        labels.append(float(toxic))
    model = toxicity.fit(np.array(labels), terms, float(np.mean(labels)))
    z = [model.logit(np.array(t, dtype=np.int32)) for t in ([1], [2], [1, 2])]
    assert model.ids.tolist() == [1, 2] and z[2] > 0 > max(z[:2])


def test_toxicity_pair_among_many_more_common_terms():
    """The pair counts, though three thousand other terms are in more texts than either of its terms, which are in 6 % of them."""
    import numpy as np

    rng = np.random.default_rng(8)
    labels, terms = [], []
    for i in range(12_000):
        a, b = rng.random() < 0.06, rng.random() < 0.06
        toxic = a != b if rng.random() < 0.97 else not (a != b)
        if i % 3 == 0:
            a = b = rng.random() < 0.3
            toxic = rng.random() < 0.02
        filler = 10 + np.flatnonzero(rng.random(3000) < 0.08)
        terms.append(np.sort(np.array([*([1] * a), *([2] * b), *filler], dtype=np.int32)))
        labels.append(float(toxic))
    labels = np.array(labels)
    enough, alone = np.zeros(toxicity.DIM, dtype=bool), np.zeros(toxicity.DIM, dtype=bool)
    enough[np.unique(np.concatenate(terms))] = True
    assert toxicity.paired_terms(terms, labels, 1.0, enough, alone).tolist() == [1, 2]


@pytest.mark.parametrize("seed", range(6))
def test_toxicity_pairs_as_by_a_table_of_all(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    n, v, weight = int(rng.integers(300, 1500)), 60, (1.0, 0.3, 4.0)[seed % 3]
    there = rng.random((n, v)) < rng.random(v) * 0.6
    labels = ((there[:, 1] & there[:, 2]) | (there[:, 3] & ~there[:, 4])) ^ (rng.random(n) < 0.1) if seed % 2 else there[:, 5] ^ there[:, 6]
    labels = labels.astype(float)
    ids = np.arange(v) * 7 + 3
    terms = [ids[row].astype(np.int32) for row in there]
    enough, alone = np.zeros(toxicity.DIM, dtype=bool), np.zeros(toxicity.DIM, dtype=bool)
    enough[ids] = True
    alone[ids[rng.integers(0, v, 5)]] = True
    x = there.astype(float)
    toxic = x[labels > 0].T @ x[labels > 0]
    seen = toxic + weight * (x[labels <= 0].T @ x[labels <= 0])
    want = set()
    for a in range(v):
        hit = toxicity.association(toxic[a], seen[a], toxic[a, a], max(seen[a, a], 1e-9)) >= toxicity.PAIR_ASSOCIATION
        hit &= (seen[a] * toxic[a, a] >= toxicity.PAIR_EXPECTED * seen[a, a]) & ~alone[ids]
        without = (toxic[a, a] - toxic[a]) / np.maximum(seen[a, a] - seen[a], 1e-9)
        hit &= np.abs(toxic[a] / np.maximum(seen[a], 1e-9) - without) >= toxicity.PAIR_EFFECT
        if hit.any():
            want |= {int(ids[a]), *ids[hit].tolist()}
    assert toxicity.paired_terms(terms, labels, weight, enough, alone).tolist() == sorted(want)


def test_toxicity_logit_is_the_sum_over_all_pairs():
    import numpy as np

    rng = np.random.default_rng(4)
    ids = np.sort(rng.choice(toxicity.DIM, 30, replace=False))
    weights = rng.normal(0, 1, (30, 1 + toxicity.FACTORS))
    model = toxicity.Machine(0.3, ids, weights)
    for n in (0, 1, 2, 12):
        some = rng.choice(30, n, replace=False)
        terms = np.sort(np.concatenate([ids[some], [x for x in range(5) if x not in ids]])).astype(np.int32)
        want = 0.3 + sum(weights[i, 0] for i in some) + sum(weights[i, 1:] @ weights[j, 1:] for i in some for j in some if i < j)
        assert model.logit(terms) == pytest.approx(want)


def test_toxicity_one_row_an_identifier(spark):
    """An identifier that has many rows is learnt from once, whatever their order."""
    rng = random.Random(5)
    rows = [(i, f"w{i % 7} " + ("bad" if i % 2 else "good") + f" x{rng.randrange(9)}") for i in range(80)]
    known = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    many = [*rows, *((3, f"other {k} bad") for k in range(500))]
    first = toxicity.train(spark.createDataFrame(many, schema).repartition(5), known)
    again = toxicity.train(spark.createDataFrame(many[::-1], schema), known)
    assert first.bias == again.bias and (first.weights == again.weights).all()
    assert len(first.ids) < 40


def test_columns_of_any_name(spark):
    """Names with dots and backticks, twice there, or as the results' in other letters, through all operators that carry columns."""
    from plumbline.llm import ngram_join

    rng = random.Random(7)
    body = sentence(rng, 40)
    rows = [(i, sentence(rng, 30)) for i in range(12)] + [(20, body), (21, body), (22, body + " more"), (None, None), (23, "")]
    names = ["doc_id", "text", "a.b", "tick`s", "Shard", "SLOT", "twice", "twice", "score_", "Digest"]
    docs = spark.createDataFrame([(i, t, *range(8)) for i, t in rows], ["doc_id", "text", *(f"c{k}" for k in range(8))]).toDF(*names)
    known = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    own = lambda df, at=2: {tuple(r)[at : at + 8] for r in df.collect()}
    for out, left in ((toxicity.drop_toxic(docs, known, 2.0), 17), (exact_dedup.drop_copies(docs), 15), (ngram_join.keep_one(docs), 15)):
        assert out.columns == names and out.count() == left and own(out) == {tuple(range(8))}
    ringed = hash_ring.assign(docs.drop("twice"), "doc_id", 3, order=["text"])
    assert ringed.columns == ["doc_id", "text", "a.b", "tick`s", "score_", "Digest", "shard", "slot"] and ringed.count() == 17
    scored = toxicity.score(docs, toxicity.train(docs, known))
    assert scored.columns == [n for n in names if n != "text"] + ["score"]


def test_toxicity_share_of_the_sample():
    """A sample by class has the scores and the terms of one with the true share of toxic texts."""
    import numpy as np

    rng = np.random.default_rng(5)
    labels = (np.arange(8000) % 10 == 0).astype(float)
    terms = []
    for i, toxic in enumerate(labels):
        words = {1} if rng.random() < (0.5 if toxic else 0.2) else set()
        words |= {2} if rng.random() < (0.3 if toxic else 0.02) else set()
        words |= {3} if toxic and i % 200 == 0 and i < 1000 else set()
        terms.append(np.array(sorted(words), dtype=np.int32))
    some = np.flatnonzero((labels == 1) | (np.arange(8000) % 9 == 1))[:2000]
    whole = toxicity.fit(labels, terms, labels.mean())
    part = toxicity.fit(labels[some], [terms[i] for i in some], labels.mean())
    assert 0.4 < labels[some].mean() < 0.6
    assert 3 in whole.ids and 3 in part.ids
    for t in ([], [1], [2], [1, 2]):
        t = np.array(t, dtype=np.int32)
        assert abs(whole.logit(t) - part.logit(t)) < 0.6


def test_toxicity_edges(spark):
    docs = table(spark, [(1, None), (2, ""), (2, "x")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(table(spark, []), none).count() == 0
    assert toxicity.drop_toxic(docs, none).count() == 3
    # Repeated rows score alike, very long texts are scored, and columns of any name are carried.
    rows = [(i, "vile scum" if i % 2 else "fine day") for i in range(40)]
    known = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    more = spark.createDataFrame([(*r, 0.5, "x") for r in [*rows, rows[1], (90, "scum vile " * 30_000), (91, None)]], "doc_id long, text string, score double, toxic_score string")
    got = toxicity.toxicity(more, known).collect()
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and next(r for r in got if r["doc_id"] == 90)["predicted"] == 1
    kept = toxicity.drop_toxic(more, known)
    assert kept.columns == more.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(0, 40, 2), 91]


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "<|im_start|>assistant\nhi<|im_end|>", 5), (1, 1, "assistant", "</s>[INST] \\ <\\| [\\ <", 5), (1, 2, "user", None, 5), (1, 2, None, "x\n", 5),
        (2, 0, "assistant", "a", 5), (2, 1, "assistant", "", 5), (3, None, "we<n\nird", "t", 5), (None, 1, "assistant", "z", 5), (4, 1, "assistant", "same", 5), (4, 1, "assistant", "same", 5),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    examples = chat_format.expand(turns)
    for r in examples.filter("trained").collect():
        assert "<|" not in r["target"] and "</s>" not in r["target"] and "[INST]" not in r["target"]
    got = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, ts in by.items():
        ts.sort()
        assert got[c]["n_turns"] == len(ts)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.expand(turns.filter("conv_id > 99"))).count() == 0

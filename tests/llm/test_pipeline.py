"""The pipeline's stages, each on what the one before it left, against brute force."""

import pytest

import corpus_pipeline
from tests.llm.test_corpus_ops import brute_cut
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_toxicity_rejects_labelled_documents(spark, steps):
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    gone = set(texts(steps[0])) - set(texts(steps[1]))
    assert len(gone & toxic) >= 0.5 * len(toxic) and len(gone - toxic) <= 0.1 * steps[0].count()


def test_one_of_each_text_stays(steps):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    last = {}
    for d, t in sorted(texts(steps[1]).items()):
        last[low(t)] = d
    assert set(texts(steps[2])) == set(last.values())


def test_one_of_each_class_stays(steps):
    assert set(texts(steps[3])) == {c for _, c in brute(list(texts(steps[2]).items()))}


def test_passages_are_cut(steps):
    before, after = texts(steps[3]), {r["doc_id"]: r for r in steps[4].collect()}
    assert set(before) == set(after)
    for d, n, removed, _, _ in brute_cut(list(before.items())):
        assert 0 <= (n - removed) - len(after[d]["text"].encode()) <= 6
        assert after[d]["n_chars"] == len(after[d]["text"])


def test_pieces_fill_sequences(steps):
    rows = steps[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts(steps[4]))
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.CAPACITY


def test_run_gives_the_last_stage_s_rows(spark, steps):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*key).collect())) == sorted(map(tuple, steps[5].select(*key).collect()))


def test_edges_through_the_chain(spark, tmp_path):
    """Nulls, repeated rows, clashing and odd names, and an empty table go through all stages."""
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(1, body, "s"), (1, body, "s"), (2, body.upper(), None), (3, body + " more", "s"), (4, None, "s"), (5, "", None), (None, "alone " * 3, "s"), (6, "short", "s")]
    names = ["doc_id", "text", "a.b", "Digest", "tick`s"]
    full = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, s string, d int, t int").toDF(*names)
    for k, docs in enumerate((full, full.limit(0))):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert i == 4 or out.columns == names
            out.write.parquet(f"{tmp_path}/{k}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{i}")
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept == set() if k else {None, 6} <= kept and len(kept & {1, 2, 3}) == 1

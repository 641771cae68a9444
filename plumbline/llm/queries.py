"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    ball_kmeans,
    bpe_replay,
    chat_format,
    exact_dedup,
    fill_middle,
    hash_ring,
    lattice_lm,
    ngram_join,
    packing,
    quality_rules,
    suffix_dedup,
    toxicity,
    url_rules,
)

SHARDS = 24
CAPACITY = 2048
CLUSTERS, ROUNDS = 40, 5
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; a worker on another machine needs it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_failed", F.round("host_rate", 6).alias("host_rate")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = hash_ring.assign(rows, "doc_id", SHARDS, order=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    added = packing.added_tokens(vocabulary("byte_bpe_50k.json"))
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern(), capacity, added)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.digest_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(documents(spark, sf_dir))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.read_back(chat_format.expand(turns))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return ball_kmeans.described(*ball_kmeans.ball_kmeans(vectors, order, CLUSTERS, ROUNDS))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.filter_urls(pages, rules).drop("url")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.transform(documents(spark, sf_dir).select("doc_id", "text"))).drop("text")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_ngram_join": op4_ngram_join,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_bpe": op8_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_url_filters": op12_url_filters,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES: dict[str, str] = {}

ORACLES["op2_quality_rules"] = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) AS offsets(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, w.source,
         CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(l.n_lines, 0) AS n_lines,
         CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words w LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words AS shape_failed
  FROM counted
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR shape_failed) AS f FROM ruled GROUP BY source
), moments AS (
  SELECT sum(f) / sum(n) AS m, sum(f * (f / n)) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS v FROM hosts
), prior AS (
  SELECT m, CASE WHEN v > 1e-12 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS weight FROM moments
), rates AS (
  SELECT source, (f + m * weight) / (n + weight) AS host_rate, least(0.5, greatest(0.3, m + 3 * sqrt(m * (1 - m) / (weight + 1)))) AS host_cut FROM hosts, prior
)
SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
       NOT r.base_failed AND h.host_rate < h.host_cut AS kept, r.base_failed OR r.shape_failed AS rule_failed, round(h.host_rate, 6) AS host_rate
FROM ruled r JOIN rates h ON r.source IS NOT DISTINCT FROM h.source
"""

ORACLES["op5_exact_dedup"] = r"""
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), grouped AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM normal JOIN grouped USING (norm)
"""

ORACLES["op10_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         length(text) + length(regexp_replace(text, '[^<\[]', '', 'g'))
           + length(role) + length(regexp_replace(role, '[^<\[]', '', 'g')) + 24 AS chars
  FROM turns
), running AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far, max(i) OVER (PARTITION BY conv_id) AS n FROM numbered
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN so_far ELSE 0 END) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""


def _kmeans_sql(k: int, rounds: int) -> str:
    """Every vector against every centroid, a round after the other."""
    steps = [
        """WITH points AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM points ORDER BY h, v LIMIT {k})
)""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (
  SELECT r, vec_id, p.v, c, list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - k.v[i]) * (p.v[i] - k.v[i]))) AS d FROM points p, c{i} k
), a{i} AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := CAST(d AS BIGINT), c := c)) AS best FROM d{i} GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT c, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x, sum(x) AS s, count(*) AS n
  FROM (SELECT best.c AS c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{i}) GROUP BY c, i
), u{i} AS (
  SELECT c, list(CASE WHEN x * n > s THEN x - 1 WHEN (x + 1) * n <= s THEN x + 1 ELSE x END ORDER BY i) AS v FROM m{i} GROUP BY c
), c{i + 1} AS (
  SELECT k.c, coalesce(u.v, k.v) AS v FROM c{i} k LEFT JOIN u{i} u ON k.c = u.c
)""")
    n = rounds
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(k.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{n} JOIN c{n} k ON best.c = k.c
"""


ORACLES["op11_ball_kmeans"] = _kmeans_sql(CLUSTERS, ROUNDS)

ORACLES["op12_url_filters"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), placed AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM placed
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fitting f ON p.page_id = f.page_id AND f.place = 1
"""

ORACLES["op13_fill_middle"] = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS hs FROM lines
), cut AS (
  SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 100 AS is_plain
  FROM drawn
), parts AS (
  SELECT doc_id, text, n, CASE WHEN is_plain THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
  FROM cut
)
SELECT doc_id, n, form,
       CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

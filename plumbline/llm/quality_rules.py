"""Quality rules at the level of hosts.

Document rules give counts and a pass or fail for each text: the base rule (too few words, or too many of them in
repeated windows), and rules on the share of symbols, of repeated lines, and on the mean length of words. Documents that
fail any rule are aggregated by host (the source column); an empirical beta prior, fitted to all hosts' rates by
moments, shrinks each host's rate towards the mean, the more so the fewer documents it has. Hosts whose
shrunken rate reaches the cut fail, and their verdict joins back to their documents. The cut is PRIOR_SDS standard
deviations of the prior above its mean, within HOST_RATE_BOUNDS: where hosts are much alike, none fails. The
prior's weight stays within PRIOR_WEIGHT: hosts that differ more than any beta prior of weight 1 get that one.

Defined results: null and empty texts have no words and fail; very long texts are counted in whole; null hosts form
one host of their own; a rate equal to the cut fails; repeated rows count each time; only doc_id, text and the host are
read, so no other column clashes; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Shares, in percent, of symbols among the characters of words and of repeated lines among lines with a word; and the mean length of words.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
MEAN_WORD_CHARS = (2, 14)
#: Where the cut on hosts' rates is: so many deviations above the prior's mean, within bounds.
PRIOR_SDS, HOST_RATE_BOUNDS = 3.0, (0.3, 0.5)
PRIOR_WEIGHT = (1.0, 1e6)


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    pair = ids[:-2] * len(seen) + ids[1:-1]
    if len(seen) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair * len(seen) + ids[2:]
    order = np.argsort(triple, kind="stable")
    ranked = triple[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines); lines are those with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _count_batches(batches):
    for b in batches:
        rows = [counts_of(x.as_py()) for x in b.column("text")]
        table = np.array(rows, dtype=np.int64).reshape(len(rows), 6)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("host"), *(pa.array(table[:, i].copy()) for i in range(6))],
            names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
        )


def rule_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """The document rules' counts and verdict of every row: a written table without texts."""
    counted = docs.select("doc_id", F.col(host).cast("string").alias("host"), "text").mapInArrow(
        _count_batches, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    low, high = MEAN_WORD_CHARS
    shape = (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < low * F.col("n_words"))
        | (F.col("word_chars") > high * F.col("n_words"))
    )
    return materialize(counted.withColumn("base_failed", failed).withColumn("rule_failed", F.col("base_failed") | shape), "rules")


def host_rates(counted: DataFrame) -> DataFrame:
    """(host, host_docs, host_rate, host_cut): each host's failure rate under the empirical beta prior, and the cut.

    Prior: mean m is the rate over all documents, v the variance of host rates weighted by
    documents; its weight is m (1 - m) / v - 1, within PRIOR_WEIGHT.
    """
    hosts = counted.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("rule_failed").alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    moments = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("m"),
        (F.sum(F.col("host_failed") * rate) / F.sum("host_docs")).alias("m2"),
    )
    low, high = PRIOR_WEIGHT
    row = moments.first()
    m, v = row["m"] or 0.0, (row["m2"] or 0.0) - (row["m"] or 0.0) ** 2
    weight = max(low, min(high, m * (1 - m) / v - 1)) if v > 1e-12 else high
    floor, ceiling = HOST_RATE_BOUNDS
    cut = min(ceiling, max(floor, m + PRIOR_SDS * math.sqrt(m * (1 - m) / (weight + 1))))
    return hosts.select("host", "host_docs", F.lit(cut).alias("host_cut"), ((F.col("host_failed") + m * weight) / (F.col("host_docs") + weight)).alias("host_rate"))


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row per row of ``docs``: the counts, base_failed, rule_failed, kept, host_rate, host_cut."""
    counted = rule_counts(docs, host)
    rates = host_rates(counted).select(F.col("host").alias("rated_host"), "host_rate", "host_cut")
    joined = counted.join(rates, F.col("host").eqNullSafe(F.col("rated_host")), "left")
    kept = ~F.col("base_failed") & (F.col("host_rate") < F.col("host_cut"))
    return joined.withColumn("kept", kept).drop("host", "rated_host")

"""URL filters: rules on hosts and paths, found by hashes of host-suffix and path-prefix expressions.

A rule has a host and a path and allows or blocks. It fits the urls of its host and of all subdomains whose path
starts with the rule's; of several that fit, the longest decides.

A rule's expression is its host and the directory of its path (up to the last slash); a url's are
all suffixes of its host, whole labels, with all prefixes of its path that end in a slash, and with none.
Only those are made whose number of labels and of slashes some rule has, which leaves no rule
out. Expressions meet in an equi-join on the first PREFIX bytes of their SHA-256; then the full
digests are compared, then what a rule's path has after its last slash, and then precedence: the longest rule text, of
equally long ones the longest host, then block before allow.

Each different (host, path) is judged once: urls are made distinct before they are expanded, with partial
sums, so that a hot host or page costs a row a task. The verdicts found are written, and joined back to the rows on host
and path as a plain join, which adaptive execution may split where one url has many rows. The rules are
broadcast only where Spark finds them below its size threshold.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule with a host fits; hosts of
rules are compared with A-Z in lower case; a rule with a null host, path or verdict is left out; of a rule given twice with
both verdicts block holds; very long urls are judged whole; repeated rows are rows of their own; columns
named host, path, rule or verdict give way to the result's, others may have any name; an empty table gives no rows, and without rules
every row has the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import carried, lower_ascii, materialize, where

ALLOW, BLOCK = "allow", "block"

#: Bytes of a digest by which expressions meet.
PREFIX = 4

#: Pairs of (labels, slashes) up to which a url is expanded for those pairs only; beyond it, for all up to the largest.
MAX_SHAPES = 1024


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, number sign or the end, A-Z lower-cased."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    for mark in "/?#":
        rest = F.substring_index(rest, mark, 1)
    return F.when(F.instr(url, "://") > 0, lower_ascii(rest)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, number sign or the end."""
    after = F.substring(url, F.instr(url, "://") + 3 + F.length(host_of(url)), F.length(url))
    for mark in "?#":
        after = F.substring_index(after, mark, 1)
    return F.when(F.instr(url, "://") > 0, after).otherwise("")


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/")))


def suffix(host: Column, n: Column) -> Column:
    """The last ``n`` labels."""
    return F.call_function("substring_index", host, F.lit("."), -n)


def directory(path: Column, n: Column) -> Column:
    """The path up to its ``n``-th slash, which it has; empty for none."""
    return F.when(n == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/")))


def digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def indexed(rules: DataFrame) -> DataFrame:
    """The rules with their expression: rule, rule_host, rule_path, rule_verdict, labels, slashes, rule_digest, prefix."""
    known = rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").filter(
        F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK)
    )
    one = known.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    shaped = one.withColumn("labels", labels(F.col("rule_host"))).withColumn("slashes", slashes(F.col("rule_path")))
    hashed = shaped.withColumn("rule_digest", digest(F.concat("rule_host", directory(F.col("rule_path"), F.col("slashes")))))
    return hashed.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("prefix", F.substring("rule_digest", 1, PREFIX))


def shapes_of(index: DataFrame, host: Column, path: Column, most: int) -> Column:
    """An array of the (l, s) pairs of label and slash numbers for which a url is expanded."""
    found = index.select("labels", "slashes").distinct().orderBy("labels", "slashes").limit(most + 1).collect()
    n_labels, n_slashes = labels(host), slashes(path)
    if len(found) <= most:
        pairs = F.array(*(F.struct(F.lit(r["labels"]).alias("l"), F.lit(r["slashes"]).alias("s")) for r in found)) if found else F.array().cast("array<struct<l:int,s:int>>")
        return F.filter(pairs, lambda p: (p["l"] <= n_labels) & (p["s"] <= n_slashes))
    top = index.agg(F.max("labels").alias("l"), F.max("slashes").alias("s")).first()
    down, across = F.sequence(F.lit(1), F.least(n_labels, F.lit(top["l"]))), F.sequence(F.lit(0), F.least(n_slashes, F.lit(top["s"])))
    return F.flatten(F.transform(down, lambda l: F.transform(across, lambda s: F.struct(l.alias("l"), s.alias("s")))))


def expand(places: DataFrame, index: DataFrame, most: int = MAX_SHAPES) -> DataFrame:
    """A row per expression of each (host, path): host, path, digest, prefix."""
    host, path = F.col("host"), F.col("path")
    shaped = places.select("host", "path", F.explode(shapes_of(index, host, path, most)).alias("p"))
    made = shaped.select("host", "path", digest(F.concat(suffix(host, F.col("p.l")), directory(path, F.col("p.s")))).alias("digest"))
    return made.withColumn("prefix", F.substring("digest", 1, PREFIX))


def judged(places: DataFrame, index: DataFrame, most: int = MAX_SHAPES) -> DataFrame:
    """(host, path, rule, verdict) of the distinct ``places`` that a rule fits."""
    met = expand(places, index, most).join(index, "prefix").filter((F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
    rank = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule_verdict", "rule")
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW, most_shapes: int = MAX_SHAPES) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules``: (host, path, verdict). ``default``: the verdict of pages that no rule fits.
    """
    safe, kept = carried(pages, "host", "path", "rule", "verdict")
    text = F.col(f"c{where(pages, url)}")
    names = [s for s, _ in kept]
    rows = safe.select(*names, F.coalesce(host_of(text), F.lit("")).alias("host"), F.coalesce(path_of(text), F.lit("")).alias("path"))
    found = materialize(judged(rows.select("host", "path").distinct(), indexed(rules), most_shapes), "judged")
    # Texts shrink many times over in a file, so a file's size is no bound for a broadcast.
    out = rows.join(found.hint("merge"), ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return out.select(*names, "host", "path", "rule", "verdict").toDF(*(g for _, g in kept), "host", "path", "rule", "verdict")

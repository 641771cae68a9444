"""An index of exemptions by the literal ends of their patterns.

Every pattern has a literal beginning (up to its first wildcard) and a literal end (after its last); the longer of the two is
its key, together with its kind and column where it names them. Subjects are expanded to their beginnings and ends of just the
lengths that keys have, as in a trie one level of which is a length, and meet the keys in an equi-join.
Only what meets is matched as a whole. So the plan has the same size for ten exemptions and for a hundred
thousand, and a finding is compared with those that share its key.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.policy import Exemption

ANY = "*"
SCHEMA = "ord int, side string, literal string, kind_key string, column_key string, regex string, downgrade_to string, reason string, expires string"


def literal_ends(pattern: str) -> tuple[str, str]:
    """What every match begins with and ends in."""
    return re.split(r"[*?\[]", pattern, maxsplit=1)[0], re.split(r"[*?\]]", pattern)[-1]


def index(spark: SparkSession, exemptions: Sequence[Exemption]) -> DataFrame:
    """A row per exemption, in their order."""
    rows = []
    for i, x in enumerate(exemptions):
        begin, end = literal_ends(x.urn_pattern) if x.urn_pattern is not None else ("", "")
        side, literal = ("begin", begin) if len(begin) >= len(end) else ("end", end)
        regex = None if x.urn_pattern is None else r"\A" + fnmatch.translate(x.urn_pattern).replace(r"\Z", "").replace(r"\z", "") + r"\z"
        expires = x.expires.isoformat() if x.expires else None
        rows.append((i, side, literal, x.kind or ANY, ANY if x.column is None else f"={x.column}", regex, x.downgrade_to, x.reason, expires))
    return spark.createDataFrame(rows, SCHEMA)


def first_match(findings: DataFrame, exemptions: Sequence[Exemption]) -> DataFrame:
    """``findings`` with exemption, a struct (ord, downgrade_to, reason, expires) of the first that covers them, null for none."""
    keys = index(findings.sparkSession, exemptions)
    lengths = sorted({(r[0], r[1]) for r in keys.select("side", F.length("literal")).distinct().collect()})
    subject = ["kind", "subject_urn", "subject_column"]
    urn = F.col("subject_urn")
    tried = F.filter(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(n).alias("n")) for s, n in lengths)), lambda t: t["n"] <= F.length(urn))
    kinds = F.array(F.col("kind"), F.lit(ANY))
    columns = F.filter(F.array(F.concat(F.lit("="), "subject_column"), F.lit(ANY)), lambda c: c.isNotNull())
    spread = findings.select(*subject).distinct().select(*subject, F.explode(tried).alias("t"))
    begin, end = F.substring(urn, F.lit(1), F.col("t.n")), F.substring(urn, F.length(urn) - F.col("t.n") + 1, F.col("t.n"))
    spread = spread.select(*subject, F.col("t.side").alias("side"), F.when(F.col("t.side") == "begin", begin).otherwise(end).alias("literal"))
    spread = spread.withColumn("kind_key", F.explode(kinds)).withColumn("column_key", F.explode(columns))
    met = spread.join(keys, ["side", "literal", "kind_key", "column_key"]).filter(F.col("regex").isNull() | F.regexp_like("subject_urn", F.col("regex")))
    first = met.groupBy(*subject).agg(F.min(F.struct("ord", "downgrade_to", "reason", "expires")).alias("exemption"))
    named = first.select(*(F.col(c).alias(f"{c}_") for c in subject), "exemption")
    same = (F.col("kind") == F.col("kind_")) & (urn == F.col("subject_urn_")) & F.col("subject_column").eqNullSafe(F.col("subject_column_"))
    return findings.join(named, same, "left").drop(*(f"{c}_" for c in subject))

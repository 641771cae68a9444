"""Registered queries, one per operator or small group, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.functions.durable import cut
from plumbline.operators import diff, graph, impact, lineage, profile, sketches, verdict
from plumbline.operators.policy import Exemption, Policy, Thresholds
from plumbline.operators.snapshot import Snapshot
from plumbline.plans import slices
from plumbline.streaming import latest, watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    """Registers the function under its own or another name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql
        return f

    return register


def number(key: str, digits: int, name: str | None = None):
    return F.round(F.col("evidence")[key].cast("double"), digits).alias(name or key)


# -- profiles -----------------------------------------------------------------


def _profile_sql(table: str, column: str) -> str:
    return f"""SELECT '{table}' AS asset, '{column}' AS path, count(*) AS row_count, count(*) FILTER (WHERE {column} IS NULL) AS null_count,
      count(DISTINCT {column}) AS unique_count, round(CAST(min({column}) AS DOUBLE), 2) AS min, round(CAST(max({column}) AS DOUBLE), 2) AS max,
      round(avg({column}), 3) AS mean, round(stddev_samp({column}), 3) AS stdev FROM {table}"""


_PROFILED = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]}


@query(" UNION ALL ".join(_profile_sql(t, c) for t, cs in _PROFILED.items() for c in cs))
def profile_table(spark, sf_dir):
    parts = [profile.profile(slices.table(spark, sf_dir, t).withColumn("asset", F.lit(t)), ["asset"], cs) for t, cs in _PROFILED.items()]
    both = parts[0].unionByName(parts[1])
    shown = [F.round(X.finite(F.col(s)), d).alias(s) for s, d in (("min", 2), ("max", 2), ("mean", 3), ("stdev", 3))]
    return both.select("asset", "path", "row_count", "null_count", "unique_count", *shown)


def _merged_sql(table: str, column: str) -> str:
    return f"""SELECT '{table}' AS asset, '{column}' AS path, count(*) AS row_count, count(*) FILTER (WHERE {column} IS NULL) AS null_count,
      count(DISTINCT {column}) AS unique_count, round(CAST(min({column}) AS DOUBLE), 2) AS min, round(CAST(max({column}) AS DOUBLE), 2) AS max,
      round(avg({column}), 3) AS mean, round(stddev_samp({column}), 3) AS stdev, true AS unique_within, true AS quartiles_within FROM {table}"""


def _marks(columns):
    """Each column's quartiles as columns of their own, from a map by column and share."""
    return [F.col("marks")[c][share].alias(f"{c}_q{i}") for c in columns for i, share in enumerate(sketches.QUARTILES)]


def _quartiles_within(column):
    """Whether the ranks of a column's quartiles among its values are as near as the sketch promises; true without values."""
    value, near = F.col(column).cast("double"), F.lit(True)
    for i, share in enumerate(sketches.QUARTILES):
        below, upto = (F.avg(x.cast("int")) for x in (value < F.col(f"{column}_q{i}"), value <= F.col(f"{column}_q{i}")))
        near = near & (below <= share + sketches.RANK_ERROR) & (upto >= share - sketches.RANK_ERROR)
    return F.coalesce(near, F.lit(True))


@query(" UNION ALL ".join(_merged_sql(t, c) for t, cs in _PROFILED.items() for c in cs))
def profile_merged(spark, sf_dir):
    """States of every month, merged; the sketches are held against exact counts and ranks of the whole tables."""
    out = []
    for t, day in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        rows, columns = slices.table(spark, sf_dir, t).withColumn("asset", F.lit(t)), _PROFILED[t]
        # A merge reads the states twice; they are written, so that the rows are not.
        monthly = cut(sketches.sketch(rows.withColumn("month", F.date_trunc("month", day)), ["asset", "month"], columns), "states")
        merged = cut(sketches.finish(sketches.merge(monthly, ["asset"]), ["asset"]), "merged")
        # A count a column: together they would multiply the rows by the columns.
        exact = reduce(DataFrame.unionByName, (rows.groupBy("asset").agg(F.count_distinct(c).alias("exact")).select("asset", F.lit(c).alias("path"), "exact") for c in columns))
        # The quartiles of all columns are one row an asset, so each row is met once, not once a column and quartile.
        marks = merged.groupBy("asset").agg(F.map_from_entries(F.collect_list(F.struct("path", "quantiles"))).alias("marks"))
        within = [_quartiles_within(c).alias(c) for c in columns]
        near = rows.join(F.broadcast(marks.select("asset", *_marks(columns))), "asset").groupBy("asset").agg(*within)
        near = near.select("asset", F.inline(F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).alias("quartiles_within")) for c in columns))))
        close = F.abs(F.col("unique_count") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")
        shown = [F.round(X.finite(F.col(s)), d).alias(s) for s, d in (("min", 2), ("max", 2), ("mean", 3), ("stdev", 3))]
        both = merged.join(exact, ["asset", "path"]).join(near, ["asset", "path"])
        out.append(both.select("asset", "path", "row_count", "null_count", F.col("exact").alias("unique_count"), *shown, close.alias("unique_within"), "quartiles_within"))
    return out[0].unionByName(out[1])


@query(
    """SELECT user_id, ts, event_id, event_type, round(value, 4) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""
)
def profile_latest(spark, sf_dir):
    events = slices.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return profile.latest(events, ["user_id"], "ts").withColumn("value", F.round("value", 4))


# -- statistics ---------------------------------------------------------------

_STATS = """
WITH raw AS (
  SELECT o_orderdate >= TIMESTAMP '1998-04-15' AS cur, n_nationkey AS k, n_name, n_regionkey, o_orderkey, o_custkey, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), rows AS (
  SELECT CASE WHEN cur THEN 'new' ELSE 'old' END AS side, k, n_name, n_regionkey,
    CASE WHEN cur AND k % 7 = 1 AND o_custkey % 3 = 0 THEN NULL WHEN cur AND k % 5 = 0 THEN o_totalprice * 6
         WHEN NOT cur AND k % 11 = 3 THEN 1000.0 ELSE o_totalprice END AS price,
    CASE WHEN cur AND k % 8 = 4 THEN o_orderkey % 5 ELSE o_orderkey % 40 END AS bucket
  FROM raw WHERE NOT (cur AND k % 6 = 2 AND o_orderkey % 10 < 6)
), stats AS (
  SELECT side, k, n_name, n_regionkey, 'price' AS path, count(*) AS n, count(*) FILTER (WHERE price IS NULL) AS nulls, count(DISTINCT price) AS uniq,
    CAST(min(price) AS DOUBLE) AS lo, CAST(max(price) AS DOUBLE) AS hi, avg(price) AS mean, stddev_samp(price) AS sd FROM rows GROUP BY side, k, n_name, n_regionkey
  UNION ALL
  SELECT side, k, n_name, n_regionkey, 'bucket', count(*), count(*) FILTER (WHERE bucket IS NULL), count(DISTINCT bucket),
    CAST(min(bucket) AS DOUBLE), CAST(max(bucket) AS DOUBLE), avg(bucket), stddev_samp(bucket) FROM rows GROUP BY side, k, n_name, n_regionkey
), kept AS (
  SELECT *, 'urn:li:dataset:(urn:li:dataPlatform:spark,orders.' || n_name || ',PROD)' AS urn FROM stats
  WHERE NOT (side = 'old' AND k % 12 = 9 AND path = 'bucket')
), pairs AS (
  SELECT a.urn, a.path, a.k, a.n_regionkey, a.n AS on_, b.n AS nn, a.nulls AS onull, b.nulls AS nnull, a.uniq AS ou, b.uniq AS nu,
    a.lo AS olo, b.lo AS nlo, a.hi AS ohi, b.hi AS nhi, a.mean AS om, b.mean AS nm, a.sd AS osd, b.sd AS nsd
  FROM kept a JOIN kept b ON a.urn = b.urn AND a.path = b.path WHERE a.side = 'old' AND b.side = 'new'
), counts AS (
  SELECT a.urn, max(a.k) AS k, max(a.n_regionkey) AS n_regionkey, max(a.n) AS on_, max(b.n) AS nn FROM kept a JOIN kept b USING (urn) WHERE a.side = 'old' AND b.side = 'new' GROUP BY a.urn
), null_jumps AS (
  SELECT *, (nnull / nn - onull / on_) * 100 AS v FROM pairs WHERE (nnull / nn - onull / on_) * 100 > 10
), cardinality AS (
  SELECT *, (nu - ou) / abs(ou) * 100 AS v FROM pairs WHERE ou <> 0 AND abs((nu - ou) / abs(ou) * 100) > 50
), shifts AS (
  SELECT *, CASE WHEN osd > 0 THEN (nm - om) / osd END AS v FROM pairs
  WHERE om IS NOT NULL AND nm IS NOT NULL AND CASE WHEN osd <= 0 THEN nm <> om ELSE abs((nm - om) / osd) > 3 END
), ranges AS (
  SELECT *, CASE WHEN nlo < olo THEN olo - nlo END AS low, CASE WHEN nhi > ohi THEN nhi - ohi END AS high FROM pairs
  WHERE olo IS NOT NULL AND ohi IS NOT NULL AND (nlo < olo OR nhi > ohi)
), volumes AS (
  SELECT *, (nn - on_) / on_ * 100 AS v FROM counts WHERE abs((nn - on_) / on_ * 100) > 50
), found AS (
  SELECT 'NULL_RATE_JUMP' AS kind, urn AS subject_urn, path AS subject_column, k, n_regionkey FROM null_jumps
  UNION ALL SELECT 'CARDINALITY_CHANGE', urn, path, k, n_regionkey FROM cardinality
  UNION ALL SELECT 'MEAN_SHIFT', urn, path, k, n_regionkey FROM shifts
  UNION ALL SELECT 'RANGE_VIOLATION', urn, path, k, n_regionkey FROM ranges
  UNION ALL SELECT 'ROW_COUNT_CHANGE', urn, NULL, k, n_regionkey FROM volumes
)
"""


def _stat(spark, sf_dir, kind: str) -> DataFrame:
    baseline, current = slices.order_snapshots(spark, sf_dir)
    limits = Thresholds()
    if kind == "ROW_COUNT_CHANGE":
        return diff.row_count_changes(baseline, current, limits)
    pairs = diff.profile_pairs(baseline, current)
    if kind == "RANGE_VIOLATION":
        return diff.range_violations(pairs, current)
    return {"NULL_RATE_JUMP": diff.null_rate_jumps, "CARDINALITY_CHANGE": diff.cardinality_changes, "MEAN_SHIFT": diff.mean_shifts}[kind](pairs, current, limits)


@query(_STATS + "SELECT urn AS subject_urn, path AS subject_column, round(v, 3) AS jump_pp, onull AS old_null_count, nnull AS new_null_count FROM null_jumps")
def null_rate_jump(spark, sf_dir):
    e = F.col("evidence")
    counts = [e[c].cast("bigint").alias(c) for c in ("old_null_count", "new_null_count")]
    return _stat(spark, sf_dir, "NULL_RATE_JUMP").select("subject_urn", "subject_column", number("jump_pp", 3), *counts)


@query(_STATS + "SELECT urn AS subject_urn, path AS subject_column, ou AS old_unique_count, nu AS new_unique_count, round(v, 2) AS change_pct, CASE WHEN v < 0 THEN 'collapsed' ELSE 'exploded' END AS direction FROM cardinality")
def cardinality_change(spark, sf_dir):
    e = F.col("evidence")
    counts = [e[c].cast("bigint").alias(c) for c in ("old_unique_count", "new_unique_count")]
    return _stat(spark, sf_dir, "CARDINALITY_CHANGE").select("subject_urn", "subject_column", *counts, number("change_pct", 2), e["direction"].alias("direction"))


@query(_STATS + "SELECT urn AS subject_urn, path AS subject_column, round(om, 2) AS old_mean, round(nm, 2) AS new_mean, round(v, 2) AS sigma FROM shifts")
def mean_shift(spark, sf_dir):
    return _stat(spark, sf_dir, "MEAN_SHIFT").select("subject_urn", "subject_column", number("old_mean", 2), number("new_mean", 2), number("sigma", 2))


@query(_STATS + "SELECT urn AS subject_urn, path AS subject_column FROM shifts WHERE osd <= 0")
def mean_shift_constant(spark, sf_dir):
    return _stat(spark, sf_dir, "MEAN_SHIFT").filter(F.col("evidence")["sigma"].isNull()).select("subject_urn", "subject_column")


@query(_STATS + "SELECT urn AS subject_urn, path AS subject_column, round(low, 2) AS min_breach, round(high, 2) AS max_breach FROM ranges")
def range_violation(spark, sf_dir):
    return _stat(spark, sf_dir, "RANGE_VIOLATION").select("subject_urn", "subject_column", number("min_breach", 2), number("max_breach", 2))


@query(_STATS + "SELECT urn AS subject_urn, on_ AS old_row_count, nn AS new_row_count, round(v, 2) AS change_pct, CASE WHEN v < 0 THEN 'dropped' ELSE 'grew' END AS direction FROM volumes")
def row_count_change(spark, sf_dir):
    e = F.col("evidence")
    counts = [e[c].cast("bigint").alias(c) for c in ("old_row_count", "new_row_count")]
    return _stat(spark, sf_dir, "ROW_COUNT_CHANGE").select("subject_urn", *counts, number("change_pct", 2), e["direction"].alias("direction"))


@query(
    _STATS
    + f""", shared AS (SELECT DISTINCT a.urn FROM kept a JOIN kept b USING (urn) WHERE a.side = 'old' AND b.side = 'new')
    SELECT '{slices.MODEL}' AS model_urn, 2 * (SELECT count(*) FROM shared) AS columns_total, (SELECT count(*) FROM pairs) AS columns_compared,
      (SELECT count(*) FROM shared) AS assets_total, (SELECT count(*) FROM shared) AS assets_profiled,
      round((SELECT count(*) FROM pairs) / (2 * (SELECT count(*) FROM shared)), 6) AS ratio, (SELECT count(*) FROM pairs) = 0 AS is_blind"""
)
def profile_coverage(spark, sf_dir):
    baseline, current = slices.order_snapshots(spark, sf_dir)
    common = diff.column_pairs(baseline, current)
    return profile.coverage(common, baseline.profiles, current.profiles, diff.shared_assets(baseline, current)).withColumn("ratio", F.round("ratio", 6))


# -- schema -------------------------------------------------------------------

_TYPE_LIST = ", ".join(f"'{t}'" for t in slices.TYPES)
_PARTS = f"""
WITH grouped AS (
  SELECT 'urn:li:dataset:(urn:li:dataPlatform:spark,parts.' || p_brand || ',PROD)' AS urn, p_type || '_' || p_size AS path, p_partkey % 2 AS side, sum(p_size) AS k
  FROM part GROUP BY ALL
), typed AS (SELECT *, [{_TYPE_LIST}][CAST(k % {len(slices.TYPES)} + 1 AS INT)] AS native, k % 3 = 0 AS nullable FROM grouped),
old AS (SELECT * FROM typed WHERE side = 0), new AS (SELECT * FROM typed WHERE side = 1)
"""
_FITS = """
CASE WHEN fo IS NULL OR fn IS NULL THEN true
  WHEN fo = 'int' AND fn = 'int' THEN bn >= bo
  WHEN fo = 'float' AND fn = 'float' THEN bn >= bo
  WHEN fo = 'decimal' AND fn = 'decimal' THEN pn - sn >= po - so AND sn >= so
  WHEN fo = 'string' AND fn = 'string' THEN ln IS NULL OR (lo IS NOT NULL AND ln >= lo)
  WHEN fo = 'int' AND fn IN ('float', 'decimal') THEN true
  WHEN fo = 'decimal' AND fn = 'int' THEN so = 0 ELSE false END
"""


def _parsed_sql(native: str, side: str) -> str:
    base = f"trim(lower(regexp_extract({native}, '^([A-Za-z_]+)', 1)))"
    first, second = (f"TRY_CAST(regexp_extract({native}, '{p}', 1) AS BIGINT)" for p in (r"\((\d+)", r",\s*(\d+)\)"))
    return f"""
      CASE WHEN {base} IN ('int', 'bigint', 'smallint') THEN 'int' WHEN {base} IN ('float', 'double') THEN 'float'
           WHEN {base} IN ('decimal', 'number') THEN 'decimal' WHEN {base} IN ('varchar', 'text') THEN 'string' END AS f{side},
      CASE {base} WHEN 'smallint' THEN 16 WHEN 'int' THEN 32 WHEN 'bigint' THEN 64 WHEN 'float' THEN 32 WHEN 'double' THEN 64 END AS b{side},
      coalesce({first}, 38) AS p{side}, CASE WHEN {first} IS NULL THEN 9 ELSE coalesce({second}, 0) END AS s{side}, {first} AS l{side}"""


@query(
    f"""WITH t AS (SELECT unnest([{_TYPE_LIST}]) AS native), p AS (SELECT a.native AS old_native, b.native AS new_native FROM t a CROSS JOIN t b),
    q AS (SELECT *, {_parsed_sql('old_native', 'o')}, {_parsed_sql('new_native', 'n')} FROM p)
    SELECT old_native, new_native, {_FITS} AS lossless FROM q"""
)
def type_compat_matrix(spark, sf_dir):
    types = F.array(*map(F.lit, slices.TYPES))
    pairs = spark.range(1).select(F.explode(types).alias("old_native")).select("old_native", F.explode(types).alias("new_native"))
    number_type = F.lit("number")
    return pairs.select("old_native", "new_native", X.lossless_change(number_type, F.col("old_native"), number_type, F.col("new_native")).alias("lossless"))


@query(_PARTS + "SELECT urn AS subject_urn, path AS subject_column, native AS native_type FROM old o WHERE urn IN (SELECT urn FROM new) AND NOT EXISTS (SELECT 1 FROM new n WHERE n.urn = o.urn AND n.path = o.path)")
def schema_dropped(spark, sf_dir):
    return diff.dropped_columns(*slices.part_snapshots(spark, sf_dir)).select("subject_urn", "subject_column", F.col("evidence")["native_type"].alias("native_type"))


@query(_PARTS + "SELECT urn AS subject_urn, path AS subject_column, native AS native_type FROM new o WHERE urn IN (SELECT urn FROM old) AND NOT EXISTS (SELECT 1 FROM old n WHERE n.urn = o.urn AND n.path = o.path)")
def schema_added(spark, sf_dir):
    return diff.added_columns(*slices.part_snapshots(spark, sf_dir)).select("subject_urn", "subject_column", F.col("evidence")["native_type"].alias("native_type"))


_CHANGED = f""", p AS (SELECT urn, path, o.native AS old_native_type, n.native AS new_native_type, o.nullable AS onull, n.nullable AS nnull FROM old o JOIN new n USING (urn, path)),
q AS (SELECT *, {_parsed_sql('old_native_type', 'o')}, {_parsed_sql('new_native_type', 'n')} FROM p), changed AS (SELECT * FROM q WHERE NOT ({_FITS}))"""


@query(
    _PARTS + _CHANGED + """SELECT urn AS subject_urn, path AS subject_column, old_native_type, new_native_type, 'Column `' || path || '` on parts.' || regexp_extract(urn, 'parts\\.([^,]*)', 1)
      || ' changed type ' || old_native_type || ' → ' || new_native_type || '; not all old values fit, which feeds ' || regexp_extract(urn, '#([0-9]+)', 1) AS summary FROM changed"""
)
def type_changed(spark, sf_dir):
    e = F.col("evidence")
    found = diff.changed_types(*slices.part_snapshots(spark, sf_dir))
    return found.select("subject_urn", "subject_column", *(e[c].alias(c) for c in ("old_native_type", "new_native_type")), "summary")


@query(_PARTS + "SELECT n.urn AS subject_urn, n.path AS subject_column FROM old o JOIN new n USING (urn, path) WHERE n.nullable AND NOT o.nullable")
def nullability_relaxed(spark, sf_dir):
    return diff.relaxed_nullability(*slices.part_snapshots(spark, sf_dir)).select("subject_urn", "subject_column")


# -- governance ---------------------------------------------------------------

_GOVERNED = """
WITH g AS (SELECT source || '_' || lang AS name, count(*) AS n, sum(n_chars) AS c FROM documents GROUP BY ALL),
u AS (SELECT *, 'urn:li:dataset:(urn:li:dataPlatform:spark,docs.' || name || ',PROD)' AS urn FROM g),
tagged AS (
  SELECT urn, CAST(NULL AS VARCHAR) AS path, unnest(CASE WHEN c % 3 = 0 THEN ['urn:li:tag:PII', 'urn:li:tag:blue'] WHEN c % 3 = 1 THEN ['urn:li:glossaryTerm:Class.Restricted'] ELSE [] END) AS tag,
    CASE WHEN n % 2 = 0 THEN 'pii' END AS had FROM u
  UNION ALL SELECT urn, 'text', 'GDPR', NULL FROM u WHERE c % 2 = 0
), sensitive AS (
  SELECT *, lower(regexp_replace(tag, '^.*[.:]', '')) AS own FROM tagged
)
"""


@query(_GOVERNED + "SELECT urn AS subject_urn, CASE WHEN n % 2 = 1 THEN 'use the new one' END AS note, 'Dataset docs.' || name || ' is deprecated now' || CASE WHEN n % 2 = 1 THEN ' — use the new one' ELSE '' END AS summary FROM u WHERE n % 3 = 0 AND n % 5 <> 0")
def asset_deprecated(spark, sf_dir):
    return diff.newly_deprecated(*slices.document_snapshots(spark, sf_dir)).select("subject_urn", F.col("evidence")["note"].alias("note"), "summary")


@query(_GOVERNED + "SELECT urn AS subject_urn, 'urn:li:corpuser:' || name AS previous_owners FROM u WHERE c % 4 <> 0 AND c % 2 = 0")
def ownership_lost(spark, sf_dir):
    return diff.lost_owners(*slices.document_snapshots(spark, sf_dir)).select("subject_urn", F.col("evidence")["previous_owners"].alias("previous_owners"))


@query(_GOVERNED + "SELECT urn AS subject_urn, path AS subject_column, tag AS tag_urn FROM sensitive WHERE own IN ('pii', 'restricted', 'gdpr') AND own IS DISTINCT FROM had")
def new_sensitive_tag(spark, sf_dir):
    return diff.new_sensitive_tags(*slices.document_snapshots(spark, sf_dir)).select("subject_urn", "subject_column", F.col("evidence")["tag_urn"].alias("tag_urn"))


_ALL = (
    _STATS.rstrip()
    + ", "
    + _PARTS.strip().removeprefix("WITH ").replace("grouped", "pgrouped")
    + _CHANGED
    + ", "
    + _GOVERNED.strip().removeprefix("WITH ")
    + """, everything AS (
  SELECT kind, subject_urn, subject_column FROM found
  UNION ALL SELECT 'COLUMN_DROPPED', urn, path FROM old o WHERE urn IN (SELECT urn FROM new) AND NOT EXISTS (SELECT 1 FROM new n WHERE n.urn = o.urn AND n.path = o.path)
  UNION ALL SELECT 'COLUMN_ADDED', urn, path FROM new o WHERE urn IN (SELECT urn FROM old) AND NOT EXISTS (SELECT 1 FROM old n WHERE n.urn = o.urn AND n.path = o.path)
  UNION ALL SELECT 'COLUMN_TYPE_CHANGED', urn, path FROM changed
  UNION ALL SELECT 'COLUMN_NULLABILITY_RELAXED', urn, path FROM p WHERE nnull AND NOT onull
  UNION ALL SELECT 'ASSET_DEPRECATED', urn, NULL FROM u WHERE n % 3 = 0 AND n % 5 <> 0
  UNION ALL SELECT 'OWNERSHIP_LOST', urn, NULL FROM u WHERE c % 4 <> 0 AND c % 2 = 0
  UNION ALL SELECT 'NEW_SENSITIVE_TAG', urn, path FROM sensitive WHERE own IN ('pii', 'restricted', 'gdpr') AND own IS DISTINCT FROM had)
"""
)


def _findings(spark, sf_dir) -> DataFrame:
    """All differs over the three slices, prices, parts and documents, as one inventory."""
    slices_of = (slices.order_snapshots, slices.part_snapshots, slices.document_snapshots)
    sides = zip(*(s(spark, sf_dir) for s in slices_of))
    return diff.diff_all(*(Snapshot(*(reduce(DataFrame.unionByName, (getattr(x, t) for x in side)) for t in ("assets", "columns", "profiles", "col_features"))) for side in sides))


@query(_ALL + "SELECT kind, subject_urn, subject_column FROM everything")
def diff_all(spark, sf_dir):
    return _findings(spark, sf_dir).select("kind", "subject_urn", "subject_column")


def _shown(x: str) -> str:
    """Six significant digits, rounded half up."""
    return f"printf('%g', CASE WHEN {x} = 0 THEN 0 ELSE round({x}, CAST(5 - floor(log10(abs({x}))) AS INT)) END)"


_SUMMARIES = _ALL + f""", told AS (
  SELECT 'NULL_RATE_JUMP' AS kind, urn, path, printf('Null rate on `%s` rose %.1f%% → %.1f%% (%+.1fpp) in ', path, onull / on_ * 100, nnull / nn * 100, v) AS head, '' AS tail FROM null_jumps
  UNION ALL SELECT 'CARDINALITY_CHANGE', urn, path, 'Cardinality of `' || path || '` ' || CASE WHEN v < 0 THEN 'collapsed ' ELSE 'exploded ' END || format('{{:,}} → {{:,}}', ou, nu) || printf(' (%+.0f%%) in ', v), '' FROM cardinality
  UNION ALL SELECT 'MEAN_SHIFT', urn, path, 'Mean of `' || path || '` moved ' || {_shown('om')} || ' → ' || {_shown('nm')} || ' (' || coalesce(printf('%+.1fσ', v), 'the baseline was constant') || ') in ', '' FROM shifts
  UNION ALL SELECT 'RANGE_VIOLATION', urn, path, 'Values of `' || path || '` in ', ' are outside the baseline: ' || concat_ws(', ', CASE WHEN low IS NOT NULL THEN 'min ' || {_shown('olo')} || ' → ' || {_shown('nlo')} END,
    CASE WHEN high IS NOT NULL THEN 'max ' || {_shown('ohi')} || ' → ' || {_shown('nhi')} END) FROM ranges
  UNION ALL SELECT 'ROW_COUNT_CHANGE', urn, NULL, 'Row count of ', CASE WHEN v < 0 THEN ' dropped ' ELSE ' grew ' END || format('{{:,}} → {{:,}}', on_, nn) || printf(' (%+.0f%%)', v) FROM volumes
  UNION ALL SELECT kind, subject_urn, subject_column, 'Column `' || subject_column || '` was ' || CASE kind WHEN 'COLUMN_ADDED' THEN 'added to ' ELSE 'dropped from ' END, '' FROM everything WHERE kind IN ('COLUMN_ADDED', 'COLUMN_DROPPED')
  UNION ALL SELECT kind, subject_urn, subject_column, 'Column `' || subject_column || '` on ', ' may hold nulls now' FROM everything WHERE kind = 'COLUMN_NULLABILITY_RELAXED'
  UNION ALL SELECT 'COLUMN_TYPE_CHANGED', urn, path, 'Column `' || path || '` on ', ' changed type ' || old_native_type || ' → ' || new_native_type || '; not all old values fit' FROM changed
  UNION ALL SELECT 'ASSET_DEPRECATED', urn, NULL, 'Dataset ', ' is deprecated now' || CASE WHEN n % 2 = 1 THEN ' — use the new one' ELSE '' END FROM u WHERE n % 3 = 0 AND n % 5 <> 0
  UNION ALL SELECT 'OWNERSHIP_LOST', urn, NULL, 'Dataset ', ' has no owner any more' FROM u WHERE c % 4 <> 0 AND c % 2 = 0
  UNION ALL SELECT 'NEW_SENSITIVE_TAG', urn, path, 'Sensitive tag ' || regexp_replace(tag, '^urn:li:[A-Za-z]+:', '') || ' is new on ' || CASE WHEN path IS NULL THEN '' ELSE '`' || path || '` on ' END, ''
    FROM sensitive WHERE own IN ('pii', 'restricted', 'gdpr') AND own IS DISTINCT FROM had
), named AS (SELECT *, regexp_extract(urn, 'spark,(.*),PROD', 1) AS name,
    CASE WHEN kind LIKE 'COLUMN%' THEN regexp_extract(urn, '#([0-9]+)', 1) END AS brand FROM told)
SELECT kind, urn AS subject_urn, path AS subject_column, 'urn:li:mlFeature:(parts,' || brand || ')' AS affected_feature_urn,
  head || name || tail || CASE WHEN kind <> 'COLUMN_ADDED' AND brand IS NOT NULL THEN ', which feeds ' || brand ELSE '' END AS summary FROM named
"""


@query(_SUMMARIES)
def summaries(spark, sf_dir):
    """What findings of all twelve kinds say, and the feature that stands for those they feed."""
    return _findings(spark, sf_dir).select("kind", "subject_urn", "subject_column", "affected_feature_urn", "summary")


# -- ruling -------------------------------------------------------------------

_PAST, _FUTURE = datetime(2026, 1, 1, tzinfo=UTC), datetime(2027, 1, 1, tzinfo=UTC)
POLICY = Policy(
    rules={"RANGE_VIOLATION": "BLOCK", "COLUMN_TYPE_CHANGED": "WARN", "COLUMN_ADDED": "WARN", "MEAN_SHIFT": "CLEAR"},
    exemptions=(
        Exemption("long over", _PAST, "CLEAR"),
        Exemption("known brand", _FUTURE, "CLEAR", kind="COLUMN_DROPPED", urn_pattern="*parts.Brand#1[12]*"),
        Exemption("accepted buckets", _FUTURE, "WARN", column="bucket"),
        Exemption("second to match", _FUTURE, "CLEAR", column="bucket"),
        Exemption("raised", _FUTURE, "WARN", kind="MEAN_SHIFT", urn_pattern="*orders.?????,PROD)"),
    ),
)


def _ruled_sql(allow: bool = False) -> str:
    probable = "kind IN ('NULL_RATE_JUMP', 'CARDINALITY_CHANGE', 'MEAN_SHIFT', 'RANGE_VIOLATION', 'ROW_COUNT_CHANGE')"
    return f""", base AS (
  SELECT *, CASE WHEN {probable} THEN 'PROBABLE' ELSE 'CERTAIN' END AS confidence,
    CASE kind WHEN 'RANGE_VIOLATION' THEN '{'BLOCK' if allow else 'WARN'}' WHEN 'COLUMN_TYPE_CHANGED' THEN 'WARN' WHEN 'COLUMN_ADDED' THEN 'WARN' WHEN 'MEAN_SHIFT' THEN 'CLEAR'
      WHEN 'COLUMN_DROPPED' THEN 'BLOCK' WHEN 'ASSET_DEPRECATED' THEN 'BLOCK' ELSE 'WARN' END AS own,
    CASE WHEN kind = 'COLUMN_DROPPED' AND subject_urn GLOB '*parts.Brand#1[12]*' THEN 'known brand' WHEN subject_column = 'bucket' THEN 'accepted buckets'
      WHEN kind = 'MEAN_SHIFT' AND subject_urn GLOB '*orders.?????,PROD)' THEN 'raised' END AS exempted_by FROM %s
), ruled AS (SELECT *, CASE exempted_by WHEN 'known brand' THEN 'CLEAR' WHEN 'accepted buckets' THEN 'WARN' WHEN 'raised' THEN 'WARN' ELSE own END AS severity,
    replace(lower(kind), '_', '-') AS rule_id FROM base)
"""


@query(_ALL + _ruled_sql() % "everything" + "SELECT kind, subject_urn, subject_column, severity, rule_id, confidence, exempted_by FROM ruled")
def rule_severity(spark, sf_dir):
    ruled = verdict.rule(_findings(spark, sf_dir), POLICY, slices.NOW)
    return ruled.select("kind", "subject_urn", "subject_column", "severity", "rule_id", "confidence", "exempted_by")


@query(_STATS + _ruled_sql(True) % "found" + "SELECT kind, subject_urn, severity FROM ruled WHERE severity = 'BLOCK'")
def probable_block(spark, sf_dir):
    allowing = Policy(rules=POLICY.rules, exemptions=POLICY.exemptions, allow_probable_block=True)
    baseline, current = slices.order_snapshots(spark, sf_dir)
    ruled = verdict.rule(diff.diff_statistics(baseline, current), allowing, slices.NOW)
    return ruled.filter("severity = 'BLOCK'").select("kind", "subject_urn", "severity")


@query(_ALL + _ruled_sql() % "everything" + "SELECT exempted_by, severity, count(*) AS n FROM ruled WHERE exempted_by IS NOT NULL GROUP BY ALL")
def exemptions(spark, sf_dir):
    ruled = verdict.rule(_findings(spark, sf_dir), POLICY, slices.NOW).filter("exempted_by is not null")
    return ruled.groupBy("exempted_by", "severity").agg(F.count(F.lit(1)).alias("n"))


#: Three thousand accepted risks, of brands by name, of name endings and of numbered columns.
MANY = tuple(
    Exemption(f"risk {i}", _FUTURE, "WARN" if i % 3 else "CLEAR", kind="COLUMN_ADDED", urn_pattern=f"urn:li:dataset:(urn:li:dataPlatform:spark,parts.Brand#{i}*")
    if i % 2
    else Exemption(f"risk {i}", _FUTURE, "WARN" if i % 3 else "CLEAR", urn_pattern=f"*Brand#[1-3]{i // 2 % 1000},PROD)" if i % 4 else None, column=f"c_{i}" if i % 4 == 0 else None)
    for i in range(3000)
)


@query(
    _ALL
    + """, risks AS (
  SELECT i, CASE WHEN i % 2 = 1 THEN 'COLUMN_ADDED' END AS k, CASE WHEN i % 3 = 0 THEN 'CLEAR' ELSE 'WARN' END AS severity,
    CASE WHEN i % 2 = 1 THEN 'urn:li:dataset:(urn:li:dataPlatform:spark,parts.Brand#' || i || '*' WHEN i % 4 <> 0 THEN '*Brand#[1-3]' || (i // 2 % 1000) || ',PROD)' END AS pattern,
    CASE WHEN i % 4 = 0 THEN 'c_' || i END AS col FROM (SELECT unnest(range(3000)) AS i)
), met AS (
  SELECT kind, subject_urn, subject_column, min(i) AS i FROM everything JOIN risks
    ON (k IS NULL OR k = kind) AND (pattern IS NULL OR subject_urn GLOB pattern) AND (col IS NULL OR col = subject_column) GROUP BY ALL
)
SELECT kind, subject_urn, subject_column, 'risk ' || i AS exempted_by, CASE WHEN i % 3 = 0 THEN 'CLEAR' ELSE 'WARN' END AS severity FROM met"""
)
def exemptions_indexed(spark, sf_dir):
    ruled = verdict.rule(_findings(spark, sf_dir), Policy(exemptions=MANY), slices.NOW).filter("exempted_by is not null")
    return ruled.select("kind", "subject_urn", "subject_column", "exempted_by", "severity")


@query(
    _ALL + _ruled_sql() % "everything" + """SELECT kind, subject_urn, subject_column, severity, row_number() OVER (ORDER BY CASE severity WHEN 'BLOCK' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END,
      CASE confidence WHEN 'CERTAIN' THEN 0 ELSE 1 END, kind, subject_urn, coalesce(subject_column, '')) AS place FROM ruled"""
)
def ordered_findings(spark, sf_dir):
    ruled = verdict.rule(_findings(spark, sf_dir), POLICY, slices.NOW)
    return verdict.listed(ruled).select("kind", "subject_urn", "subject_column", "severity", F.col("place").cast("bigint").alias("place"))


# -- verdicts over models -----------------------------------------------------

_REGIONS = (
    _STATS.rstrip()
    + """, regional AS (
  SELECT 'urn:li:mlModel:(urn:li:dataPlatform:spark,region_' || CAST(r AS VARCHAR) || ',PROD)' AS model_urn, found.*
  FROM found, (SELECT unnest([0, 1]) AS d) shift, LATERAL (SELECT (found.n_regionkey + d) % 5 AS r) x
), inventory AS (SELECT 'urn:li:mlModel:(urn:li:dataPlatform:spark,region_' || CAST(r_regionkey AS VARCHAR) || ',PROD)' AS model_urn FROM region
  UNION ALL SELECT 'urn:li:mlModel:(urn:li:dataPlatform:spark,quiet,PROD)')
"""
)


def _regional(spark, sf_dir, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ruled findings of the regions' models, attributed over direct edges; the models; the footprint."""
    baseline, current = slices.order_snapshots(spark, sf_dir, per_region=True)
    direct = current.assets.select(F.col("model_urn").alias("src"), F.col("urn").alias("dst"), F.lit("Consumes").alias("relationship"), F.crc32("urn").alias("seq"))
    models = slices.region_models(spark, sf_dir)
    found = graph.footprint(models, direct, 2)
    attributed = graph.attribute(diff.diff_statistics(baseline, current), found, current.assets, queries)
    quiet = spark.createDataFrame([(slices.MODEL.replace("orders_model", "quiet"),)], "model_urn string")
    return verdict.listed(verdict.rule(attributed, POLICY, slices.NOW)), models.unionByName(quiet), found


_COUNTED = """, counted AS (
  SELECT i.model_urn, coalesce(max(CASE severity WHEN 'BLOCK' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END), 0) AS worst, count(*) FILTER (WHERE severity = 'BLOCK') AS blocking,
    count(*) FILTER (WHERE severity = 'WARN') AS warning, count(kind) AS findings,
    coalesce(string_agg(DISTINCT CASE WHEN severity = 'WARN' THEN kind END, ',' ORDER BY CASE WHEN severity = 'WARN' THEN kind END), '') AS warning_kinds
  FROM inventory i LEFT JOIN ruled r ON i.model_urn = r.model_urn GROUP BY i.model_urn)
"""


@query(_REGIONS + _ruled_sql() % "regional" + _COUNTED + "SELECT model_urn, ['CLEAR', 'WARN', 'BLOCK'][worst + 1] AS severity, blocking, warning, findings, warning_kinds FROM counted")
def verdict_by_model(spark, sf_dir):
    ruled, models, _ = _regional(spark, sf_dir)
    return verdict.verdicts(models, ruled).select("model_urn", "severity", "blocking", "warning", "findings", "warning_kinds")


@query(_REGIONS + _ruled_sql() % "regional" + _COUNTED + "SELECT model_urn, CASE WHEN worst = 2 THEN 1 WHEN worst = 1 THEN 1 ELSE 0 END AS exit_code FROM counted")
def verdict_exit(spark, sf_dir):
    ruled, models, _ = _regional(spark, sf_dir)
    return verdict.verdicts(models, ruled, fail_on_warn=True).select("model_urn", "exit_code")


@query(_REGIONS + _ruled_sql() % "regional" + _COUNTED + "SELECT max(CASE WHEN worst = 2 THEN 1 ELSE 0 END) AS exit_code FROM counted")
def sweep_exit(spark, sf_dir):
    ruled, models, _ = _regional(spark, sf_dir)
    return verdict.sweep_exit(verdict.verdicts(models, ruled))


@query(
    _REGIONS + _ruled_sql() % "regional" + """, by_model AS (SELECT subject_urn, model_urn, max(CASE severity WHEN 'BLOCK' THEN 2 ELSE 1 END) AS worst, max(k) AS k FROM ruled WHERE severity <> 'CLEAR' GROUP BY ALL)
    SELECT subject_urn AS root_urn, count(*) AS model_count, ['CLEAR', 'WARN', 'BLOCK'][max(worst) + 1] AS worst_severity, 'urn:li:corpuser:u' || CAST(max(k) % 4 AS VARCHAR) AS owners,
      string_agg(model_urn, ' ' ORDER BY model_urn) AS models FROM by_model GROUP BY subject_urn HAVING count(*) > 1"""
)
def incidents(spark, sf_dir):
    ruled, _, _ = _regional(spark, sf_dir)
    models = F.array_join(F.transform("affected", lambda a: a["model_urn"]), " ")
    return verdict.incidents(ruled).select("root_urn", "model_count", "worst_severity", F.array_join("owners", ",").alias("owners"), models.alias("models"))


@query(
    _REGIONS + """SELECT model_urn, kind, subject_urn, subject_column, false AS unattributed, subject_urn AS root_urn, 1 AS path_depth,
      subject_urn || coalesce('.' || subject_column, '') || ' > ' || model_urn AS path, 'urn:li:corpuser:u' || CAST(k % 4 AS VARCHAR) AS owners FROM regional"""
)
def attribution(spark, sf_dir):
    ruled, _, _ = _regional(spark, sf_dir)
    path = F.array_join(F.transform("hops", lambda h: F.concat_ws(".", h["urn"], h["column"])), " > ")
    return ruled.select("model_urn", "kind", "subject_urn", "subject_column", "unattributed", "root_urn", "path_depth", path.alias("path"), F.array_join("path_owners", ",").alias("owners"))


@query(_STATS + f"SELECT '{slices.MODEL}' AS model_urn, 'Warned of ' || (SELECT replace(lower(kind), '_', ' ') || ' on ' || coalesce(subject_column, subject_urn) FROM found ORDER BY kind, subject_urn, coalesce(subject_column, '') LIMIT 1) || ' and ' || CAST((SELECT count(*) - 1 FROM found) AS VARCHAR) || ' other warning(s).' AS explanation", name="verdict")
def price_verdict(spark, sf_dir):
    """The flagship: profile, diff, rule and verdict on the nations' order prices, in a sentence."""
    baseline, current = slices.order_snapshots(spark, sf_dir)
    ruled = verdict.rule(diff.diff_statistics(baseline, current), Policy(), slices.NOW)
    models = spark.createDataFrame([(slices.MODEL,)], "model_urn string")
    return verdict.explain(verdict.verdicts(models, ruled), ruled)


@query(
    _REGIONS + _ruled_sql() % "regional" + """, per AS (SELECT subject_urn AS root_urn, count(DISTINCT model_urn) AS model_count FROM ruled WHERE severity <> 'CLEAR' GROUP BY subject_urn HAVING count(DISTINCT model_urn) > 1)
    SELECT CAST(row_number() OVER (ORDER BY model_count DESC, root_urn) AS BIGINT) AS place, root_urn, model_count FROM per"""
)
def incident_order(spark, sf_dir):
    """Places of the incidents in a report."""
    ruled, _, _ = _regional(spark, sf_dir)
    return verdict.placed_incidents(verdict.incidents(ruled)).select("place", "root_urn", "model_count")


@query(
    _REGIONS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY model_urn ORDER BY subject_urn,
      CASE kind WHEN 'ROW_COUNT_CHANGE' THEN 0 WHEN 'NULL_RATE_JUMP' THEN 1 WHEN 'CARDINALITY_CHANGE' THEN 2 WHEN 'MEAN_SHIFT' THEN 3 ELSE 4 END,
      CASE subject_column WHEN 'bucket' THEN 1 ELSE 0 END) AS nth FROM regional)
    SELECT model_urn, nth, kind, subject_urn, subject_column FROM ranked WHERE nth <= 3"""
)
def first_findings(spark, sf_dir):
    """Each model's first three findings, for a closer look."""
    ruled, _, _ = _regional(spark, sf_dir)
    return verdict.first_findings(ruled).select("model_urn", F.col("nth").cast("bigint").alias("nth"), "kind", "subject_urn", "subject_column")


@query(
    _REGIONS + _ruled_sql() % "regional" + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY model_urn ORDER BY CASE severity WHEN 'BLOCK' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END,
      CASE confidence WHEN 'CERTAIN' THEN 0 ELSE 1 END, kind, subject_urn, coalesce(subject_column, '')) AS place FROM ruled)
    SELECT model_urn, subject_urn AS dataset FROM ranked WHERE place = 1"""
)
def root_dataset(spark, sf_dir):
    """The dataset that each model's first finding goes back to, as a write back names it."""
    from plumbline.sources import sinks

    return sinks.root_dataset(_regional(spark, sf_dir)[0])


@query(_REGIONS + "SELECT model_urn, kind, subject_urn, subject_column, CASE WHEN k % 2 = 0 THEN 'SELECT ' || k END AS query_sql FROM regional")
def query_evidence(spark, sf_dir):
    """The statement behind each finding's subject, where one is known."""
    nation = slices.table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    queries = nation.select(slices.dataset(F.concat(F.lit("orders."), "n_name")).alias("urn"), F.concat(F.lit("SELECT "), F.col("n_nationkey").cast("string")).alias("query_sql"))
    return _regional(spark, sf_dir, queries)[0].select("model_urn", "kind", "subject_urn", "subject_column", "query_sql")


# -- lineage ------------------------------------------------------------------

_EDGES = """
WITH RECURSIVE np AS (SELECT count(*) AS n FROM part), edges AS (
  SELECT 'M' || n_regionkey AS src, 'F' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'F' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem
  UNION ALL SELECT 'P' || k, 'P' || ((k * 7 + 3) % n) FROM (SELECT DISTINCT l_partkey AS k FROM lineitem), np WHERE k <> (k * 7 + 3) % n
), named AS (SELECT 'M' AS c, 'urn:li:mlModel:(urn:li:dataPlatform:spark,region_' AS a, ',PROD)' AS b UNION ALL SELECT 'F', 'urn:li:mlFeature:(store,', ')'
  UNION ALL SELECT 'S', 'urn:li:dataset:(urn:li:dataPlatform:spark,supplier.', ',PROD)' UNION ALL SELECT 'P', 'urn:li:dataset:(urn:li:dataPlatform:spark,part.', ',PROD)')
"""


def _walk_sql(cap: int) -> str:
    return f""", walk AS (SELECT 'M' || r_regionkey AS m, 'M' || r_regionkey AS x, 0 AS d FROM region
      UNION SELECT w.m, e.dst, w.d + 1 FROM walk w JOIN edges e ON e.src = w.x WHERE w.d < {cap}), reach AS (SELECT m, x, min(d) AS d FROM walk GROUP BY m, x)"""


_URN = "(SELECT a || substr({0}, 2) || b FROM named WHERE c = left({0}, 1))"


@query(_EDGES + _walk_sql(5) + f"SELECT {_URN.format('m')} AS model_urn, {_URN.format('x')} AS urn, d AS depth FROM reach")
def upstream_footprint(spark, sf_dir):
    return graph.footprint(slices.region_models(spark, sf_dir), slices.edges(spark, sf_dir), 5, paths=False).select("model_urn", "urn", "depth")


@query(
    _EDGES + _walk_sql(2) + f"""SELECT DISTINCT {_URN.format('m')} AS model_urn, {_URN.format('x')} AS urn FROM reach r JOIN edges e ON e.src = r.x
      WHERE d = 2 AND NOT EXISTS (SELECT 1 FROM reach v WHERE v.m = r.m AND v.x = e.dst)"""
)
def footprint_truncated(spark, sf_dir):
    found = graph.footprint(slices.region_models(spark, sf_dir), slices.edges(spark, sf_dir), 2)
    return found.filter("truncated").select("model_urn", "urn")


@query(
    """SELECT 'urn:li:mlModel:(urn:li:dataPlatform:spark,region_' || n_regionkey || ',PROD)' AS model_urn, 'urn:li:dataset:(urn:li:dataPlatform:spark,supplier.' || s_suppkey || ',PROD)' AS urn,
      'supplier.' || s_suppkey || ' [] > ' || n_nationkey || ' [DerivedFrom] > region_' || n_regionkey || ' [Consumes]' AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def footprint_paths(spark, sf_dir):
    found = graph.hops(graph.footprint(slices.region_models(spark, sf_dir), slices.tree_edges(spark, sf_dir), 5)).filter("depth = 2")
    hop = F.transform("hops", lambda h: F.concat(X.report_name(h["urn"]), F.lit(" ["), F.coalesce(h["via"], F.lit("")), F.lit("]")))
    return found.select("model_urn", "urn", F.array_join(hop, " > ").alias("path"))


@query(
    """SELECT 'urn:li:mlModel:(urn:li:dataPlatform:spark,region_' || n_regionkey || ',PROD)' AS model_urn, 'urn:li:dataset:(urn:li:dataPlatform:spark,supplier.' || s_suppkey || ',PROD)' AS urn,
      'urn:li:mlFeature:(store,' || n_nationkey || ')' AS features FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def feature_sources(spark, sf_dir):
    edges = slices.edges(spark, sf_dir)
    found = graph.footprint(slices.region_models(spark, sf_dir), edges, 5, paths=False)
    return graph.feature_sources(found, edges, 5).select("model_urn", "urn", F.array_join("feeds_features", ",").alias("features"))


@query(
    _EDGES + _walk_sql(5) + """, ce AS (
      SELECT DISTINCT 'S' || l_suppkey AS dn, 'c' || (l_linenumber % 3) AS dc, 'P' || l_partkey AS un, 'p' || (l_linenumber % 2) AS uc FROM lineitem
      UNION SELECT DISTINCT 'P' || l_partkey, 'p0', 'P' || ((l_partkey * 7 + 3) % n), 'p1' FROM lineitem, np
    ), seeds AS (SELECT 'M' || n_regionkey AS m, 'S' || s_suppkey AS x, 'c' || i AS c, 'F' || n_nationkey AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest([0, 1, 2]) AS i) t
    ), first AS (SELECT DISTINCT s.m, ce.un AS x, ce.uc AS c, s.f FROM seeds s JOIN ce ON ce.dn = s.x AND ce.dc = s.c WHERE EXISTS (SELECT 1 FROM reach r WHERE r.m = s.m AND r.x = ce.un)
    ), col AS (SELECT m, x, c, f FROM first UNION SELECT w.m, ce.un, ce.uc, w.f FROM col w JOIN ce ON ce.dn = w.x AND ce.dc = w.c JOIN reach r ON r.m = w.m AND r.x = ce.un)
    """ + f", full_names AS (SELECT DISTINCT {_URN.format('m')} AS model_urn, {_URN.format('x')} AS urn, c AS path, {_URN.format('f')} AS f FROM col)"
    " SELECT model_urn, urn, path, string_agg(f, ' ' ORDER BY f) AS features FROM full_names GROUP BY model_urn, urn, path"
)
def column_features(spark, sf_dir):
    edges = slices.edges(spark, sf_dir)
    found = graph.footprint(slices.region_models(spark, sf_dir), edges, 5, paths=False)
    sources = graph.feature_sources(found, edges, 5)
    reached = graph.column_features(found, sources, slices.supplier_columns(found), slices.column_edges(spark, sf_dir))
    return reached.select("model_urn", "urn", "path", F.array_join("features", " ").alias("features"))


@query(
    _EDGES + _walk_sql(5) + """, met AS (SELECT r.d + 1 = t.d AS fresh FROM reach r JOIN edges e ON e.src = r.x JOIN reach t ON t.m = r.m AND t.x = e.dst WHERE r.d < 5)
    SELECT 5 AS levels, count(*) AS fetched, count(*) FILTER (WHERE NOT fresh) AS met_before FROM met"""
)
def walk_counters(spark, sf_dir):
    """What the upstream walk of all models fetched, and had met before."""
    counters = graph.Counters()
    graph.footprint(slices.region_models(spark, sf_dir), slices.edges(spark, sf_dir), 5, counters, paths=False)
    return spark.createDataFrame([counters.totals()], "levels int, fetched long, met_before long")


_DOWN = (
    _EDGES
    + """, seeds AS (SELECT DISTINCT 'P' || l_partkey AS s FROM lineitem), walk AS (SELECT s, s AS x, 0 AS d FROM seeds
      UNION SELECT w.s, e.src, w.d + 1 FROM walk w JOIN edges e ON e.dst = w.x WHERE w.d < 6 AND left(w.x, 1) <> 'M')
"""
)


def _part_seeds(spark, sf_dir) -> DataFrame:
    lines = slices.table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return lines.select(slices.dataset(F.concat(F.lit("part."), F.col("l_partkey").cast("string"))).alias("seed"))


@query(_DOWN + f"SELECT {_URN.format('s')} AS seed, {_URN.format('x')} AS model_urn, min(d) AS depth FROM walk WHERE left(x, 1) = 'M' GROUP BY s, x")
def downstream_models(spark, sf_dir):
    return graph.downstream_models(_part_seeds(spark, sf_dir), slices.edges(spark, sf_dir), 6, paths=False).select("seed", "model_urn", "depth")


@query(_EDGES + f"""SELECT {_URN.format("'S1'")} AS seed, 'price' AS column_name, {_URN.format("'M' || n_regionkey")} AS model_urn, n_nationkey || ' → region_' || n_regionkey AS route FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1""")
def what_if(spark, sf_dir):
    owners = slices.region_models(spark, sf_dir).select(F.col("model_urn").alias("urn"), F.array().cast("array<string>").alias("owners"))
    seed = "urn:li:dataset:(urn:li:dataPlatform:spark,supplier.1,PROD)"
    found = impact.what_if(spark, seed, "price", slices.edges(spark, sf_dir), owners)
    return found.select("seed", F.col("column").alias("column_name"), "model_urn", "route")


# -- history ------------------------------------------------------------------

_RUNS = """
WITH raw AS (
  SELECT 'm' || (user_id % 20) AS model_urn, event_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE WHEN event_id % 7 = 0 THEN 'BLOCK' WHEN event_id % 3 = 0 THEN 'WARN' ELSE 'CLEAR' END AS severity FROM events WHERE event_id % 11 <> 0
), runs AS (
  SELECT *, CASE WHEN k % 5 = 0 THEN 0 ELSE k END AS blocking, k % 4 AS warning,
    CASE WHEN severity = 'WARN' THEN CASE WHEN k % 2 = 0 THEN [upper(event_type), 'MEAN_SHIFT'] ELSE [upper(event_type)] END ELSE [] END AS kinds FROM raw
)
"""


@query(_RUNS + "SELECT model_urn, CAST(event_id AS VARCHAR) AS run_id, severity, blocking, warning, array_to_string(kinds, ',') AS kinds, severity <> 'BLOCK' AS passed, CASE WHEN severity = 'BLOCK' THEN 1 ELSE 0 END AS exit_code FROM runs QUALIFY row_number() OVER (PARTITION BY model_urn ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) <= 20")
def history_runs(spark, sf_dir):
    runs = verdict.recent(verdict.runs_of(slices.recorded_runs(spark, sf_dir)), 20)
    return runs.select("model_urn", "run_id", "severity", "blocking", "warning", F.array_join("warning_kinds", ",").alias("kinds"), "passed", "exit_code")


@query(
    _RUNS + """, s AS (SELECT model_urn, count(*) AS runs, count(*) FILTER (WHERE severity = 'BLOCK') AS blocked, CAST(floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400) AS BIGINT) AS days FROM runs GROUP BY model_urn)
    SELECT model_urn, runs, blocked, days, runs || ' run(s)' || CASE WHEN runs < 2 THEN '' WHEN days > 0 THEN ' over ' || days || ' day(s)' ELSE ' today' END || ', ' || blocked || ' blocked.' AS summary FROM s"""
)
def history_summary(spark, sf_dir):
    return verdict.history_summary(verdict.runs_of(slices.recorded_runs(spark, sf_dir)))


@query(
    """WITH runs AS (SELECT user_id % 20 AS u, CAST(ts AS DATE) AS day, list_distinct(list(event_type)) AS kinds FROM events GROUP BY ALL),
    t AS (SELECT u, count(*) AS total_runs FROM runs GROUP BY u), w AS (SELECT u, kind, count(*) AS warn_count FROM (SELECT u, unnest(kinds) AS kind FROM runs) GROUP BY ALL)
    SELECT 'm' || u AS model_urn, kind, warn_count, total_runs, round(warn_count / total_runs, 6) AS rate FROM w JOIN t USING (u) WHERE total_runs >= 4 AND warn_count / total_runs >= 0.5"""
)
def calibration(spark, sf_dir):
    events = slices.table(spark, sf_dir, "events")
    name = F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("model_urn")
    runs = events.groupBy(name, F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("warning_kinds"))
    return verdict.calibrate(runs).withColumn("rate", F.round("rate", 6))


# -- expressions and impact ----------------------------------------------------


@query("""SELECT c_custkey, 'urn:li:assertion:' || md5('{"model_urn":"' || c_name || '","scope":"gate"}') AS assertion FROM customer""")
def assertion_urn(spark, sf_dir):
    return slices.table(spark, sf_dir, "customer").select("c_custkey", X.assertion_id(F.col("c_name"), "gate").alias("assertion"))


_NAMES = """
WITH u AS (
  SELECT 'urn:li:dataset:(urn:li:dataPlatform:spark,' || p_brand || '.' || p_partkey || ',PROD)' AS urn, 'dataset' AS kind, p_brand || '.' || p_partkey AS name, NULL AS ds, NULL AS col FROM part
  UNION ALL SELECT 'urn:li:mlFeature:(store,' || p_partkey || ')', 'mlFeature', CAST(p_partkey AS VARCHAR), NULL, NULL FROM part
  UNION ALL SELECT 'urn:li:corpuser:u' || p_partkey, 'corpuser', 'u' || p_partkey, NULL, NULL FROM part
  UNION ALL SELECT 'urn:li:schemaField:(urn:li:dataset:(urn:li:dataPlatform:spark,t' || p_partkey || ',PROD),c' || p_size || ')', 'schemaField', 'c' || p_size,
    'urn:li:dataset:(urn:li:dataPlatform:spark,t' || p_partkey || ',PROD)', 'c' || p_size FROM part
  UNION ALL SELECT p_brand || p_partkey, 'unknown', p_brand || p_partkey, NULL, NULL FROM part)
"""


@query(_NAMES + "SELECT urn, kind, name, ds AS dataset, col AS column_name FROM u")
def urn_parse(spark, sf_dir):
    part = slices.table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("string"))
    forms = F.array(
        F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:spark,"), "p_brand", F.lit("."), "k", F.lit(",PROD)")),
        F.concat(F.lit("urn:li:mlFeature:(store,"), "k", F.lit(")")),
        F.concat(F.lit("urn:li:corpuser:u"), "k"),
        F.concat(F.lit("urn:li:schemaField:(urn:li:dataset:(urn:li:dataPlatform:spark,t"), "k", F.lit(",PROD),c"), F.col("p_size").cast("string"), F.lit(")")),
        F.concat("p_brand", "k"),
    )
    # Names take long beside the few bytes of a row that they are read from, so the rows are dealt out first.
    urns = part.repartition(4 * spark.sparkContext.defaultParallelism).select(F.explode(forms).alias("urn"))
    u = F.col("urn")
    return urns.select("urn", X.entity_type(u).alias("kind"), X.report_name(u).alias("name"), X.field_dataset(u).alias("dataset"), X.field_column(u).alias("column_name"))


@query(_PARTS + """, b AS (SELECT DISTINCT urn FROM new) SELECT b.urn AS table_urn,
  coalesce((SELECT string_agg(path, '|' ORDER BY path) FROM old o WHERE o.urn = b.urn AND path NOT IN (SELECT path FROM new n WHERE n.urn = b.urn)), '') AS dropped,
  coalesce((SELECT string_agg(path, '|' ORDER BY path) FROM new o WHERE o.urn = b.urn AND path NOT IN (SELECT path FROM old n WHERE n.urn = b.urn)), '') AS added FROM b""")
def schema_impact(spark, sf_dir):
    old, new = (s.columns.withColumnRenamed("urn", "table_urn") for s in slices.part_snapshots(spark, sf_dir))
    found = impact.schema_impact(new, old)
    return found.select("table_urn", *(F.array_join(F.array_sort(c), "|").alias(c) for c in ("dropped", "added")))


@query(
    """WITH p AS (SELECT p_brand, p_type || '_' || p_size AS path, p_partkey % 2 AS side, min(p_partkey) AS ord FROM part GROUP BY ALL),
    b AS (SELECT DISTINCT p_brand FROM p WHERE side = 1), gone AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.p_brand = a.p_brand AND o.path = a.path AND o.side <> a.side))
    SELECT 'urn:li:dataset:(urn:li:dataPlatform:spark,parts.' || p_brand || ',PROD)' AS table_urn,
      coalesce((SELECT string_agg(path, '|' ORDER BY ord) FROM gone g WHERE g.p_brand = b.p_brand AND side = 0), '') AS dropped,
      coalesce((SELECT string_agg(path, '|' ORDER BY ord) FROM gone g WHERE g.p_brand = b.p_brand AND side = 1), '') AS added FROM b"""
)
def impact_order(spark, sf_dir):
    """Columns that go, in the catalog's order, and come, in the proposal's."""
    old, new = (s.columns.withColumnRenamed("urn", "table_urn") for s in slices.part_snapshots(spark, sf_dir))
    return impact.schema_impact(new, old).select("table_urn", *(F.array_join(c, "|").alias(c) for c in ("dropped", "added")))


@query(
    """SELECT 'urn:li:dataset:(urn:li:dataPlatform:spark,supplier.' || s_suppkey || ',PROD)' AS seed, 'urn:li:mlModel:(urn:li:dataPlatform:spark,region_' || n_regionkey || ',PROD)' AS model_urn,
      2 AS depth, n_nationkey || ' → region_' || n_regionkey AS route, CASE WHEN n_regionkey % 2 = 0 THEN 'urn:li:corpuser:r' || n_regionkey ELSE '' END AS owners FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def impacted_models(spark, sf_dir):
    """Models that a change of each supplier's table would reach, with owners and route."""
    seeds = slices.table(spark, sf_dir, "supplier").select(slices.dataset(F.concat(F.lit("supplier."), F.col("s_suppkey").cast("string"))).alias("seed"))
    owned = slices.table(spark, sf_dir, "region").filter("r_regionkey % 2 = 0").withColumn("key", F.col("r_regionkey").cast("string"))
    owners = owned.select(slices.model(F.concat(F.lit("region_"), "key")).alias("urn"), F.array(F.concat(F.lit("urn:li:corpuser:r"), "key")).alias("owners"))
    found = impact.impacted_models(seeds, slices.tree_edges(spark, sf_dir), owners)
    return found.select("seed", "model_urn", "depth", "route", F.array_join("owners", ",").alias("owners"))


@query(
    """SELECT * FROM (VALUES ('changed.sql', 'amount', 'extra', 1, true, NULL), ('same.sql', '', '', 0, false, NULL), ('new.sql', '', 'a', 0, false, NULL)) t(sql_file, dropped, added, models, breaking, parse_error)"""
)
def sql_impact(spark, sf_dir):
    """CREATE TABLE statements against a catalog table that a model consumes."""
    slices.table(spark, sf_dir, "orders").createOrReplaceTempView("plumbline_orders")
    urn, m = "urn:li:dataset:(urn:li:dataPlatform:spark,mart.orders,PROD)", slices.MODEL
    catalog = spark.createDataFrame([("mart.orders", urn, 0, "id"), ("mart.orders", urn, 1, "amount")], "table string, table_urn string, ord int, path string")
    edges = spark.createDataFrame([(m, urn, "Consumes", 0)], "src string, dst string, relationship string, seq int")
    owners = spark.createDataFrame([(m, ["urn:li:corpuser:a"])], "urn string, owners array<string>")
    statements = {
        "changed.sql": "CREATE OR REPLACE TABLE mart.orders USING parquet AS SELECT o_orderkey AS id, o_totalprice * 2 AS extra FROM plumbline_orders",
        "same.sql": "INSERT INTO mart.orders SELECT o_orderkey AS id, o_totalprice AS amount FROM plumbline_orders",
        "new.sql": "CREATE TABLE mart.other USING parquet AS SELECT o_orderkey AS a FROM plumbline_orders",
        "nothing.sql": "SELECT 1",
    }
    found = impact.sql_impact(spark, statements, catalog, edges, owners)
    count = F.coalesce(F.size("impacted"), F.lit(0))
    return found.select("sql_file", *(F.array_join(c, "|").alias(c) for c in ("dropped", "added")), F.greatest(count, F.lit(0)).alias("models"), "breaking", "parse_error")


_REGION_MODEL = "'urn:li:mlModel:(urn:li:dataPlatform:spark,region_' || region || ',PROD)'"
_FED = """
WITH n AS (SELECT count(*) AS n FROM part), users AS (
  SELECT l_partkey AS part, 'p' || (l_linenumber % 2) AS col, n_regionkey AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), chain AS (SELECT DISTINCT l_partkey AS down, (l_partkey * 7 + 3) % n AS up FROM lineitem, n), fed AS (
  SELECT DISTINCT part, col, region FROM users UNION SELECT up, 'p1', region FROM chain JOIN users ON part = down AND col = 'p0'
)
"""


@query(_FED + f"""SELECT 'urn:li:dataset:(urn:li:dataPlatform:spark,part.' || part || ',PROD)' AS table_urn, col AS path, {_REGION_MODEL} AS model_urn FROM fed""")
def column_impact(spark, sf_dir):
    """The models that each column of each part's table feeds, by column lineage."""
    return lineage.column_impact(slices.fed_columns(spark, sf_dir), slices.edges(spark, sf_dir), slices.column_edges(spark, sf_dir))


@query(
    _FED
    + f"""SELECT 'part_' || k || '.sql' AS sql_file, 'p1' AS dropped, 'lineitem.l_orderkey|lineitem.l_quantity|part.p_partkey|part.p_size' AS inputs,
      coalesce(string_agg({_REGION_MODEL}, '|' ORDER BY region), '') AS models, count(region) > 0 AS breaking
    FROM (SELECT unnest(range(1, 9)) AS k) s LEFT JOIN fed ON part = k AND col = 'p1' GROUP BY k"""
)
def sql_column_impact(spark, sf_dir):
    """Statements over part and lineitem that lose a column, and the models that just this column feeds."""
    for name in ("part", "lineitem"):
        slices.table(spark, sf_dir, name).createOrReplaceTempView(name)
    statements = {
        f"part_{k}.sql": f"""CREATE OR REPLACE TABLE part.{k} USING parquet AS WITH big AS (SELECT p_partkey AS id, p_size AS size FROM part)
          SELECT max(q) OVER (PARTITION BY size) AS p0 FROM (SELECT max(l_quantity) AS q, size FROM lineitem JOIN big ON l_partkey = id
          WHERE l_orderkey > 0 GROUP BY size, id) UNION ALL SELECT l_orderkey + (SELECT min(p_partkey) FROM part) FROM lineitem""".replace(f"part.{k} ", f"`part`.`{k}` ")
        for k in range(1, 9)
    }
    ways = slices.column_edges(spark, sf_dir)
    # Written before they are named, as a distinct() over names would be merged with the one below them and name a table for each of its columns.
    tables = cut(slices.fed_columns(spark, sf_dir).select("table_urn").distinct(), "tables").select(X.report_name(F.col("table_urn")).alias("table"), "table_urn")
    both = tables.withColumn("path", F.explode(F.array(F.lit("p0"), F.lit("p1")))).withColumn("ord", F.substring("path", 2, 1).cast("int"))
    owners = slices.region_models(spark, sf_dir).select(F.col("model_urn").alias("urn"), F.array().cast("array<string>").alias("owners"))
    found = impact.sql_impact(spark, statements, both.select("table", "table_urn", "ord", "path"), slices.edges(spark, sf_dir), owners, column_edges=ways)
    models = F.transform(F.coalesce("impacted", F.array().cast("array<struct<model_urn:string,owners:array<string>,route:string>>")), lambda m: m["model_urn"])
    return found.select("sql_file", F.array_join("dropped", "|").alias("dropped"), F.array_join("inputs", "|").alias("inputs"), F.array_join(models, "|").alias("models"), "breaking")


# -- streaming (an extension) -----------------------------------------------------

_WATCH = """
WITH base AS (SELECT event_type AS asset, count(*) / count(DISTINCT CAST(ts AS DATE)) AS base_rows, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_samp(value) AS sd
  FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY event_type),
w AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS asset, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL)
SELECT w.day, w.asset, 'ROW_COUNT_CHANGE' AS kind, round((n - base_rows) / base_rows * 100, 2) AS magnitude FROM w JOIN base USING (asset) WHERE abs((n - base_rows) / base_rows * 100) > 20
UNION ALL SELECT w.day, w.asset, 'RANGE_VIOLATION', round(greatest(base.lo - w.lo, w.hi - base.hi), 2) FROM w JOIN base USING (asset) WHERE greatest(base.lo - w.lo, w.hi - base.hi) > 0
"""


@query(_WATCH)
def stream_drift(spark, sf_dir):
    """The watch's windows and rules, over the events as a batch; tests run the stream itself."""
    events = slices.table(spark, sf_dir, "events")
    early = events.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    base = early.groupBy(F.col("event_type").alias("asset")).agg(
        (F.count(F.lit(1)) / F.count_distinct(F.to_date("ts"))).alias("base_rows"), F.min("value").alias("base_low"), F.max("value").alias("base_high"),
        F.avg("value").alias("base_mean"), F.stddev_samp("value").alias("base_stdev"), F.lit(0.0).alias("base_null_rate"),
    )
    found = watch.drift(watch.windowed_profile(events, "ts", "event_type", "value"), base, Thresholds(row_count_change_pct=20.0))
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "asset", "kind", F.round("magnitude", 2).alias("magnitude"))


@query("""
WITH w AS (SELECT event_type AS asset, CAST(ts AS DATE) AS d, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY ALL),
p AS (SELECT *, lag(n) OVER o AS bn, lag(lo) OVER o AS blo, lag(hi) OVER o AS bhi, lag(m) OVER o AS bm, lag(sd) OVER o AS bsd FROM w WINDOW o AS (PARTITION BY asset ORDER BY d)),
f AS (
  SELECT asset, d, CASE WHEN abs((n - bn) / bn * 100) > 20 THEN 1 ELSE 0 END AS volume, CASE WHEN greatest(blo - lo, hi - bhi) > 0 THEN 1 ELSE 0 END AS beyond,
    CASE WHEN bsd > 0 AND abs((m - bm) / bsd) > 0.25 THEN 1 ELSE 0 END AS shift FROM p)
SELECT asset AS model_urn, strftime(d, '%Y-%m-%d') AS day, CASE WHEN volume + beyond + shift > 0 THEN 'WARN' ELSE 'CLEAR' END AS severity,
  concat_ws(',', CASE WHEN shift = 1 THEN 'MEAN_SHIFT' END, CASE WHEN beyond = 1 THEN 'RANGE_VIOLATION' END, CASE WHEN volume = 1 THEN 'ROW_COUNT_CHANGE' END) AS warning_kinds,
  CAST(volume + beyond + shift AS BIGINT) AS warning
FROM f
""")
def watch_runs(spark, sf_dir):
    """A run for each day and event type, against the day before: the watch with state over the events as a batch; tests run the stream itself."""
    profiles = watch.windowed_profile(slices.table(spark, sf_dir, "events"), "ts", "event_type", "value")
    policy = Policy(thresholds=Thresholds(row_count_change_pct=20.0, mean_shift_sigma=0.25))
    paired = cut(latest.successive(profiles), "paired")
    runs = verdict.runs_of(latest.runs_of_windows(latest.ruled_runs(paired, "value", policy, slices.NOW)[1]))
    return runs.select("model_urn", F.date_format("checked_at", "yyyy-MM-dd").alias("day"), "severity", F.array_join("warning_kinds", ",").alias("warning_kinds"), "warning")


# -- the whole gate -----------------------------------------------------------------

_F, _C = "urn:li:mlModel:(urn:li:dataPlatform:sagemaker,fraud_detector_v3,PROD)", "urn:li:mlModel:(urn:li:dataPlatform:sagemaker,churn_predictor_v1,PROD)"


@query(
    f"""SELECT * FROM (VALUES
      ('none', '{_F}', 'CLEAR', 0, 0, 6, 3, 14, 3, 0), ('none', '{_C}', 'CLEAR', 0, 0, 4, 2, 9, 2, 0),
      ('drop', '{_F}', 'BLOCK', 1, 0, 6, 2, 13, 3, 1), ('drop', '{_C}', 'BLOCK', 1, 0, 4, 1, 8, 2, 1),
      ('drift', '{_F}', 'WARN', 0, 3, 6, 3, 14, 3, 0), ('drift', '{_C}', 'WARN', 0, 3, 4, 2, 9, 2, 0),
      ('governance', '{_F}', 'BLOCK', 1, 1, 6, 3, 14, 3, 1), ('governance', '{_C}', 'BLOCK', 1, 1, 4, 2, 9, 2, 1)
    ) t(mutation, model_urn, status, blocking, warning, assets_checked, columns_compared, columns_total, assets_profiled, exit_code)"""
)
def demo_gate(spark, sf_dir):
    """A recorded graph through the whole gate, under four changes."""
    from plumbline.plans import demo

    return demo.verdict_table(spark)


@query(_STATS + "SELECT 0 AS profiles, count(DISTINCT urn) AS assets FROM kept WHERE side = 'new'")
def baseline_emptied(spark, sf_dir):
    """A profiled baseline replaced by one without profiles: none of the old ones is read back."""
    from plumbline.functions.durable import made
    from plumbline.sources import sinks

    path = made(spark, "baseline")
    old, new = slices.order_snapshots(spark, sf_dir)
    sinks.write_baseline(old, path)
    sinks.write_baseline(Snapshot.of(new.assets, new.columns.limit(0), new.profiles.limit(0), new.col_features.limit(0)), path)
    read = sinks.read_baseline(spark, path)
    profiles = read.profiles.agg(F.count(F.lit(1)).cast("int").alias("profiles"))
    return profiles.crossJoin(read.assets.agg(F.count_distinct("urn").alias("assets")))


@query(_STATS + f"SELECT urn, '{slices.MODEL}' AS model_urn, path, round(CAST(mean AS DOUBLE), 2) AS mean, n AS row_count FROM kept WHERE side = 'old'")
def baseline_round_trip(spark, sf_dir):
    """An approved baseline written, written again for one model, and read back."""
    from plumbline.functions.durable import made
    from plumbline.sources import sinks

    path = made(spark, "baseline")
    old, new = slices.order_snapshots(spark, sf_dir)
    sinks.write_baseline(new, path)
    sinks.write_baseline(old, path)
    read = sinks.read_baseline(spark, path)
    rows = read.profiles.join(read.assets.select("model_urn", "urn", "row_count"), ["model_urn", "urn"])
    return rows.select("urn", "model_urn", "path", F.round(X.finite(F.col("mean")), 2).alias("mean"), "row_count")


@query(
    _STATS + """, models AS (SELECT r.r_regionkey AS r, n.k, n.urn, n.side, max(n.n) AS n FROM region r JOIN kept n ON r.r_regionkey IN (n.n_regionkey, (n.n_regionkey + 1) % 5) GROUP BY ALL)
    SELECT 'urn:li:mlModel:(urn:li:dataPlatform:spark,region_' || r || ',PROD)' AS model_urn, urn, n AS row_count FROM models WHERE side = CASE WHEN r < 2 THEN 'new' ELSE 'old' END"""
)
def baseline_precedence(spark, sf_dir):
    """Two places of baselines, the first of which has two of the five models."""
    from plumbline.functions.durable import made
    from plumbline.sources import sinks

    first, second = made(spark, "baseline"), made(spark, "baseline")
    old, new = slices.order_snapshots(spark, sf_dir, per_region=True)
    two = F.col("model_urn").rlike("region_[01],")
    sinks.write_baseline(Snapshot.of(*(getattr(new, t).filter(two) for t in ("assets", "columns", "profiles", "col_features"))), first)
    sinks.write_baseline(old, second)
    return sinks.read_first_baseline(spark, [first, second]).assets.select("model_urn", "urn", "row_count")


@query(
    _STATS + """SELECT 'urn:li:mlModel:(urn:li:dataPlatform:spark,region_' || r_regionkey || ',PROD)' AS model_urn, urn, path, uniq AS unique_count, round(mean, 2) AS mean
    FROM region JOIN kept ON r_regionkey IN (n_regionkey, (n_regionkey + 1) % 5) WHERE side = 'old'"""
)
def baseline_embedded(spark, sf_dir):
    """Baselines kept in a catalog's records, in a property or in a note among other words, and read back."""
    from plumbline.sources import documents

    kept = documents.to_documents(slices.order_snapshots(spark, sf_dir, per_region=True)[0])
    noted = F.col("model_urn").rlike("region_[13],")
    records = kept.select(
        F.col("model_urn").alias("urn"), F.when(~noted, "urn:li:structuredProperty:gate_baseline").alias("property_urn"), F.when(~noted, F.col("document")).alias("value"),
        F.when(noted, F.concat(F.lit("approved on Monday: "), "document", F.lit(" by the owner"))).alias("description"),
    )
    read = documents.from_documents(documents.embedded(records))
    return read.profiles.select("model_urn", "urn", "path", "unique_count", F.round(X.finite(F.col("mean")), 2).alias("mean"))


@query(
    """SELECT c_name AS model_urn, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'changed' ELSE 'first' END AS note
    FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0"""
)
def property_patch(spark, sf_dir):
    """Properties of two writers: a patch leaves the names that it doesn't have."""
    from plumbline.sources import sinks

    customer = slices.table(spark, sf_dir, "customer").withColumnRenamed("c_name", "model_urn")
    old = customer.filter("c_custkey % 3 <> 0").select("model_urn", F.create_map(F.lit("segment"), "c_mktsegment", F.lit("note"), F.lit("first")).alias("properties"))
    changes = customer.filter("c_custkey % 2 = 0").select("model_urn", F.create_map(F.lit("note"), F.lit("changed")).alias("properties"))
    value = lambda name: F.try_element_at("properties", F.lit(name)).alias(name)
    return sinks.patched(old, changes).select("model_urn", value("segment"), value("note"))


@query(
    """SELECT c_name AS model_urn, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment,
      CASE WHEN c_custkey % 6 = 0 THEN 'third' WHEN c_custkey % 2 = 0 THEN 'second' WHEN c_custkey % 5 <> 0 THEN 'first' END AS note
    FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 2 = 0"""
)
def property_log(spark, sf_dir):
    """Properties from a log of four patches, two of them by writers at the same time, folded once between."""
    from concurrent.futures import ThreadPoolExecutor

    from plumbline.functions.durable import made
    from plumbline.sources import sinks

    path = made(spark, "properties")
    customer = slices.table(spark, sf_dir, "customer").withColumnRenamed("c_name", "model_urn")
    patch = lambda rows, **values: sinks.patch_properties(rows.select("model_urn", F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))).alias("properties")), path)
    patch(customer.filter("c_custkey % 5 <> 0"), note=F.lit("first"), draft=F.lit("x"))
    patch(customer.filter("c_custkey % 2 = 0"), note=F.lit("second"))
    sinks.compact_properties(spark, path)
    with ThreadPoolExecutor(2) as pool:
        segment = pool.submit(patch, customer.filter("c_custkey % 5 <> 0"), segment=F.col("c_mktsegment"), draft=F.lit(None).cast("string"))
        note = pool.submit(patch, customer.filter("c_custkey % 6 = 0"), note=F.lit("third"))
        for done in (segment, note):
            done.result()
    value = lambda name: F.try_element_at("properties", F.lit(name)).alias(name)
    return sinks.properties(spark, path).filter(~F.map_contains_key("properties", "draft")).select("model_urn", value("segment"), value("note"))


@query(
    _STATS + """, models AS (SELECT r.r_regionkey AS r, n.urn, n.side, max(n.n) AS n FROM region r JOIN kept n ON r.r_regionkey IN (n.n_regionkey, (n.n_regionkey + 1) % 5) GROUP BY ALL)
    SELECT 'urn:li:mlModel:(urn:li:dataPlatform:spark,region_' || r || ',PROD)' AS model_urn, urn, n AS row_count, 2 AS live, 1 AS folded FROM models WHERE side = CASE WHEN r < 2 THEN 'new' ELSE 'old' END"""
)
def baseline_live(spark, sf_dir):
    """Three versions of which two still count for some model; the folders that a read opens before and after folding them."""
    from plumbline.functions.durable import made
    from plumbline.sources import sinks

    path = made(spark, "baseline")
    old, new = slices.order_snapshots(spark, sf_dir, per_region=True)
    two = F.col("model_urn").rlike("region_[01],")
    for version in (new, old, Snapshot.of(*(getattr(new, t).filter(two) for t in ("assets", "columns", "profiles", "col_features")))):
        sinks.write_baseline(version, path)
    opened = lambda: len({f.split("version=")[1].split("/")[0] for f in sinks.read_baseline(spark, path).assets.inputFiles() if "/assets/" in f})
    live = opened()
    sinks.compact_baseline(spark, path)
    return sinks.read_baseline(spark, path).assets.select("model_urn", "urn", "row_count", F.lit(live).alias("live"), F.lit(opened()).alias("folded"))


@query(_STATS + "SELECT urn, path, CASE path WHEN 'price' THEN 0 ELSE 1 END AS ord, n AS row_count, nulls AS null_count, uniq AS unique_count, 'urn:li:corpuser:u' || (k % 4) AS owners FROM kept WHERE side = 'new'")
def recording_round_trip(spark, sf_dir):
    """The nations' assets recorded as one document and loaded again."""
    from plumbline.functions.durable import made
    from plumbline.sources import recorded
    from plumbline.sources.catalog import Catalog

    _, now = slices.order_snapshots(spark, sf_dir)
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    field = F.struct("path", "null_count", "null_proportion", "unique_count", none("unique_proportion", "double"), "min", "max", "mean", none("median", "string"), "stdev")
    rows = now.assets.select("model_urn", "urn", "row_count")
    profiles = now.profiles.join(rows, ["model_urn", "urn"]).groupBy("urn").agg(
        F.lit(0).cast("long").alias("ts"), F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"), F.collect_list(field).alias("fields")
    )
    edges = now.assets.select(F.col("model_urn").alias("src"), F.col("urn").alias("dst"), F.lit("Consumes").alias("relationship"), F.lit(0).alias("seq"))
    source = Catalog.of(now.assets, edges, now.columns, profiles)
    path = made(spark, "recording")
    recorded.record({"before": source, "after": source}, now.assets.select("urn"), path)
    loaded = recorded.load(spark, path, "after")
    stats = loaded.profiles.select("urn", "row_count", F.inline("fields")).select("urn", "path", "row_count", "null_count", "unique_count")
    owned = loaded.assets.select("urn", F.array_join("owners", ",").alias("owners"))
    return loaded.columns.select("urn", "path", "ord").join(stats, ["urn", "path"]).join(owned, "urn")


@query("""WITH supplied AS (SELECT l_partkey AS k, count(*) AS row_count, count(DISTINCT l_suppkey) AS n_edges FROM lineitem GROUP BY 1)
  SELECT 'urn:li:dataset:(urn:li:dataPlatform:spark,part.' || p_partkey || ',PROD)' AS urn, 'urn:li:corpuser:u' || (p_size % 4) AS owners,
    coalesce(n_edges, 0) AS n_edges, row_count, CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END AS n_changed FROM part LEFT JOIN supplied ON k = p_partkey""")
def recording_in_parts(spark, sf_dir):
    """All parts as assets, recorded in parts in two states and loaded again: edges, profiles and the owners that changed."""
    from plumbline.functions.durable import made
    from plumbline.sources import recorded
    from plumbline.sources.catalog import FIELD, Catalog

    part, line = slices.table(spark, sf_dir, "part"), slices.table(spark, sf_dir, "lineitem")
    name = lambda key: slices.dataset(F.concat(F.lit("part."), F.col(key).cast("string")))
    owner = lambda key: F.array(F.concat(F.lit("urn:li:corpuser:u"), key.cast("string")))
    size = F.col("p_size") % 4
    assets = part.select(
        name("p_partkey").alias("urn"), F.lit("dataset").alias("entity_type"), owner(size).alias("owners"), F.array().cast("array<string>").alias("tags"),
        F.lit(False).alias("deprecated"), F.lit(None).cast("string").alias("deprecation_note"), F.col("p_partkey").alias("key"), size.alias("size"),
    )
    was = assets.withColumn("owners", F.when(F.col("key") % 50 == 0, owner(F.col("size") + 1)).otherwise(F.col("owners")))
    # Both states have these edges and profiles, and each is read several times.
    pairs = cut(line.select("l_partkey", "l_suppkey").distinct(), "edges")
    edges = pairs.select(name("l_partkey").alias("src"), slices.dataset(F.concat(F.lit("supplier."), F.col("l_suppkey").cast("string"))).alias("dst"), F.lit("DownstreamOf").alias("relationship"), F.lit(0).alias("seq"))
    fields = F.array().cast(f"array<struct<{FIELD.replace(' ', ':').replace(',:', ',')}>>").alias("fields")
    counted = cut(line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("row_count")), "counts")
    profiles = counted.select(name("l_partkey").alias("urn"), F.lit(0).cast("long").alias("ts"), "row_count", F.lit(0).cast("long").alias("column_count"))
    states = {s: Catalog.of(a, edges, None, profiles.withColumn("fields", fields)) for s, a in (("before", was), ("after", assets))}
    path = made(spark, "recording-parts")
    recorded.record_parts(states, path)
    before, after = (recorded.load_parts(spark, path, s) for s in ("before", "after"))
    n_edges = after.edges.groupBy(F.col("src").alias("urn")).agg(F.count(F.lit(1)).alias("n_edges"))
    changed = before.assets.select("urn", F.col("owners").alias("had")).join(after.assets, "urn")
    rows = changed.join(n_edges, "urn", "left").join(after.profiles.select("urn", "row_count"), "urn", "left")
    return rows.select("urn", F.array_join("owners", ",").alias("owners"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "row_count", (F.col("had") != F.col("owners")).cast("int").alias("n_changed"))

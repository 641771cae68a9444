"""A small lineage graph with four changes, as a recording: two models, features, and three tables."""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.durable import made
from plumbline.operators.policy import Policy
from plumbline.operators.snapshot import Snapshot
from plumbline.plans import gate
from plumbline.plans.slices import NOW
from plumbline.sources import recorded

MUTATIONS = ("none", "drop", "drift", "governance")


def _dataset(name: str) -> str:
    return f"urn:li:dataset:(urn:li:dataPlatform:snowflake,{name},PROD)"


def _model(name: str) -> str:
    return f"urn:li:mlModel:(urn:li:dataPlatform:sagemaker,{name},PROD)"


FRAUD, CHURN = _model("fraud_detector_v3"), _model("churn_predictor_v1")
VELOCITY = "urn:li:mlFeature:(fraud_detection,transaction_velocity_7d)"
RISK = "urn:li:mlFeature:(fraud_detection,customer_risk_score)"
VOLUME = "urn:li:mlFeature:(customer_churn,customer_txn_volume)"
RAW, CUSTOMERS, STAGING = _dataset("transactions.raw"), _dataset("customers.raw"), _dataset("staging.transactions_clean")

# The fixture's edges, columns, profiles and owners.
_EDGES = {
    FRAUD: [(VELOCITY, "Consumes"), (RISK, "Consumes")],
    CHURN: [(VOLUME, "Consumes")],
    VELOCITY: [(STAGING, "DerivedFrom")],
    RISK: [(CUSTOMERS, "DerivedFrom")],
    VOLUME: [(STAGING, "DerivedFrom")],
    STAGING: [(RAW, "DownstreamOf")],
}
_COLUMNS = {
    RAW: [
        ("transaction_id", "StringType", "VARCHAR(64)", False),
        ("customer_id", "StringType", "VARCHAR(64)", False),
        ("transaction_amount", "NumberType", "DECIMAL(10,2)", False),
        ("merchant_id", "StringType", "VARCHAR(64)", True),
        ("timestamp", "TimeType", "TIMESTAMP_NTZ", False),
    ],
    CUSTOMERS: [
        ("customer_id", "StringType", "VARCHAR(64)", False),
        ("signup_date", "DateType", "DATE", False),
        ("credit_score", "NumberType", "INT", True),
        ("country_code", "StringType", "VARCHAR(2)", True),
        ("risk_level", "StringType", "VARCHAR(16)", True),
    ],
    STAGING: [
        ("transaction_id", "StringType", "VARCHAR(64)", True),
        ("customer_id", "StringType", "VARCHAR(64)", True),
        ("amount", "NumberType", "DECIMAL(10, 2)", True),
        ("event_date", "DateType", "DATE", True),
    ],
}
_PROFILES = {
    RAW: (10000, "transaction_amount", 0, 0.0, "1.00", "5000.00", "125.50", "45.20"),
    CUSTOMERS: (5000, "credit_score", 50, 0.01, "300", "850", "710.0", "55.0"),
    STAGING: (10000, "amount", 0, 0.0, "1.00", "5000.00", "125.50", "45.20"),
}
_COPIES = [("transaction_id", "transaction_id"), ("customer_id", "customer_id"), ("amount", "transaction_amount"), ("event_date", "timestamp")]
_OWNERS = {RAW: "data_eng_tom", CUSTOMERS: "data_eng_tom", STAGING: "data_eng_tom", FRAUD: "ml_eng_alex", CHURN: "ml_eng_priya"}


def _state() -> dict:
    kinds = {u: u.split(":")[2] for u in [*_EDGES, RAW, CUSTOMERS]}
    field = lambda urn, c: f"urn:li:schemaField:({urn},{c})"
    entities = {}
    for urn, kind in kinds.items():
        aspects: dict = {}
        if urn in _OWNERS:
            aspects["ownership"] = {"owners": [{"owner": f"urn:li:corpuser:{_OWNERS[urn]}"}]}
        if urn == STAGING:
            aspects["upstreamLineage"] = {"fineGrainedLineages": [{"upstreams": [field(RAW, up)], "downstreams": [field(STAGING, down)]} for down, up in _COPIES]}
        entities[urn] = {"entity_type": kind, "aspects": aspects}
    lineage = {u: {"UPSTREAM": [{"source_urn": u, "target_urn": v, "relationship": r} for v, r in vs], "DOWNSTREAM": []} for u, vs in _EDGES.items()}
    schemas = {u: [{"field_path": p, "data_type": t, "native_type": n, "nullable": x, "tags": []} for p, t, n, x in cs] for u, cs in _COLUMNS.items()}
    profiles = {
        u: {"timestampMillis": 1, "rowCount": n, "columnCount": len(_COLUMNS[u]), "fieldProfiles": [{"fieldPath": c, "nullCount": k, "nullProportion": p, "min": lo, "max": hi, "mean": m, "stdev": s}]}
        for u, (n, c, k, p, lo, hi, m, s) in _PROFILES.items()
    }
    return {"entities": entities, "lineage": lineage, "schemas": schemas, "profiles": profiles}


def recording(mutation: str) -> dict:
    """The recorded document with one of MUTATIONS between its states."""
    before = _state()
    after = copy.deepcopy(before)
    if mutation == "drop":
        after["schemas"][RAW] = [f for f in after["schemas"][RAW] if f["field_path"] != "transaction_amount"]
    elif mutation == "drift":
        after["profiles"][STAGING]["fieldProfiles"][0] |= {"nullCount": 1800, "nullProportion": 0.18, "max": "18400.00", "mean": "342.10", "stdev": "512.75"}
    elif mutation == "governance":
        after["entities"][RAW]["aspects"]["deprecation"] = {"deprecated": True, "note": ""}
        after["entities"][STAGING]["aspects"]["globalTags"] = {"tags": [{"tag": "urn:li:tag:PII"}]}
    return {"before": before, "after": after}


def write_recording(spark: SparkSession, mutation: str, path: str) -> str:
    """Writes the recording where all workers can read it."""
    spark.createDataFrame([(json.dumps(recording(mutation)),)], "value string").coalesce(1).write.text(path)
    return path


def _written(spark: SparkSession, mutation: str) -> str:
    return write_recording(spark, mutation, made(spark, "recording"))


def _models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(FRAUD,), (CHURN,)], "model_urn string")


def approved(spark: SparkSession) -> Snapshot:
    """Both models' baseline: the state before any change."""
    return gate.resolve(recorded.load(spark, _written(spark, "none"), "before"), _models(spark))[1]


def gate_of(spark: SparkSession, mutation: str, policy: Policy | None = None, baseline: Snapshot | None = None) -> gate.Gate:
    """Both models' gate after a mutation, against the state before it."""
    source = recorded.load(spark, _written(spark, mutation), "after")
    return gate.check(source, _models(spark), baseline or approved(spark), policy, NOW)


def verdict_table(spark: SparkSession) -> DataFrame:
    """Verdict and coverage of both models under every mutation."""
    baseline, out = approved(spark), None
    for mutation in MUTATIONS:
        result = gate_of(spark, mutation, baseline=baseline)
        rows = result.verdicts.join(result.coverage, "model_urn", "left").select(
            F.lit(mutation).alias("mutation"), "model_urn", "status", "blocking", "warning", "assets_checked", "columns_compared", "columns_total", "assets_profiled", "exit_code"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def scale_edges(spark: SparkSession, features: int = 40) -> DataFrame:
    """A wide and deep graph: one model, ``features`` features, fan-in, a cycle and a chain of twelve."""
    model = _model("scale_model")
    ways: list[tuple[str, str, str]] = []
    for i in range(features):
        feature, staging = f"urn:li:mlFeature:(scale,f_{i:03d})", _dataset(f"staging_{i:03d}")
        ways += [(model, feature, "Consumes"), (feature, staging, "DerivedFrom"), (staging, _dataset(f"raw_{i:03d}"), "DownstreamOf")]
        if i and i % 3 == 0:
            ways.append((staging, _dataset("hot_shared"), "DownstreamOf"))
    cycle, deep = [_dataset("cycle_a"), _dataset("cycle_b")], [_dataset(f"deep_{k:02d}") for k in range(12)]
    ways += [(_dataset("staging_000"), cycle[0], "DownstreamOf"), (cycle[0], cycle[1], "DownstreamOf"), (cycle[1], cycle[0], "DownstreamOf")]
    ways += [(a, b, "DownstreamOf") for a, b in zip([_dataset("staging_001"), *deep], deep)]
    return spark.createDataFrame([(a, b, r, i) for i, (a, b, r) in enumerate(ways)], "src string, dst string, relationship string, seq int")

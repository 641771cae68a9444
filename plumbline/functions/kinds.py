"""Finding kinds, severities and the fixed vocabularies of the differs."""

from __future__ import annotations

CLEAR, WARN, BLOCK = "CLEAR", "WARN", "BLOCK"
SEVERITIES = (CLEAR, WARN, BLOCK)  # in rank order
CERTAIN, PROBABLE = "CERTAIN", "PROBABLE"

# Every finding kind, how it is known, and its severity by default.
KINDS = {
    "COLUMN_DROPPED": (CERTAIN, BLOCK),
    "COLUMN_ADDED": (CERTAIN, CLEAR),
    "COLUMN_TYPE_CHANGED": (CERTAIN, BLOCK),
    "COLUMN_NULLABILITY_RELAXED": (CERTAIN, WARN),
    "ASSET_DEPRECATED": (CERTAIN, BLOCK),
    "OWNERSHIP_LOST": (CERTAIN, WARN),
    "NEW_SENSITIVE_TAG": (CERTAIN, WARN),
    "NULL_RATE_JUMP": (PROBABLE, WARN),
    "CARDINALITY_CHANGE": (PROBABLE, WARN),
    "MEAN_SHIFT": (PROBABLE, WARN),
    "RANGE_VIOLATION": (PROBABLE, WARN),
    "ROW_COUNT_CHANGE": (PROBABLE, WARN),
}

# Tags whose appearance is a finding unless the policy names others.
SENSITIVE_TAGS = ("PII", "Sensitive", "Confidential", "Restricted", "PCI", "PHI", "GDPR", "HIPAA")

# Bits of the integer and floating types that platforms spell.
INTEGER_BITS = {
    "tinyint": 8, "int8": 8, "byteint": 8, "byte": 8,
    "smallint": 16, "int16": 16, "short": 16,
    "mediumint": 24,
    "int": 32, "integer": 32, "int32": 32,
    "bigint": 64, "int64": 64, "long": 64,
}
FLOAT_BITS = {
    "real": 32, "float": 32, "float4": 32, "float32": 32,
    "double": 64, "double precision": 64, "float8": 64, "float64": 64,
}
# Names of decimal and of string types.
DECIMAL_NAMES = ("decimal", "numeric", "number", "dec")
STRING_NAMES = (
    "varchar", "varchar2", "char", "character", "nvarchar", "nchar", "string",
    "text", "longtext", "mediumtext", "tinytext", "clob", "nclob",
)
# The environments that end a dataset's key, and labels of entity types.
FABRICS = ("PROD", "DEV", "QA", "UAT", "TEST", "STAGING", "CORP", "NON_PROD", "EI", "SANDBOX")
LABELS = {"dataset": "Dataset", "mlFeature": "Feature", "mlFeatureTable": "Feature table", "mlModel": "Model"}
# The label of an edge that names none, by the type of its downstream end.
RELATIONSHIPS = {"mlModel": "Consumes", "mlFeature": "DerivedFrom", "mlPrimaryKey": "DerivedFrom"}
# Entity types that a downstream walk goes through.
TRAVERSABLE = ("dataset", "mlFeature", "mlFeatureTable", "mlPrimaryKey")

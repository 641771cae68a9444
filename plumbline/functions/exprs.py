"""Column expressions: identities, tags, numbers, native types and text.

All are built-in functions, so they stay inside generated code; none is a Python UDF.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.kinds import (
    DECIMAL_NAMES,
    FABRICS,
    FLOAT_BITS,
    INTEGER_BITS,
    LABELS,
    RELATIONSHIPS,
    SEVERITIES,
    STRING_NAMES,
)


def literal_map(values: dict, key: Column) -> Column:
    """The value under ``key``, null for others."""
    if not values:
        return F.lit(None).cast("string")
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.try_element_at(table, key)


# -- identities ---------------------------------------------------------------


def entity_type(urn: Column) -> Column:
    """The third token of an identity, "unknown" for other strings."""
    token = F.substring_index(F.substring_index(urn, ":", 3), ":", -1)
    return F.when(urn.startswith("urn:li:"), F.coalesce(F.nullif(token, F.lit("")), F.lit("unknown"))).otherwise("unknown")


def field_dataset(urn: Column) -> Column:
    """The dataset of a column's identity, null where it is malformed."""
    return F.nullif(F.regexp_extract(urn, r"^urn:li:schemaField:\((.+),([^,]+)\)$", 1), F.lit(""))


def field_column(urn: Column) -> Column:
    """The column of a column's identity; it follows the last comma."""
    return F.nullif(F.regexp_extract(urn, r"^urn:li:schemaField:\((.+),([^,]+)\)$", 2), F.lit(""))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_upper(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def report_name(urn: Column) -> Column:
    """Name for reports: the last key segment, before an all-uppercase one at the end."""
    open_at = F.instr(urn, "(")
    body = F.substring(urn, open_at + 1, F.length(urn))
    inner = F.when(F.instr(body, ")") > 0, F.substring(body, F.lit(1), F.length(body) - F.length(F.substring_index(body, ")", -1)) - 1)).otherwise(body)
    parts = F.filter(F.split(inner, ","), lambda p: ~p.startswith("urn:li:dataPlatform:"))
    last = lambda ps: F.try_element_at(ps, F.lit(-1))
    before = lambda ps: F.try_element_at(ps, F.size(ps) - 1)
    tuple_name = _once(parts, lambda ps: F.when(F.size(ps) == 0, urn).when((F.size(ps) > 1) & _is_upper(last(ps)), before(ps)).otherwise(last(ps)))
    field = urn.startswith("urn:li:schemaField:(")
    dataset, column = field_dataset(urn), field_column(urn)
    nested = F.when(_is_upper(column), dataset).otherwise(column)
    return (
        F.when(~urn.startswith("urn:li:"), urn)
        .when(open_at == 0, F.substring_index(urn, ":", -1))
        .when(field & dataset.isNotNull() & dataset.contains("("), nested)
        .otherwise(tuple_name)
    )


def finding_name(urn: Column) -> Column:
    """Name in findings: the last key segment that is no identity, before a known environment."""
    bracketed = (F.instr(urn, "(") > 0) & (F.instr(urn, ")") > 0)
    body = F.when(bracketed, F.regexp_extract(urn, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)).otherwise(F.substring_index(urn, ":", -1))
    parts = F.filter(F.split(body, ","), lambda p: (p != "") & ~p.startswith("urn:li:"))
    count, last = F.size(parts), F.try_element_at(parts, F.lit(-1))
    name = F.when(count == 0, urn).when((count >= 2) & last.isin(*FABRICS), F.try_element_at(parts, count - 1)).otherwise(last)
    return F.when(urn.startswith("urn:li:"), name).otherwise(urn)


def entity_label(kind: Column) -> Column:
    return F.coalesce(literal_map(LABELS, kind), F.lit("Asset"))


def relationship(given: Column, downstream_type: Column) -> Column:
    """An edge's label, by its downstream end where it has none."""
    return F.coalesce(F.nullif(given, F.lit("")), literal_map(RELATIONSHIPS, downstream_type), F.lit("DownstreamOf"))


def assertion_id(model: Column, scope: str) -> Column:
    """The identity under which verdicts on a model are recorded."""
    document = F.concat(F.lit('{"model_urn":"'), model, F.lit(f'","scope":"{scope}"}}'))
    return F.concat(F.lit("urn:li:assertion:"), F.md5(document))


# -- tags and rules -----------------------------------------------------------


def tag_name(tag: Column) -> Column:
    """A tag's own name in lower case: after the last colon of an identity, and the last dot."""
    own = F.when(tag.startswith("urn:li:"), F.substring_index(tag, ":", -1)).otherwise(tag)
    return F.lower(F.substring_index(F.trim(own), ".", -1))


def rule_id(kind: Column) -> Column:
    return F.replace(F.lower(kind), F.lit("_"), F.lit("-"))


def glob_match(text: Column, pattern: str) -> Column:
    """Whether the whole text matches a shell pattern (*, ?, [...])."""
    regex = fnmatch.translate(pattern)
    return text.rlike(r"\A" + regex.replace(r"\Z", "").replace(r"\z", "") + r"\z")


def severity_rank(severity: Column) -> Column:
    return literal_map({s: i for i, s in enumerate(SEVERITIES)}, severity)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


# -- numbers ------------------------------------------------------------------


def finite(text: Column) -> Column:
    """A number, null where the text is none or is not finite."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def relative_change(old: Column, new: Column) -> Column:
    """Signed change relative to the old value, null at 0."""
    return F.try_divide(new - old, F.abs(old))


def null_rate(proportion: Column, count: Column, rows: Column) -> Column:
    """The stored proportion, else the count over the rows; null where neither is known."""
    return F.coalesce(proportion, F.try_divide(count.cast("double"), F.nullif(rows, F.lit(0))))


def plain(value: Column) -> Column:
    """Six significant digits without trailing zeros, as in general number format."""
    shown = F.format_string("%.5e", value)
    power = F.substring_index(shown, "e", -1).try_cast("int")
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    fixed = strip(F.format_string("%.9f", shown.try_cast("double")))
    scientific = F.concat(strip(F.substring_index(shown, "e", 1)), F.lit("e"), F.substring_index(shown, "e", -1))
    return F.when(value == 0, F.lit("0")).when(power.between(-4, 5), fixed).otherwise(scientific)


# -- native types -------------------------------------------------------------


def logical_type(name: Column) -> Column:
    """NumberType and number are one logical type."""
    return F.regexp_replace(F.lower(F.trim(name)), r"^(.+)type$", "$1")


def _native_parts(native: Column) -> tuple[Column, Column]:
    """(name, what the one pair of brackets at its end holds); the name is null where the text is no type."""
    text = F.regexp_replace(F.lower(native), r"^\s+|\s+$", "")
    name = F.rtrim(F.substring_index(text, "(", 1))
    held = F.when(text.contains("("), F.regexp_replace(F.regexp_replace(text, r"^[^(]*\(", ""), r"\)$", ""))
    whole = ~text.contains("(") & ~text.contains(")") | text.endswith(")") & ~held.contains(")")
    return F.when(name.rlike("^[a-z_][a-z0-9_ ]*$") & whole, name), held


def native_base(native: Column) -> Column:
    return _native_parts(native)[0]


def native_arguments(native: Column) -> Column:
    """The numbers in brackets; none where any of them is no number."""
    name, held = _native_parts(native)
    raw = F.transform(F.split(F.when(name.isNotNull(), held), ","), lambda p: F.trim(p))
    numbers = F.forall(raw, lambda p: p.rlike("^[0-9]+$"))
    return F.when(numbers, F.transform(raw, lambda p: p.try_cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def native_family(base: Column) -> Column:
    return (
        F.when(base.isin(*INTEGER_BITS), "int")
        .when(base.isin(*FLOAT_BITS), "float")
        .when(base.isin(*DECIMAL_NAMES), "decimal")
        .when(base.isin(*STRING_NAMES), "string")
    )


def lossless_change(old_type: Column, old_native: Column, new_type: Column, new_native: Column) -> Column:
    """Whether every value of the old type fits the new one. What can't be judged counts as fitting.

    Bits must not shrink; decimals must keep the digits on both sides of the point (38, 9
    where none are given); a string may not get shorter, and one without length is unbounded. Integers
    fit floats and decimals, decimals without a fraction fit integers. Another logical type fits only
    if either side is null or unknown.
    """
    old_base, new_base = native_base(old_native), native_base(new_native)
    old_args, new_args = native_arguments(old_native), native_arguments(new_native)
    old_kind, new_kind = native_family(old_base), native_family(new_base)
    digits = lambda a: F.when(F.size(a) == 0, 38).otherwise(F.get(a, F.lit(0)))
    scale = lambda a: F.when(F.size(a) == 0, 9).otherwise(F.coalesce(F.get(a, F.lit(1)), F.lit(0)))
    both = lambda kind: (old_kind == kind) & (new_kind == kind)
    wider = lambda bits: literal_map(bits, new_base) >= literal_map(bits, old_base)
    old_length, new_length = F.get(old_args, F.lit(0)), F.get(new_args, F.lit(0))
    native = (
        F.when(old_kind.isNull() | new_kind.isNull(), True)
        .when(both("int"), wider(INTEGER_BITS))
        .when(both("float"), wider(FLOAT_BITS))
        .when(
            both("decimal"),
            (digits(new_args) - scale(new_args) >= digits(old_args) - scale(old_args)) & (scale(new_args) >= scale(old_args)),
        )
        .when(both("string"), F.when(new_length.isNull(), True).when(old_length.isNull(), False).otherwise(new_length >= old_length))
        .when((old_kind == "int") & new_kind.isin("float", "decimal"), True)
        .when((old_kind == "decimal") & (new_kind == "int"), scale(old_args) == 0)
        .otherwise(False)
    )
    old_logical, new_logical = logical_type(old_type), logical_type(new_type)
    open_type = old_logical.isin("null", "unknown") | new_logical.isin("null", "unknown")
    return F.when(old_logical != new_logical, open_type).otherwise(native)


# -- text ---------------------------------------------------------------------

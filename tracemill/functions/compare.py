"""Tolerant comparison of numbers, strings and identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6
# Keys by which answers are compared with care for their meaning.
IDENTIFIER_KEYS = ["file", "func", "cls", "class", "concrete_class", "dispatched_file", "dispatched_function", "dispatched_class"]
ENUM_KEYS = ["type", "status"]
ALTERNATIVES = "|||"


# How conditions and class names are written.
CONDITION_WORDS = r"^(if|elif|while|for|assert)\b\s*"
CLASS_REPR = r"^<class\s+'([^']+)'>$"


def safe_name(name: Column) -> Column:
    """A name for files: slashes and white space as underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"[/\s]+", "_")


def numbers_equal(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    """Within the tolerance, relative to the larger or absolute."""
    return F.abs(a - b) <= F.greatest(tol * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))


def normal_path(s: Column) -> Column:
    """Trimmed, with single forward slashes, no leading ./ and no trailing slash."""
    out = F.regexp_replace(F.regexp_replace(F.trim(s), r"\\", "/"), r"/{2,}", "/")
    out = F.regexp_replace(out, r"^\./", "")
    return F.when(F.length(out) > 1, F.regexp_replace(out, r"/$", "")).otherwise(out)


def dotted_path(s: Column) -> Column:
    """Dots read as slashes where there is no slash."""
    return F.when(s.rlike(r"[/\\]"), normal_path(s)).when(s.contains("."), normal_path(F.regexp_replace(s, r"\.", "/"))).otherwise(s)


def identifier_forms(s: Column, key: Column) -> Column:
    """The ways of writing an identifier that count as the same."""
    raw = F.trim(s)
    forms = F.array(raw, normal_path(raw), dotted_path(raw))
    other = F.transform(forms, lambda v: F.when(v.endswith(".py"), F.regexp_replace(v, r"\.py$", "")).otherwise(F.concat(v, F.lit(".py"))))
    return F.array_distinct(F.when(F.lower(key).contains("file"), F.concat(forms, other)).otherwise(forms))


def without_class_repr(s: Column) -> Column:
    found = F.regexp_extract(F.trim(s), CLASS_REPR, 1)
    return F.when(found != "", found).otherwise(F.trim(s))


def suffix_match(a: Column, b: Column) -> Column:
    """One is a tail of the other by whole components between dots and slashes."""
    parts = lambda c: F.filter(F.split(F.trim(c), r"[./]"), lambda x: x != "")
    pa, pb = parts(a), parts(b)
    n = F.least(F.size(pa), F.size(pb))
    tail = lambda p: F.slice(p, F.greatest(F.size(p) - n + 1, F.lit(1)), n)
    return (n > 0) & (tail(pa) == tail(pb))


def condition_text(s: Column) -> Column:
    """A condition without its keyword and colon."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), CONDITION_WORDS, ""), r":$", ""))


def enum_text(s: Column) -> Column:
    inner = F.trim(F.regexp_replace(F.trim(s), r"^<(.+)>$", "$1"))
    return F.upper(F.element_at(F.split(inner, r"\."), -1))


def _one_string_equal(expected: Column, predicted: Column, key: Column) -> Column:
    low = F.lower(key)
    e_id, p_id = without_class_repr(expected), without_class_repr(predicted)
    return (
        (expected == predicted)
        | ((low == "condition") & (condition_text(expected) == condition_text(predicted)))
        | (low.isin(IDENTIFIER_KEYS) & ((e_id == p_id) | suffix_match(e_id, p_id)))
        | F.arrays_overlap(identifier_forms(expected, key), identifier_forms(predicted, key))
        | (low.isin(ENUM_KEYS) & (enum_text(expected) == enum_text(predicted)))
    )


def strings_equal(expected: Column, predicted: Column, key: Column) -> Column:
    """Equal in any accepted way; the expected side may offer alternatives."""
    parts = F.transform(F.split(expected, r"\|\|\|"), F.trim)
    offered = (F.size(parts) >= 2) & ~F.exists(parts, lambda p: p == "")
    return _one_string_equal(expected, predicted, key) | (offered & F.exists(parts, lambda p: _one_string_equal(p, predicted, key)))


def answer_payload(doc: Column) -> Column:
    """``oracle_answer`` of a JSON document, else ``answer``, else the document. By key presence: null counts."""
    keys = F.json_object_keys(doc)
    return (
        F.when(F.array_contains(keys, "oracle_answer"), F.coalesce(F.get_json_object(doc, "$.oracle_answer"), F.lit("null")))
        .when(F.array_contains(keys, "answer"), F.coalesce(F.get_json_object(doc, "$.answer"), F.lit("null")))
        .otherwise(doc)
    )


def precision(hits: Column, predicted: Column, expected: Column) -> Column:
    return F.when((predicted == 0) & (expected == 0), 1.0).when(predicted == 0, 0.0).otherwise(hits / predicted)


def recall(hits: Column, predicted: Column, expected: Column) -> Column:
    return F.when((predicted == 0) & (expected == 0), 1.0).when(expected == 0, 0.0).otherwise(hits / expected)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def membership_label(p: Column, r: Column) -> Column:
    return F.when((p == 1) & (r == 1), "correct").when(p == 1, "missing_elements").when(r == 1, "extra_elements").otherwise("wrong_elements")


def scalar_credit(expected: Column, predicted: Column, tol: float = TOLERANCE) -> Column:
    """Struct of score, label, signed_error and off_by_one of a number against another; a null is invalid."""
    error = F.abs(predicted - expected) / F.greatest(F.abs(expected), F.lit(1.0))
    same = numbers_equal(expected, predicted, tol)
    return F.struct(
        F.when(predicted.isNull(), 0.0).when(same, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - error)).alias("score"),
        F.when(predicted.isNull(), "invalid").when(same, "correct").otherwise("scalar_wrong").alias("label"),
        F.when(predicted.isNotNull(), F.when(same, 0.0).otherwise(predicted - expected)).alias("signed_error"),
        (predicted.isNotNull() & ~same & (F.abs(predicted - expected) == 1)).alias("off_by_one"))

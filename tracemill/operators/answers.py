"""Whole answers as JSON documents: verdicts, and scores of their fields taken apart.

Row-wise helpers read the documents and name their elements; overlaps, pairs,
prefixes, scores and labels are joins and aggregates over the element rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compare as c
from ..functions import matching as m
from ..sources.shared import written
from .scoring import MEASURE_FIELDS, fold_fields, sequence_similarity

FIELDS = "answer_id long, field string, shape string, listed boolean, unordered boolean, state string, e string, p string"
ELEMENTS = "answer_id long, field string, shape string, side string, pos long, token string, cells map<string,string>"
_ID = ["answer_id", "field"]


@F.pandas_udf(T.StructType([T.StructField("correct", T.BooleanType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType())]))
def _verdict(expected: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    rows = []
    for e, p in zip(expected, predicted):
        (_, e), (read, p) = m.read_json(e), m.read_json(p)
        found = m.first_mismatch(e, p) if read else ("$", "invalid_json")
        rows.append((found is None, *(found or (None, None))))
    return pd.DataFrame(rows, columns=["correct", "path", "kind"])


@F.pandas_udf(T.BooleanType())
def values_match(expected: pd.Series, predicted: pd.Series, key: pd.Series) -> pd.Series:
    """Whether two JSON values meet under a key; a null predicted text does not."""
    return pd.Series([p is not None and m.same(json.loads(e), json.loads(p), k) for e, p, k in zip(expected, predicted, key)], dtype=bool)


def verdicts(answers: DataFrame) -> DataFrame:
    """(answer_id, expected, predicted) JSON documents -> answer_id, correct, path and kind of the first difference.

    The prediction may be wrapped as an answer file. One that is no JSON is wrong.
    """
    return answers.select("answer_id", _verdict("expected", c.answer_payload(F.col("predicted"))).alias("v")).select("answer_id", "v.*")


def _measures(records: list[dict]) -> list[str]:
    return list(dict.fromkeys(k for r in records for k, v in r.items() if k in MEASURE_FIELDS or m.is_container(v)))


def shape_of(key: str, value: object) -> str:
    """scalar_number, scalar_other, set, sequence, keyed_records or nested."""
    kind = m.kind_of(value)
    if kind not in ("array", "object"):
        return "scalar_number" if kind == "number" else "scalar_other"
    flat = not any(m.is_container(v) for v in (value.values() if kind == "object" else value))
    if kind == "object":
        return "keyed_records" if value and flat else "nested"
    if value and all(isinstance(v, dict) for v in value):
        if _measures(value):
            return "keyed_records"
    elif not flat:
        return "nested"
    return "set" if key in m.UNORDERED_KEYS else "sequence"


def answer_fields(answers: DataFrame) -> DataFrame:
    """One row for each expected field: shape, state (missing_field, invalid or null) and both sides as JSON.

    An answer that is no object is one field, ``$``.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for answer, e, p in zip(pdf["answer_id"], pdf["expected"], pdf["predicted"]):
                (_, e), (_, p) = m.read_json(e), m.read_json(p)
                for field, key, value in [(k, k, v) for k, v in e.items()] if isinstance(e, dict) else [("$", "root", e)]:
                    given, state = p, None
                    if isinstance(e, dict):
                        state = None if isinstance(p, dict) and key in p else "missing_field"
                        given = p[key] if state is None else None
                    if state is None and m.is_container(value):
                        given = m.container_in(given)
                        state = None if type(given) is type(value) else "invalid"
                    shape = shape_of(key, value)
                    if state is None and shape == "keyed_records" and isinstance(value, list) and not all(isinstance(r, dict) for r in given):
                        state = "invalid"
                    rows.append((answer, field, shape, isinstance(value, list), key in m.UNORDERED_KEYS, state, json.dumps(value), json.dumps(given)))
            yield pd.DataFrame(rows, columns=names)

    told = answers.select("answer_id", "expected", c.answer_payload(F.col("predicted")).alias("predicted"))
    return told.mapInPandas(split, FIELDS)


def field_elements(fields: DataFrame) -> DataFrame:
    """The elements of lists, records and nested fields, with unified tokens; cells hold what is measured."""
    names = [x.split()[0] for x in ELEMENTS.replace("map<string,string>", "map").split(", ")]

    def records(value: object) -> list[dict]:
        return [{"key": k, "value": v} for k, v in value.items()] if isinstance(value, dict) else value

    def sides(key: str, shape: str, e: object, p: object) -> Iterator[tuple[str, list[tuple[str, dict]]]]:
        if shape == "nested":
            for side, value in (("e", e), ("p", p)):
                yield side, [(path, {name: json.dumps(v)}) for path, name, v in m.leaves_of(value)]
        elif shape == "keyed_records":
            measures = ["value"] if isinstance(e, dict) else _measures(e)
            e, p = records(e), records(p)
            named = lambda r: {k: v for k, v in r.items() if k not in measures}
            for side, rows, tokens in zip("ep", (e, p), m.unified([named(r) for r in e], [named(r) for r in p], key)):
                yield side, [(t, {k: json.dumps(r[k]) for k in measures if k in r}) for t, r in zip(tokens, rows)]
        else:
            for side, tokens in zip("ep", m.unified(e, p, key)):
                yield side, [(t, {}) for t in tokens]

    def element(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for answer, field, shape, e, p in zip(*(pdf[x] for x in ("answer_id", "field", "shape", "e", "p"))):
                key = "root" if field == "$" else field
                for side, found in sides(key, shape, json.loads(e), json.loads(p)):
                    rows += [(answer, field, shape, side, pos, token, cells) for pos, (token, cells) in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    wanted = fields.where(F.col("state").isNull() & ~F.col("shape").startswith("scalar"))
    return wanted.select("answer_id", "field", "shape", "e", "p").mapInPandas(element, ELEMENTS)


def _scalar_scores(fields: DataFrame) -> DataFrame:
    ok = values_match("e", "p", F.when(F.col("field") == "$", "root").otherwise(F.col("field")))
    number = F.when(F.col("p").isin("true", "false"), None).otherwise(F.trim(F.col("p"), F.lit('"')).try_cast("double"))
    rows = fields.where(F.col("state").isNull() & F.col("shape").startswith("scalar")).withColumns({"ok": ok, "given": number})
    numeric = F.col("shape") == "scalar_number"
    error = F.abs(F.col("given") - F.col("e").cast("double")) / F.greatest(F.abs(F.col("e").cast("double")), F.lit(1.0))
    return rows.select(
        *_ID, F.when(F.col("ok"), 1.0).when(numeric & F.col("given").isNotNull(), F.greatest(F.lit(0.0), 1 - error)).otherwise(0.0).alias("score"),
        F.when(F.col("ok"), "correct").when(numeric & F.col("given").isNull(), "invalid").otherwise("scalar_wrong").alias("label"))


def _bags(elements: DataFrame) -> DataFrame:
    """Counts of both sides and their overlap by token."""
    side = lambda s: F.count_if(F.col("side") == s)
    tokens = elements.groupBy(*_ID, "token").agg(side("e").alias("ne"), side("p").alias("np"))
    return tokens.groupBy(*_ID).agg(F.sum("ne").alias("expected"), F.sum("np").alias("predicted"), F.sum(F.least("ne", "np")).alias("hits"))


def _turns(elements: DataFrame) -> DataFrame:
    """Elements of equal token paired in the order in which they stand."""
    turn = F.row_number().over(Window.partitionBy(*_ID, "side", "token").orderBy("pos"))
    turned = elements.withColumn("turn", turn)
    e, p = (turned.where(F.col("side") == s).select(*_ID, "token", "turn", F.col("pos").alias(f"{s}_pos"), F.col("cells").alias(f"{s}_cells")) for s in "ep")
    return e.join(p, [*_ID, "token", "turn"])


def _cells(pairs: DataFrame) -> DataFrame:
    """Of each field with pairs: cells measured, right ones, numeric ones, credit of the records."""
    each = pairs.select(*_ID, "e_pos", "p_cells", F.explode_outer("e_cells").alias("key", "e"))
    each = each.withColumn("p", F.col("p_cells")[F.col("key")])
    right = F.col("key").isNotNull() & values_match(F.coalesce("e", F.lit("null")), "p", F.coalesce("key", F.lit("")))
    number = lambda x: F.col(x).rlike(r"^-?\d|^-?Infinity$|^NaN$")
    each = each.withColumns({"right": right, "numeric": F.coalesce(number("e") & number("p"), F.lit(False))})
    records = each.groupBy(*_ID, "e_pos").agg(F.count("key").alias("cells"), F.count_if("right").alias("right"), F.count_if("numeric").alias("numeric"))
    half = F.when(F.col("cells") == 0, 1.0).otherwise(0.5 + 0.5 * F.col("right") / F.greatest("cells", F.lit(1)))
    return records.groupBy(*_ID).agg(F.count("*").alias("matched"), F.sum("cells").alias("cells"), F.sum("right").alias("right"),
                                     F.sum("numeric").alias("numeric"), F.sum(half).alias("credit"))


def _shares(hits: Column) -> tuple[Column, Column, Column]:
    p, r = c.precision(hits, F.col("predicted"), F.col("expected")), c.recall(hits, F.col("predicted"), F.col("expected"))
    return p, r, c.f1(p, r)


def _element_scores(fields: DataFrame) -> DataFrame:
    elements = written(field_elements(fields), "elements")  # read by side, token and shape
    nil = F.lit(0)
    rows = fields.where(F.col("state").isNull() & ~F.col("shape").startswith("scalar")).select(*_ID, "shape", "listed", "unordered")
    rows = rows.join(_bags(elements), _ID, "left").fillna(0, ["expected", "predicted", "hits"])
    measured = elements.where(F.col("shape").isin("keyed_records", "nested"))
    rows = rows.join(_cells(_turns(measured)), _ID, "left").fillna(0, ["matched", "cells", "right", "numeric", "credit"])
    ordered = elements.where(F.col("shape").isin("sequence", "keyed_records")).groupBy(*_ID).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "token")))), lambda x: x["token"]).alias(f"t{s}") for s in "ep"])
    none = F.array().cast("array<string>")
    rows = rows.join(ordered, _ID, "left").withColumns({t: F.coalesce(t, none) for t in ("te", "tp")})
    # how far both agree from the start
    agree = F.array_position(F.zip_with("te", "tp", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    rows = rows.withColumn("prefix", F.when(agree > 0, agree - 1).otherwise(F.size("te")).cast("long"))
    is_sequence = F.col("shape") == "sequence"
    rows = rows.withColumn("similarity", F.when(is_sequence, sequence_similarity(F.when(is_sequence, F.col("te")).otherwise(none), F.when(is_sequence, F.col("tp")).otherwise(none))))
    p, r, bag = _shares(F.col("hits"))
    kp, kr, kf = _shares(F.col("matched"))
    equal = F.col("te") == F.col("tp")
    sequence_label = (
        F.when(equal, "correct").when((F.col("prefix") == F.col("predicted")) & (F.col("prefix") < F.col("expected")), "truncated")
        .when((F.col("hits") == F.col("expected")) & (F.col("hits") == F.col("predicted")), "order_only").otherwise("diverged"))
    keyed_label = (
        F.when(kf < 1, c.membership_label(kp, kr))
        .when(F.col("right") < F.col("cells"), F.when((F.col("numeric") > 0) & (F.col("numeric") == F.col("cells")), "counts_wrong").otherwise("values_wrong"))
        .when(F.col("listed") & ~F.col("unordered") & ~equal, "order_only").otherwise("correct"))
    nested = _shares(F.col("right"))[2]
    by_shape = lambda s, q, k, n: F.when(F.col("shape") == "set", s).when(is_sequence, q).when(F.col("shape") == "keyed_records", k).otherwise(n)
    return rows.select(
        *_ID, by_shape(bag, F.coalesce("similarity", bag), _shares(F.col("credit"))[2], nested).alias("score"),
        by_shape(c.membership_label(p, r), sequence_label, keyed_label, F.when(nested >= 1, "correct").otherwise("values_wrong")).alias("label"),
        F.when(F.col("shape").isin("set", "sequence"), p).alias("precision"), F.when(F.col("shape").isin("set", "sequence"), r).alias("recall"),
        F.when(is_sequence, F.col("prefix")).alias("prefix"), "similarity",
        F.when(F.col("shape") == "keyed_records", F.when(F.col("cells") > nil, F.col("right") / F.col("cells")).otherwise(1.0)).alias("value_accuracy"))


def field_scores(fields: DataFrame) -> DataFrame:
    """Shape, score (four decimals) and label of every field, with the measures of its shape.

    Fields and their elements are written once: documents are parsed once, elements named once.
    """
    fields = written(fields, "fields")
    none = {n: F.lit(None).cast(t) for n, t in (("precision", "double"), ("recall", "double"), ("prefix", "long"), ("similarity", "double"), ("value_accuracy", "double"))}
    lost = fields.where(F.col("state").isNotNull()).select(*_ID, F.lit(0.0).alias("score"), F.col("state").alias("label"))
    scored = _element_scores(fields).unionByName(_scalar_scores(fields).withColumns(none)).unionByName(lost.withColumns(none))
    return fields.select(*_ID, "shape").join(scored, _ID).withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), 4))


def answer_scores(answers: DataFrame) -> DataFrame:
    """answer_id, correct, score, label, shapes: the verdict on the whole and the fold of the fields' scores."""
    scored = written(field_scores(answer_fields(answers)), "field-scores")
    folded = fold_fields(scored, verdicts(answers).select("answer_id", "correct"))
    shapes = scored.groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_set("shape")), ",").alias("shapes"))
    return folded.withColumn("score", F.round("score", 4)).join(shapes, "answer_id")

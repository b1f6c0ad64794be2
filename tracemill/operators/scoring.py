"""Answer scoring: elements of expected and predicted answers compared by joins.

Element tables are (answer_id, pos, token, measure); everything is keyed by
``answer_id``, so one shuffle by it serves all steps until the report.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compare as c
from ..functions.matching import UNORDERED_KEYS  # noqa: F401

# Labels in the order in which an instance takes its fields' labels.
LABEL_PRIORITY = [
    "invalid", "missing_field", "wrong_elements", "missing_elements", "extra_elements", "diverged", "truncated", "order_only",
    "values_wrong", "counts_wrong", "scalar_wrong", "format_only", "correct",
]
# Record fields that measure; all other scalar fields identify.
MEASURE_FIELDS = [
    "count", "observations", "violations", "held_always", "value", "values", "iterations", "inner_iterations", "invocations", "total",
    "message", "exception_message", "handled", "handled_where", "caller_saw_exception",
]
SEQUENCE_CELLS = 40_000_000
_KINDS = {dict: "object", list: "array", bool: "bool", str: "string", type(None): "null"}
LEAVES = "answer_id long, path string, key_name string, vtype string, sval string, nval double, pos long"
VALUES = "answer_id long, depth long, vtype string, size long"


def leaves(answers: DataFrame) -> DataFrame:
    """One row for each JSON leaf of (answer_id, doc); broken documents give none.

    List elements have the key name of their list; empty containers are leaves.
    """

    schema = pa.schema([("answer_id", pa.int64()), ("path", pa.string()), ("key_name", pa.string()), ("vtype", pa.string()), ("sval", pa.string()), ("nval", pa.float64()), ("pos", pa.int64())])

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, path, key, kind, text, number, pos = rows = ([], [], [], [], [], [], [])

            def walk(value: object, here: str, name: str) -> None:
                if isinstance(value, dict) and value:
                    for k, v in value.items():
                        walk(v, f"{here}.{k}", k)
                elif isinstance(value, list) and value:
                    for n, v in enumerate(value):
                        walk(v, f"{here}[{n}]", name)
                else:
                    of = _KINDS.get(type(value), "number")
                    path.append(here)
                    key.append(name)
                    kind.append(of)
                    text.append(value if of == "string" else json.dumps(value))
                    number.append(float(value) if of == "number" else None)

            for i, doc in enumerate(batch.column(1).to_pylist()):
                try:
                    value = json.loads(doc)
                except (TypeError, ValueError):
                    continue
                before = len(path)
                walk(value, "$", "")
                at += [i] * (len(path) - before)
                pos += range(len(path) - before)
            ids = batch.column(0).take(pa.array(at, pa.int64())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(rows[1:], list(schema)[1:]))], schema=schema)

    return answers.select("answer_id", "doc").mapInArrow(flatten, LEAVES)


def values(answers: DataFrame) -> DataFrame:
    """One row for each JSON value of (answer_id, doc), containers too: its depth (the whole document: 1), type and size; broken documents give none.

    The size is the children of a container, the characters of a string, those a number
    is written with, without minus signs, and else 0.
    """

    schema = pa.schema([("answer_id", pa.int64()), ("depth", pa.int64()), ("vtype", pa.string()), ("size", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, depth, kind, size = [], [], [], []
            for i, doc in enumerate(batch.column(1).to_pylist()):
                try:
                    todo = [(json.loads(doc), 1)]
                except (TypeError, ValueError):
                    continue
                while todo:
                    value, deep = todo.pop()
                    of = _KINDS.get(type(value), "number")
                    if of in ("object", "array"):
                        todo += [(v, deep + 1) for v in (value.values() if of == "object" else value)]
                    at.append(i)
                    depth.append(deep)
                    kind.append(of)
                    size.append(0 if of in ("bool", "null") else len(str(value).replace("-", "")) if of == "number" else len(value))
            ids = batch.column(0).take(pa.array(at, pa.int64())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip((depth, kind, size), list(schema)[1:]))], schema=schema)

    return answers.select("answer_id", "doc").mapInArrow(measure, VALUES)


def leaf_verdict(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """answer_id, correct, reason: every expected leaf met at its path; extra predicted leaves are ignored.

    Numbers meet within the tolerance, also from predicted strings; the reason is
    that of the first leaf, in document order, that fails.
    """
    e, p = expected.alias("e"), predicted.alias("p")
    number = F.coalesce(F.col("p.nval"), F.col("p.sval").try_cast("double"))
    same = (
        F.when(F.col("p.path").isNull(), F.lit(False))
        .when(F.col("e.vtype") == "number", F.coalesce(c.numbers_equal(F.col("e.nval"), number), F.lit(False)))
        .when(F.col("e.vtype") == "string", (F.col("p.vtype") == "string") & c.strings_equal(F.col("e.sval"), F.col("p.sval"), F.col("e.key_name")))
        .otherwise(F.lower("p.sval") == F.col("e.sval")))
    joined = e.join(p, (F.col("e.answer_id") == F.col("p.answer_id")) & (F.col("e.path") == F.col("p.path")), "left").select(
        F.col("e.answer_id").alias("answer_id"), F.col("e.pos").alias("pos"), same.alias("ok"),
        F.when(F.col("p.path").isNull(), F.concat(F.lit("missing "), F.col("e.path"))).otherwise(F.concat(F.lit("mismatch at "), F.col("e.path"))).alias("why"))
    return joined.groupBy("answer_id").agg(F.bool_and("ok").alias("correct"), F.min_by("why", F.when(~F.col("ok"), F.col("pos"))).alias("reason"))


def multiset_overlap(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """answer_id, expected, predicted, hits over tokens as multisets; answers of either side.

    The sides are counted together, not joined: where both are dealt by answer over as many
    tasks, they stay there. A null meets nothing.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    side = lambda d, e, p: d.select("answer_id", "token", e.alias("e"), p.alias("p"))
    both = side(expected, one, none).union(side(predicted, none, one)).groupBy("answer_id", "token").agg(F.sum("e").alias("e"), F.sum("p").alias("p"))
    met = F.when(F.col("answer_id").isNotNull() & F.col("token").isNotNull(), F.least("e", "p")).otherwise(none)
    return both.groupBy("answer_id").agg(F.sum("e").alias("expected"), F.sum("p").alias("predicted"), F.sum(met).alias("hits"))


def set_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Overlap with precision, recall, f1 and the membership label."""
    n = [F.col(x) for x in ("hits", "predicted", "expected")]
    scored = multiset_overlap(expected, predicted).withColumns({"precision": c.precision(*n), "recall": c.recall(*n)})
    return scored.withColumns({"score": c.f1(F.col("precision"), F.col("recall")), "label": c.membership_label(F.col("precision"), F.col("recall"))})


def unify(expected: DataFrame, predicted: DataFrame, same: Column) -> DataFrame:
    """``predicted`` with each token that equals no expected one replaced by the first expected token it matches.

    ``same`` compares ``e_token`` with ``p_token``. Only distinct leftovers are
    compared, with all expected tokens of their answer, met or not.
    """
    known = expected.groupBy("answer_id", "token").agg(F.min("pos").alias("first"))
    left = predicted.select("answer_id", "token").distinct().join(known, ["answer_id", "token"], "left_anti").withColumnRenamed("token", "p_token")
    found = left.join(known.withColumnRenamed("token", "e_token"), "answer_id").where(same).groupBy("answer_id", "p_token").agg(F.min_by("e_token", "first").alias("unified"))
    return predicted.join(found.withColumnRenamed("p_token", "token"), ["answer_id", "token"], "left").withColumn(
        "token", F.coalesce("unified", "token")).drop("unified")


def prefix_lengths(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """answer_id, n_expected, n_predicted, prefix: how many tokens agree from the start."""
    e, p = expected.select("answer_id", "pos", F.col("token").alias("e")), predicted.select("answer_id", "pos", F.col("token").alias("p"))
    both = e.join(p, ["answer_id", "pos"], "full")
    differ = F.min(F.when(~F.coalesce(F.col("e") == F.col("p"), F.lit(False)), F.col("pos")))
    return both.groupBy("answer_id").agg(F.count("e").alias("n_expected"), F.count("p").alias("n_predicted"), differ.alias("at")).select(
        "answer_id", "n_expected", "n_predicted", F.coalesce(F.col("at") - 1, F.least("n_expected", "n_predicted")).cast("long").alias("prefix"))


def sequence_labels(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Prefix, bag f1 and label: correct, truncated, order_only or diverged."""
    both = prefix_lengths(expected, predicted).join(set_scores(expected, predicted).select("answer_id", "hits", F.col("score").alias("bag_f1")), "answer_id")
    n_e, n_p = F.col("n_expected"), F.col("n_predicted")
    label = (
        F.when((F.col("prefix") == n_e) & (n_e == n_p), "correct")
        .when((F.col("prefix") == n_p) & (n_p < n_e), "truncated")
        .when((F.col("hits") == n_e) & (n_e == n_p), "order_only").otherwise("diverged"))
    return both.withColumns({"label": label, "prefix_ratio": F.when(n_e == 0, 1.0).otherwise(F.col("prefix") / n_e)})


@F.pandas_udf(T.DoubleType())
def sequence_similarity(expected: pd.Series, predicted: pd.Series) -> pd.Series:
    """Twice the matched share by longest matching blocks; null where the comparison would be too large."""
    import difflib

    def ratio(a: list, b: list) -> float | None:
        a, b = list(a), list(b)
        if a == b:
            return 1.0
        if len(a) * len(b) > SEQUENCE_CELLS:
            return None
        return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()

    return pd.Series([ratio(a, b) for a, b in zip(expected, predicted)])


def similarities(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    ordered = lambda d, n: d.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t")).select("answer_id", F.col("t.token").alias(n))
    empty = F.array().cast("array<string>")
    both = ordered(expected, "e").join(ordered(predicted, "p"), "answer_id", "full").select(
        "answer_id", F.coalesce("e", empty).alias("e"), F.coalesce("p", empty).alias("p"))
    return both.select("answer_id", sequence_similarity("e", "p").alias("similarity"))


def keyed_record_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Records paired by identity (``token``) and turn, with half credit for the identity and half for the measure.

    answer_id, score (f1 over credit), value_accuracy, median and greatest relative
    error, label.
    """
    turn = F.row_number().over(Window.partitionBy("answer_id", "token").orderBy("pos"))
    side = lambda d, n: d.select("answer_id", "token", turn.alias("turn"), F.col("measure").alias(n))
    both = side(expected, "e").join(side(predicted, "p"), ["answer_id", "token", "turn"], "full")
    paired = F.col("e").isNotNull() & F.col("p").isNotNull()
    right = paired & c.numbers_equal(F.col("e"), F.col("p"))
    error = F.when(paired, F.abs(F.col("p") - F.col("e")) / F.greatest(F.abs(F.col("e")), F.lit(1.0)))
    agg = both.groupBy("answer_id").agg(
        F.count("e").alias("expected"), F.count("p").alias("predicted"), F.count_if(paired).alias("pairs"), F.count_if(right).alias("right"),
        F.sum(F.when(paired, F.when(right, 1.0).otherwise(0.5)).otherwise(0.0)).alias("credit"),
        F.median(error).alias("median_error"), F.max(error).alias("max_error"))
    n = [F.col("credit"), F.col("predicted"), F.col("expected")]
    ids = [F.col("pairs"), F.col("predicted"), F.col("expected")]
    p, r = c.precision(*ids), c.recall(*ids)
    label = F.when((p == 1) & (r == 1), F.when(F.col("right") == F.col("pairs"), "correct").otherwise("counts_wrong")).otherwise(c.membership_label(p, r))
    return agg.select("answer_id", c.f1(c.precision(*n), c.recall(*n)).alias("score"),
                      F.when(F.col("pairs") > 0, F.col("right") / F.col("pairs")).alias("value_accuracy"), "median_error", "max_error", label.alias("label"))


def priority(label: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LABEL_PRIORITY)), label)


def fold_fields(fields: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Instance score and label of (answer_id, score, label) fields and (answer_id, correct) verdicts.

    A correct verdict forces 1.0; fields that are all right under a wrong verdict
    are a matter of format.
    """
    folded = fields.groupBy("answer_id").agg(F.avg("score").alias("mean"), F.min_by("label", priority(F.col("label"))).alias("worst"))
    return folded.join(verdicts, "answer_id", "left").select(
        "answer_id", F.coalesce("correct", F.lit(False)).alias("correct"),
        F.when(F.col("correct"), 1.0).otherwise(F.col("mean")).alias("score"),
        F.when(F.col("correct"), "correct").when(F.col("worst") == "correct", "format_only").otherwise(F.col("worst")).alias("label"))


def field_shape(fields: DataFrame, unordered: Column) -> DataFrame:
    """Shape of (answer_id, field, container, elements, scalars, records, measures) summaries.

    ``container``: scalar_number, scalar_other, object or array; the counts are those
    of the elements, of the scalar ones, of the records and of records' measure fields.
    """
    list_shape = F.when(unordered, "set").otherwise("sequence")
    return fields.withColumn("shape", (
        F.when(F.col("container").isin("scalar_number", "scalar_other"), F.col("container"))
        .when(F.col("container") == "object", F.when((F.col("elements") > 0) & (F.col("scalars") == F.col("elements")), "keyed_records").otherwise("nested"))
        .when((F.col("elements") > 0) & (F.col("records") == F.col("elements")), F.when(F.col("measures") > 0, "keyed_records").otherwise(list_shape))
        .when(F.col("scalars") < F.col("elements"), "nested").otherwise(list_shape)))


def accuracy_buckets(oracle: DataFrame, predicted: DataFrame, valid: Column, correct: Column, keys: list[str], group: list[str]) -> DataFrame:
    """Totals with missing oracle, missing and invalid predictions over keys of both sides."""
    both = oracle.withColumn("_o", F.lit(True)).join(predicted.withColumn("_p", F.lit(True)), keys, "full")
    o, p = F.col("_o").isNotNull(), F.col("_p").isNotNull()
    sure = lambda x: F.coalesce(x, F.lit(False))
    return both.groupBy(*group).agg(
        F.count_if(o).alias("total"), F.count_if(~o).alias("missing_oracle"), F.count_if(o & ~p).alias("missing_prediction"),
        F.count_if(o & p & ~sure(valid)).alias("invalid_prediction"), F.count_if(o & p & sure(valid) & sure(correct)).alias("correct"))


# What heads the answer of a reasoned reply; a fenced object; objects and lists of two levels.
ANSWER_HEAD = "## Answer"
FENCED_OBJECT = r"```(?:json)?\s*(\{.*?\})\s*```"
SHALLOW = [r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]"]


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _first_json(text: str) -> str | None:
    """A text that is JSON as a whole, else its first fenced object if that is JSON, else its first object."""
    whole = text.strip()
    if whole and _parses(whole):
        return whole
    fenced = re.search(FENCED_OBJECT, whole, re.DOTALL | re.IGNORECASE)
    if fenced and _parses(fenced[1]):
        return fenced[1]
    decoder, at = json.JSONDecoder(), whole.find("{")
    while at >= 0:
        try:
            return whole[at : decoder.raw_decode(whole, at)[1]]
        except ValueError:
            at = whole.find("{", at + 1)
    return None


def _last_json(text: str) -> str | None:
    """Behind the last head, the last object, else the last list, else what the whole gives."""
    _, head, tail = text.rpartition(ANSWER_HEAD)
    tail = re.sub(r"^```(?:json)?\s*", "", tail.strip(), flags=re.MULTILINE)
    tail = re.sub(r"\s*```$", "", tail, flags=re.MULTILINE).strip()
    for pattern in SHALLOW:
        found = re.findall(pattern, tail, re.DOTALL)
        if found and _parses(found[-1]):
            return found[-1]
    return tail if _parses(tail) else _first_json(tail if head else text)


def final_json(text: Column, mode: str = "json") -> Column:
    """The answer in a model's text, as JSON text; null where there is none.

    In ``json`` mode the first object counts, in ``reasoning`` mode the last one behind the answer's head.
    """
    find = {"json": _first_json, "reasoning": _last_json}[mode]

    @F.pandas_udf(T.StringType())
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find(t) if t else None)

    return found(text)


def unordered_equal(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """answer_id, same: the elements of two lists agree as multisets."""
    both = multiset_overlap(expected, predicted)
    return both.select("answer_id", ((F.col("hits") == F.col("expected")) & (F.col("hits") == F.col("predicted"))).alias("same"))


def record_columns(leaves: DataFrame) -> DataFrame:
    """answer_id, key_name, role: identity or measure of each field of an answer's records.

    Named measures, and fields that hold a container in any record, measure.
    """
    inside = leaves.where(F.col("path").rlike(r"\[\d+\]\."))
    field = F.regexp_extract("path", r"\[\d+\]\.([^.\[]+)", 1)
    deep = F.col("path").rlike(r"\[\d+\]\.[^.\[]+[.\[]") | F.col("vtype").isin("array", "object")
    fields = inside.groupBy("answer_id", field.alias("key_name")).agg(F.bool_or(deep).alias("deep"))
    return fields.select("answer_id", "key_name", F.when(F.col("deep") | F.col("key_name").isin(MEASURE_FIELDS), "measure").otherwise("identity").alias("role"))


def field_presence(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """answer_id, field, label of (answer_id, field, container): missing_field, invalid (another container) or null."""
    e, p = expected.alias("e"), predicted.select("answer_id", "field", F.col("container").alias("pc")).alias("p")
    return e.join(p, ["answer_id", "field"], "left").select(
        "answer_id", "field", F.when(F.col("pc").isNull(), "missing_field").when(F.col("pc") != F.col("container"), "invalid").alias("label"))

"""Queries over whole answers. Each order asks one of the written cases; the SQL has the results worked out by hand."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers as an
from ..sources.fixtures import table

#: expected, predicted (@: the order's number), whether it meets, path and kind of the first difference
VERDICTS = [
    ('{"count": @}', '{"count": @}', True, None, None),
    ('{"count": @}', '{"answer": {"count": @, "more": 1}}', True, None, None),
    ('{"rows": [@, 2]}', '{"rows": [@, 2, 3]}', False, "$.rows", "list_len"),
    ('{"unique_values": ["a", "b", "@"]}', '{"unique_values": ["@", "a", "b"]}', True, None, None),
    ('{"unique_values": ["a", "b"]}', '{"unique_values": ["a", "a"]}', False, "$.unique_values", "unmatched_element"),
    ('{"x": null}', '{"x": "None"}', True, None, None),
    ('{"x": {}}', '{"x": {"a": @}}', True, None, None),
    ('{"x": [1, @]}', '{"x": "[1, @]"}', True, None, None),
    ('{"x": {"a": @}}', '{"x": "mappingproxy({\'a\': @})"}', True, None, None),
    ('{"x": @}', '{"x": "@.0"}', True, None, None),
    ('{"flag": true}', '{"flag": "True"}', True, None, None),
    ('{"a": 1, "b": @}', '{"a": 1}', False, "$", "missing_keys"),
    ('{"a": [1, {"b": [@]}]}', '{"a": [1, {"b": {"c": @}}]}', False, "$.a[1].b", "type_mismatch"),
    ('{"a": 2, "x": [0, @]}', '{"x": [0, -@], "a": 2.0000001}', False, "$.x[1]", "number_mismatch"),
    ('{"file": "src/a.py"}', '{"file": "./src//a"}', True, None, None),
    ('{"name": "alpha"}', '{"name": "beta"}', False, "$.name", "string_mismatch"),
    ('{"func": "proxy.make"}', '{"func": "make"}', True, None, None),
    ('{"func": "a.make"}', '{"func": "b.make"}', False, "$.func", "string_mismatch"),
    ('{"x": "3"}', '{"x": 3}', False, "$.x", "value_mismatch"),
    ('{"x": "a ||| b"}', '{"x": "b"}', True, None, None),
    ('{"condition": "if x > @:"}', '{"condition": "x > @"}', True, None, None),
    ('{"status": "<State.open>"}', '{"status": "OPEN"}', True, None, None),
    ('{"x": false}', '{"x": "no"}', False, "$.x", "value_mismatch"),
    ('[@, "a"]', '{"answer": [@, "a"]}', True, None, None),
    ('{"x": @}', 'so the count is @', False, "$", "invalid_json"),
]
#: expected, predicted, whether it meets, score, label, shapes
SCORES = [
    ('{"a": @, "b": "x"}', '{"a": @, "b": "x"}', True, 1.0, "correct", "scalar_number,scalar_other"),
    ('{"rows": [1, 2]}', '{"rows": {"a": 1}}', False, 0.0, "invalid", "sequence"),
    ('{"a": 1, "b": @}', '{"a": 1}', False, 0.5, "missing_field", "scalar_number"),
    ('{"unique_values": ["a", "b"]}', '{"unique_values": ["a", "c"]}', False, 0.5, "wrong_elements", "set"),
    ('{"unique_values": ["a", "b", "c"]}', '{"unique_values": ["a", "b"]}', False, 0.8, "missing_elements", "set"),
    ('{"unique_values": ["a", "b"]}', '{"unique_values": ["a", "b", "c"]}', False, 0.8, "extra_elements", "set"),
    ('{"path": [1, 2, 3, 4]}', '{"path": [1, 9, 3, 4]}', False, 0.75, "diverged", "sequence"),
    ('{"path": [1, 2, 3, 4]}', '{"path": [1, 2]}', False, 0.6667, "truncated", "sequence"),
    ('{"path": [1, 2, 3]}', '{"path": [2, 1, 3]}', False, 0.6667, "order_only", "sequence"),
    ('{"rows": [{"name": "a", "message": "x"}]}', '{"rows": [{"name": "a", "message": "y"}]}', False, 0.5, "values_wrong", "keyed_records"),
    ('{"rows": [{"name": "a", "count": @}, {"name": "b", "count": 1}]}', '{"rows": [{"name": "a", "count": -@}, {"name": "b", "count": 1}]}', False, 0.75, "counts_wrong", "keyed_records"),
    ('{"rows": [{"name": "a", "count": null}]}', '{"rows": [{"name": "a", "count": 5}]}', False, 0.5, "values_wrong", "keyed_records"),
    ('{"rows": [{"name": "a", "count": 1}, {"name": "b", "count": 1}]}', '{"rows": [{"name": "b", "count": 1}, {"name": "a", "count": 1}]}', False, 1.0, "order_only", "keyed_records"),
    ('{"rows": [{"name": "a", "count": 1}, {"name": "b", "count": 1}]}', '{"rows": [{"name": "a", "count": 1}]}', False, 0.6667, "missing_elements", "keyed_records"),
    ('{"totals": {"a": 1, "b": 2}}', '{"totals": {"a": 1, "b": 3}}', False, 0.75, "counts_wrong", "keyed_records"),
    ('{"x": 10}', '{"x": 9}', False, 0.9, "scalar_wrong", "scalar_number"),
    ('{"x": 10}', '{"x": "many"}', False, 0.0, "invalid", "scalar_number"),
    ('{"x": "a"}', '{"x": "b"}', False, 0.0, "scalar_wrong", "scalar_other"),
    ('{"x": {"a": {}, "b": [1]}}', '{"x": {"b": [1]}}', False, 1.0, "format_only", "nested"),
    ('{"x": {"a": [1, {"b": 2}], "c": 3}}', '{"x": {"a": [1, {"b": 5}], "c": 3}}', False, 0.6667, "values_wrong", "nested"),
    ('{"path": [{"file": "./m.py", "line": 1}, {"file": "./m.py", "line": 1}]}', '{"path": [{"file": "m.py", "line": 1}, {"file": "./m.py", "line": 1}]}', True, 1.0, "correct", "sequence"),
    ('{"path": ["a", "a", "b"]}', '{"path": ["a", "./a", "c"]}', False, 0.6667, "diverged", "sequence"),
    ('{"x": []}', '{"x": []}', True, 1.0, "correct", "sequence"),
    ('{"x": "a", "path": [1, 2]}', '{"x": "a", "path": "[1]"}', False, 0.8334, "truncated", "scalar_other,sequence"),
]


def _asked(spark, sf_dir: str, cases: list[tuple]) -> DataFrame:
    """answer_id, expected, predicted of every order."""
    known = spark.createDataFrame([(k, e, p) for k, (e, p, *_) in enumerate(cases)], "k long, expected string, predicted string")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), (F.col("o_orderkey") % len(cases)).alias("k"))
    asked = lambda c: F.replace(c, F.lit("@"), F.col("answer_id").cast("string")).alias(c)
    return orders.join(F.broadcast(known), "k").select("answer_id", asked("expected"), asked("predicted"))


def _told(cases: list[tuple], names: str) -> str:
    text = lambda v: "NULL" if v is None else json.dumps(v) if isinstance(v, (bool, float)) else "'" + v + "'"
    rows = ", ".join(f"({k}, {', '.join(map(text, rest))})" for k, (_, _, *rest) in enumerate(cases))
    return f"SELECT o_orderkey AS answer_id, {names} FROM orders JOIN (VALUES {rows}) AS t(k, {names}) ON k = o_orderkey % {len(cases)}"


QUERIES = {
    "sc9_verdicts": (lambda s, d: an.verdicts(_asked(s, d, VERDICTS)), _told(VERDICTS, "correct, path, kind")),
    "sc24_answer_scores": (lambda s, d: an.answer_scores(_asked(s, d, SCORES)), _told(SCORES, "correct, score, label, shapes")),
    "sc15_element_overlap": (
        lambda s, d: an.field_scores(an.answer_fields(_asked(s, d, SCORES[20:22]))).select("answer_id", "precision", "recall", "prefix", F.round("similarity", 4).alias("similarity")),
        """SELECT o_orderkey AS answer_id, CASE o_orderkey % 2 WHEN 0 THEN 1.0 ELSE 2 / 3 END AS precision, CASE o_orderkey % 2 WHEN 0 THEN 1.0 ELSE 2 / 3 END AS recall,
 CASE o_orderkey % 2 WHEN 0 THEN 2 ELSE 2 END AS prefix, CASE o_orderkey % 2 WHEN 0 THEN 1.0 ELSE 0.6667 END AS similarity FROM orders"""),
}

"""Queries over expected and predicted elements with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compare as cmp
from ..operators import scoring as sc
from ..operators.conformity import conformity
from ..sources.fixtures import base_items, expected_elements, instances, predicted_elements, table, with_views

_EP = "expected_elements predicted_elements"
_OVERLAP = """ec AS (SELECT answer_id, token, count(*) AS e FROM expected_elements GROUP BY ALL),
 pc AS (SELECT answer_id, token, count(*) AS p FROM predicted_elements GROUP BY ALL),
 ov AS (SELECT answer_id, sum(coalesce(e, 0)) AS expected, sum(coalesce(p, 0)) AS predicted, sum(least(coalesce(e, 0), coalesce(p, 0))) AS hits FROM ec FULL JOIN pc USING (answer_id, token) GROUP BY 1),
 pr AS (SELECT *, CASE WHEN predicted = 0 AND expected = 0 THEN 1 WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
  CASE WHEN predicted = 0 AND expected = 0 THEN 1 WHEN expected = 0 THEN 0 ELSE hits / expected END AS recall FROM ov)"""
_F1 = "CASE WHEN {p} + {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END"
_LABEL = "CASE WHEN {p} = 1 AND {r} = 1 THEN 'correct' WHEN {p} = 1 THEN 'missing_elements' WHEN {r} = 1 THEN 'extra_elements' ELSE 'wrong_elements' END"
_PREFIX = """px AS (SELECT answer_id, count(e.token) AS n_expected, count(p.token) AS n_predicted,
  min(CASE WHEN coalesce(e.token = p.token, false) THEN NULL ELSE pos END) AS fst FROM expected_elements e FULL JOIN predicted_elements p USING (answer_id, pos) GROUP BY 1),
 pf AS (SELECT answer_id, n_expected, n_predicted, coalesce(fst - 1, least(n_expected, n_predicted)) AS prefix FROM px)"""
_KEYED = """kt AS (SELECT answer_id, token, measure, row_number() OVER (PARTITION BY answer_id, token ORDER BY pos) AS turn FROM expected_elements),
 kp AS (SELECT answer_id, token, measure, row_number() OVER (PARTITION BY answer_id, token ORDER BY pos) AS turn FROM predicted_elements),
 kb AS (SELECT answer_id, kt.measure AS e, kp.measure AS p FROM kt FULL JOIN kp USING (answer_id, token, turn)),
 ka AS (SELECT answer_id, count(e) AS expected, count(p) AS predicted, count(*) FILTER (e IS NOT NULL AND p IS NOT NULL) AS pairs,
  count(*) FILTER (abs(e - p) <= greatest(1e-6 * greatest(abs(e), abs(p)), 1e-6)) AS rgt,
  sum(CASE WHEN e IS NULL OR p IS NULL THEN 0 WHEN abs(e - p) <= greatest(1e-6 * greatest(abs(e), abs(p)), 1e-6) THEN 1 ELSE 0.5 END) AS credit,
  median(abs(p - e) / greatest(abs(e), 1)) AS median_error, max(abs(p - e) / greatest(abs(e), 1)) AS max_error FROM kb GROUP BY 1)"""


def _sides(s, d):
    return expected_elements(s, d), predicted_elements(s, d)


def _names(s, d):
    """Pairs of differently written paths from the parts."""
    return table(s, d, "part").select(
        "p_partkey", F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/m.py")).alias("expected"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("./src//"), F.lower("p_brand"), F.lit("/m.py")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("src."), F.lower("p_brand"), F.lit(".m")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lower("p_brand"), F.lit("/m.py")))
        .otherwise(F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/n.py"))).alias("predicted"))


def _docs(s, d, shift: int = 0):
    """JSON answers of orders: quantities by line."""
    items = base_items(s, d).withColumn("q", F.col("l_quantity").cast("int") + F.when(F.col("l_suppkey") % 9 == 0, shift).otherwise(0))
    return items.groupBy("answer_id").agg(F.to_json(F.struct(
        F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("pos", "q"))).alias("rows"))).alias("doc"))


def _fields(s, d):
    e, p = _sides(s, d)
    one = sc.set_scores(e, p).select("answer_id", "score", "label")
    two = sc.sequence_labels(e, p).select("answer_id", F.col("prefix_ratio").alias("score"), "label")
    return one.union(two)


TEMPLATE = '{"items":[{"file":"str","lines":["int"]}],"by":{"<name>":{"n":"int"}},"note":"str","opt":{"x":"int"}}'
#: Answers of eight shapes; the same expression in both engines.
_SHAPES = """CASE o_orderkey % 8 WHEN 0 THEN '{"items":[{"file":"a","lines":[1,2]},{"file":"b"}],"by":{"x":{"n":1},"y":{"n":"z"}},"note":{"any":[1]},"opt":{"x":1},"more":7}'
 WHEN 1 THEN '{"items":[]}' WHEN 2 THEN '{"items":{"file":"a"}}' WHEN 3 THEN '{"items":[{"file":"a","lines":[1]},{"lines":5}],"by":{}}' WHEN 4 THEN '{"items":[{"lines":[[1],{"a":1}]}],"by":{"x":[1],"y":3}}'
 WHEN 5 THEN '{"opt":3,"items":[1,{"lines":null}]}' WHEN 6 THEN '[]' ELSE concat('{"items":[{"file":', o_custkey, '}],"by":{"', o_orderstatus, '":{"n":[]}},"opt":{"x":{}}}') END"""


def _reply():
    """A model's reply: the bare answer, fenced, among others, with braces in text, or none."""
    turn = F.col("turn").cast("string")
    a = F.concat(F.lit('{"turn": '), turn, F.lit("}"))
    return F.when(F.col("turn") % 5 == 0, a).when(F.col("turn") % 5 == 1, F.concat(F.lit("so ```json\n"), a, F.lit('\n``` or ```json\n{"k": {"turn": -1}}\n```'))).when(
        F.col("turn") % 5 == 2, F.concat(F.lit("first "), a, F.lit(' then {"turn": -2} end'))).when(
        F.col("turn") % 5 == 3, F.concat(F.lit("a {b} "), F.lit('{"turn": '), turn, F.lit(', "s": "}{"} end'))).otherwise(F.lit("nothing {here}"))


QUERIES = {
    "sc3_number_equality": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", cmp.numbers_equal(F.col("o_totalprice"), F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 5) * 4e-7)).alias("same")),
        """SELECT o_orderkey, abs(o_totalprice - o_totalprice * (1 + (o_orderkey % 5) * 4e-7)) <= greatest(1e-6 * greatest(abs(o_totalprice), abs(o_totalprice * (1 + (o_orderkey % 5) * 4e-7))), 1e-6) AS same FROM orders"""),
    "sc4_string_equality": (
        lambda s, d: _names(s, d).select("p_partkey", cmp.strings_equal(F.col("expected"), F.col("predicted"), F.lit("path_file")).alias("same")),
        "SELECT p_partkey, p_partkey % 4 < 2 AS same FROM part"),
    "sc5_identifier_equality": (
        lambda s, d: _names(s, d).select("p_partkey", cmp.strings_equal(F.col("expected"), F.col("predicted"), F.lit("file")).alias("same")),
        "SELECT p_partkey, p_partkey % 4 < 3 AS same FROM part"),
    "sc6_condition_and_enum": (
        lambda s, d: table(s, d, "orders").select(
            "o_orderkey", cmp.strings_equal(F.concat(F.lit("if "), F.col("o_orderstatus"), F.lit(":")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("Z"), F.lit("condition")).alias("cond"),
            cmp.strings_equal(F.concat(F.lit("<Status."), F.lower("o_orderstatus"), F.lit(">")), F.col("o_orderstatus"), F.lit("status")).alias("enum")),
        "SELECT o_orderkey, o_orderkey % 2 = 0 AS cond, true AS enum FROM orders"),
    "sc7_alternatives": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", cmp.strings_equal(F.lit("F ||| O"), F.col("o_orderstatus"), F.lit("state")).alias("same")),
        "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS same FROM orders"),
    "sc1_payload": (
        lambda s, d: _docs(s, d).select("answer_id", F.length(cmp.answer_payload(F.concat(F.lit('{"answer": '), F.col("doc"), F.lit("}")))).cast("long").alias("n"), F.length("doc").cast("long").alias("whole")).where("n = whole").select("answer_id"),
        "SELECT DISTINCT l_orderkey AS answer_id FROM lineitem"),
    "sc2_leaves": (
        lambda s, d: sc.leaves(_docs(s, d)).groupBy("answer_id").agg(F.count("*").alias("n"), F.sum("nval").alias("total")),
        with_views("base_items", "SELECT answer_id, 2 * count(*) + 1 AS n, count(*) + sum(pos) + sum(CAST(floor(l_quantity) AS INT)) AS total FROM base_items GROUP BY 1")),
    "sc9_leaf_verdict": (
        lambda s, d: sc.leaf_verdict(sc.leaves(_docs(s, d)), sc.leaves(_docs(s, d, 1))),
        with_views("base_items", """SELECT answer_id, NOT bool_or(l_suppkey % 9 = 0) AS correct,
 'mismatch at $.rows[' || (min(pos) FILTER (l_suppkey % 9 = 0) - 1) || '].q' AS reason FROM base_items GROUP BY 1""")),
    "sc13_set_scores": (
        lambda s, d: sc.set_scores(*_sides(s, d)),
        with_views(_EP, f"WITH {_OVERLAP} SELECT answer_id, expected, predicted, hits, precision, recall, {_F1.format(p='precision', r='recall')} AS score, {_LABEL.format(p='precision', r='recall')} AS label FROM pr")),
    "sc14_multiset_overlap": (
        lambda s, d: sc.multiset_overlap(*_sides(s, d)),
        with_views(_EP, f"WITH {_OVERLAP} SELECT * FROM ov")),
    "sc15_unified_tokens": (
        lambda s, d: sc.multiset_overlap(expected_elements(s, d), sc.unify(*_sides(s, d), F.col("e_token").cast("int") == F.col("p_token").cast("int") - 1)),
        with_views(_EP, """WITH k AS (SELECT answer_id, token, min(pos) AS first FROM expected_elements GROUP BY ALL), pt AS (SELECT DISTINCT answer_id, token FROM predicted_elements),
 l AS (SELECT * FROM pt WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.answer_id = pt.answer_id AND k.token = pt.token)),
 m AS (SELECT l.answer_id, l.token, arg_min(f.token, f.first) AS u FROM l JOIN k AS f ON l.answer_id = f.answer_id AND CAST(f.token AS INT) = CAST(l.token AS INT) - 1 GROUP BY ALL),
 up AS (SELECT p.answer_id, coalesce(u, p.token) AS token FROM predicted_elements p LEFT JOIN m ON m.answer_id = p.answer_id AND m.token = p.token),
 ec AS (SELECT answer_id, token, count(*) AS e FROM expected_elements GROUP BY ALL), pc AS (SELECT answer_id, token, count(*) AS p FROM up GROUP BY ALL)
 SELECT answer_id, sum(coalesce(e, 0)) AS expected, sum(coalesce(p, 0)) AS predicted, sum(least(coalesce(e, 0), coalesce(p, 0))) AS hits FROM ec FULL JOIN pc USING (answer_id, token) GROUP BY 1""")),
    "sc16_prefix_lengths": (
        lambda s, d: sc.prefix_lengths(*_sides(s, d)),
        with_views(_EP, f"WITH {_PREFIX} SELECT * FROM pf")),
    "sc17_similarity": (lambda s, d: sc.similarities(*_sides(s, d)), None),
    "sc18_sequence_labels": (
        lambda s, d: sc.sequence_labels(*_sides(s, d)).select("answer_id", "prefix", "label", "bag_f1", "prefix_ratio"),
        with_views(_EP, f"""WITH {_OVERLAP}, {_PREFIX} SELECT answer_id, prefix, {_F1.format(p='precision', r='recall')} AS bag_f1, CASE WHEN n_expected = 0 THEN 1 ELSE prefix / n_expected END AS prefix_ratio,
 CASE WHEN prefix = n_expected AND n_expected = n_predicted THEN 'correct' WHEN prefix = n_predicted AND n_predicted < n_expected THEN 'truncated' WHEN hits = n_expected AND n_expected = n_predicted THEN 'order_only' ELSE 'diverged' END AS label
 FROM pf JOIN pr USING (answer_id)""")),
    "sc20_keyed_records": (
        lambda s, d: sc.keyed_record_scores(*_sides(s, d)),
        with_views(_EP, f"""WITH {_KEYED}, kr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE credit / predicted END AS cp, CASE WHEN expected = 0 THEN 0 ELSE credit / expected END AS cr,
  CASE WHEN predicted = 0 THEN 0 ELSE pairs / predicted END AS ip, CASE WHEN expected = 0 THEN 0 ELSE pairs / expected END AS ir FROM ka)
 SELECT answer_id, {_F1.format(p='cp', r='cr')} AS score, CASE WHEN pairs > 0 THEN rgt / pairs END AS value_accuracy, median_error, max_error,
 CASE WHEN ip = 1 AND ir = 1 THEN CASE WHEN rgt = pairs THEN 'correct' ELSE 'counts_wrong' END ELSE {_LABEL.format(p='ip', r='ir')} END AS label FROM kr""")),
    "sc21_scalar_credit": (
        lambda s, d: instances(s, d).select("instance_id", cmp.scalar_credit(F.col("score"), F.when(F.col("instance_id") % 7 != 0, F.when(F.col("instance_id") % 5 == 0, F.col("score") + 1).when(F.col("instance_id") % 3 == 0, F.col("score2")).otherwise(F.col("score")))).alias("c")).select(
            "instance_id", "c.score", "c.label", "c.off_by_one"),
        with_views("instances", """WITH v AS (SELECT instance_id, score AS e, CASE WHEN instance_id % 7 <> 0 THEN CASE WHEN instance_id % 5 = 0 THEN score + 1 WHEN instance_id % 3 = 0 THEN score2 ELSE score END END AS p FROM instances),
 q AS (SELECT *, abs(e - p) <= greatest(1e-6 * greatest(abs(e), abs(p)), 1e-6) AS same FROM v)
 SELECT instance_id, CASE WHEN p IS NULL THEN 0 WHEN same THEN 1 ELSE greatest(0, 1 - abs(p - e) / greatest(abs(e), 1)) END AS score,
 CASE WHEN p IS NULL THEN 'invalid' WHEN same THEN 'correct' ELSE 'scalar_wrong' END AS label, p IS NOT NULL AND NOT same AND abs(p - e) = 1 AS off_by_one FROM q""")),
    "sc24_instance_scores": (
        lambda s, d: sc.fold_fields(_fields(s, d), expected_elements(s, d).select("answer_id").distinct().withColumn("correct", F.col("answer_id") % 11 == 0)),
        with_views(_EP, f"""WITH {_OVERLAP}, {_PREFIX}, lp AS (SELECT * FROM (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(sc.LABEL_PRIORITY))}) AS t(label, rk)),
 fl AS (SELECT answer_id, {_F1.format(p='precision', r='recall')} AS score, {_LABEL.format(p='precision', r='recall')} AS label FROM pr
  UNION ALL SELECT answer_id, CASE WHEN n_expected = 0 THEN 1 ELSE prefix / n_expected END, CASE WHEN prefix = n_expected AND n_expected = n_predicted THEN 'correct' WHEN prefix = n_predicted AND n_predicted < n_expected THEN 'truncated' WHEN hits = n_expected AND n_expected = n_predicted THEN 'order_only' ELSE 'diverged' END FROM pf JOIN pr USING (answer_id)),
 fo AS (SELECT answer_id, avg(score) AS mean, arg_min(label, rk) AS worst FROM fl JOIN lp USING (label) GROUP BY 1)
 SELECT answer_id, answer_id % 11 = 0 AS correct, CASE WHEN answer_id % 11 = 0 THEN 1 ELSE mean END AS score, CASE WHEN answer_id % 11 = 0 THEN 'correct' WHEN worst = 'correct' THEN 'format_only' ELSE worst END AS label FROM fo""")),
    "sc25_accuracy_buckets": (
        lambda s, d: sc.accuracy_buckets(
            table(s, d, "orders").where("o_orderkey % 10 <> 0").select("o_orderkey", "o_orderstatus"),
            table(s, d, "orders").where("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("answer")),
            F.col("answer").isNotNull(), F.col("answer").startswith("1"), ["o_orderkey"], ["o_orderstatus"]),
        """WITH o AS (SELECT o_orderkey, o_orderstatus, true AS o FROM orders WHERE o_orderkey % 10 <> 0), p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS answer, true AS p FROM orders WHERE o_orderkey % 7 <> 0)
 SELECT o_orderstatus, count(o) AS total, count(*) FILTER (o IS NULL) AS missing_oracle, count(*) FILTER (o AND p IS NULL) AS missing_prediction,
 count(*) FILTER (o AND p AND answer IS NULL) AS invalid_prediction, count(*) FILTER (o AND p AND starts_with(answer, '1')) AS correct FROM o FULL JOIN p USING (o_orderkey) GROUP BY 1"""),
    "sc26_conformity": (
        lambda s, d: conformity(table(s, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.lit(TEMPLATE).alias("template"), F.expr(_SHAPES).alias("doc"))).select("answer_id", "conforms", "errors"),
        f"""WITH d AS (SELECT o_orderkey AS answer_id, {_SHAPES} AS doc FROM orders), t AS (SELECT *, json_type(doc) AS r, json_type(doc, '$.items') AS i, json_type(doc, '$.by') AS b, json_type(doc, '$.opt') AS o FROM d),
 e AS (SELECT answer_id, CASE WHEN r <> 'OBJECT' THEN 1 ELSE CASE WHEN i IS NULL THEN 0 WHEN i <> 'ARRAY' THEN 1 ELSE len(list_filter(json_extract(doc, '$.items[*]'), lambda x: json_type(x) <> 'OBJECT' OR coalesce(json_type(x, '$.lines') <> 'ARRAY', false))) END
  + CASE WHEN b IS NULL THEN 0 WHEN b <> 'OBJECT' THEN 1 ELSE len(list_filter(json_extract(doc, '$.by.*'), lambda x: json_type(x) <> 'OBJECT')) END + CASE WHEN o IS NOT NULL AND o <> 'OBJECT' THEN 1 ELSE 0 END END AS errors FROM t)
 SELECT answer_id, errors = 0 AS conforms, errors FROM e"""),
    "sc27_final_json": (
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", sc.final_json(_reply()).alias("first"), sc.final_json(F.concat(_reply(), F.lit("\n## Answer\n"), _reply()), "reasoning").alias("last")),
        """WITH t AS (SELECT conv_id, turn, '{"turn": ' || turn || '}' AS a, '{"turn": ' || turn || ', "s": "}{"}' AS q FROM conversations)
 SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN q WHEN 4 THEN NULL ELSE a END AS first, CASE turn % 5 WHEN 0 THEN a WHEN 1 THEN '{"k": {"turn": -1}}' WHEN 2 THEN '{"turn": -2}' WHEN 3 THEN q END AS last FROM t"""),
}

import json
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import SF
from tracemill.functions import compare as c
from tracemill.operators import reports as rp
from tracemill.operators import scoring as sc
from tracemill.operators.statistics import answer_score
from tracemill.plans import all_queries


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_string_forms(spark):
    eq = lambda e, p, k: _one(spark, c.strings_equal(F.lit(e), F.lit(p), F.lit(k)))
    assert eq("a/b.py", "./a//b.py", "x")
    assert eq("pkg.mod.f", "f", "func") and not eq("pkg.mod.f", "other.f", "func")
    assert eq("<class 'a.C'>", "C", "cls")
    assert eq("if x > 1:", "x > 1", "condition")
    assert eq("<Status.OPEN>", "open", "status")
    assert eq("a ||| b", "b", "x") and not eq("b", "a ||| b", "x")
    assert not eq("a", "b", "x")


def test_payload_by_key_presence(spark):
    pick = lambda d: _one(spark, c.answer_payload(F.lit(json.dumps(d))))
    assert pick({"oracle_answer": {"a": 1}, "answer": 2}) == '{"a":1}'
    assert pick({"answer": [1]}) == "[1]"
    assert json.loads(pick({"x": 1})) == {"x": 1}


def test_leaves_and_verdict(spark):
    docs = lambda *d: spark.createDataFrame([(i, x) for i, x in enumerate(d)], "answer_id long, doc string")
    e = sc.leaves(docs('{"file": "a/b.py", "n": [1, 2]}', '{"n": 3}', "broken"))
    p = sc.leaves(docs('{"file": "b.py", "n": ["1", 2.0000001], "more": 1}', "{}", "{}"))
    got = {r.answer_id: (r.correct, r.reason) for r in sc.leaf_verdict(e, p).collect()}
    assert got == {0: (True, None), 1: (False, "missing $.n")}


tokens = st.lists(st.sampled_from("abc"), max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(tokens, tokens), min_size=1, max_size=6))
def test_f1_is_one_only_for_equal_multisets(spark, pairs):
    side = lambda k: spark.createDataFrame(
        [(i, j + 1, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair[k])], "answer_id long, pos long, token string")
    for r in sc.set_scores(side(0), side(1)).collect():
        a, b = pairs[r.answer_id]
        assert (r.score == 1) == (sorted(a) == sorted(b)) == (r.label == "correct")
    for r in sc.sequence_labels(side(0), side(1)).collect():
        a, b = pairs[r.answer_id]
        want = "correct" if a == b else "truncated" if a[: len(b)] == b else "order_only" if sorted(a) == sorted(b) else "diverged"
        assert r.label == want


def test_final_json(spark):
    texts = ['{"a": 1}', 'so\n```json\n{"b": 2}\n```\nend', 'x {"c": {"d": 3}} y', "none", None]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(sc.final_json("t").alias("x")).collect()]
    assert got == ['{"a": 1}', '{"b": 2}', '{"c": {"d": 3}}', None, None]


def test_overlap_stays_where_the_answers_are_dealt(spark):
    from tracemill.sources.dealt import dealt

    item = "answer_id long, token string"
    e = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "a"), (2, "b")], item)
    p = spark.createDataFrame([(1, "a"), (1, None), (None, "a"), (3, "b"), (3, "b")], item)
    got = sc.multiset_overlap(dealt(e, "answer_id", each=1), dealt(p, "answer_id", each=1))
    assert {tuple(r) for r in got.collect()} == {(1, 3, 2, 1), (None, 1, 1, 0), (2, 1, 0, 0), (3, 0, 2, 0)}
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2  # one a side


def test_answer_score_has_all_its_parts(spark):
    """Values of all levels count; characters only of strings, digits only of numbers, no leaf is an empty container."""
    docs = ['{"a.b[0]": [{"x": "\u00e9\\ud83d\\ude00z"}, [2, -3.50]], "c": {"d": []}, "e": null, "f": [true]}', "{}", "[]", "-12", "null", '"7"', "[[1e22], [1, 2, 3]]", "broken", None,
            "[" * 600 + '"deep"' + "]" * 600, json.dumps({"k": "x" * 100_000, "n": list(range(5000))})]
    columns = ("leaves", "fields", "lists", "elements", "longest_list", "depth", "characters", "digits")
    want = {0: (5, 6, 4, 5, 2, 4, 3, 4), 1: (0, 0, 0, 0, 0, 1, 0, 0), 2: (0, 0, 1, 0, 0, 1, 0, 0), 3: (1, 0, 0, 0, 0, 1, 0, 2), 4: (1, 0, 0, 0, 0, 1, 0, 0), 5: (1, 0, 0, 0, 0, 1, 1, 0),
            6: (4, 0, 3, 6, 3, 3, 0, 8), 9: (1, 0, 600, 600, 1, 601, 4, 0), 10: (5001, 2, 1, 5000, 5000, 3, 100_000, 18_890)}
    found = rp.construction_statistics(sc.values(spark.createDataFrame(list(enumerate(docs)), "answer_id long, doc string")))
    rows = found.select("*", answer_score(*[F.col(k) for k in ("leaves", "elements", "depth", "characters", "digits")]).alias("score")).collect()
    assert {r.answer_id: tuple(r[k] for k in columns) for r in rows} == want
    for r in rows:
        units = ((r.leaves, 35), (r.elements, 30), (r.depth - 1, 3), (r.characters + r.digits, 180))
        assert r.score == round(math.fsum(round(10 * (1 - math.exp(-n / scale)), 3) for n, scale in units) / 4, 3), r


def test_answer_score_of_the_query_counts_digits(spark):
    """Answers of as many lines differ by what their numbers are written with, and the depth begins at the whole."""
    found = all_queries()["st13_answer_score"][0](spark, SF).collect()
    lines = {r.l_orderkey: (r.n, r.digits) for r in spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sum(F.length(F.col("l_quantity").cast("int").cast("string"))).alias("digits")).collect()}
    assert len(found) == len(lines)
    for r in found:
        n, digits = lines[r.answer_id]
        digits += len(str(n)) + sum(len(str(i + 1)) for i in range(n))
        parts = [round(10 * (1 - math.exp(-x / scale)), 3) for x, scale in ((2 * n + 1, 35), (n, 30), (3, 3), (digits, 180))]
        assert r.score == round(math.fsum(parts) / 4, 3), r

from pyspark.sql import functions as F

from tracemill.operators import evidence as ev
from tracemill.operators import ranking as rk
from tracemill.operators import statistics as st
from tracemill.sources import artifacts
from tracemill.operators import source_code as so


def test_quartiles_of_four(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)], "id int, score double")
    cut = rk.cutoffs(rows, []).first()
    assert (cut.q25, cut.q50, cut.q75) == (1.75, 2.5, 3.25)
    labels = [r.label for r in rk.quantile_labels(rows, []).orderBy("id").collect()]
    assert labels == ["easy", "medium", "hard", "very_hard"]
    assert rk.quantile_labels(rows.limit(1), []).first().label == "medium"


def test_rank_of_one_row(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 2.0)], "m string, v double")
    got = {(r.m, r.v): r.rank10 for r in rk.percentile_ranks(rows, ["m"], "v").collect()}
    assert got == {("a", 1.0): 5.0, ("b", 1.0): 0.0, ("b", 2.0): 7.5}


def test_effort_of_frequent_and_rare_values(spark, monkeypatch):
    monkeypatch.setattr(rk, "FREQUENT", 4, raising=False)
    rows = [(i, "ab"[i % 2], float(i), 1.0 if i % 3 else float(-i)) for i in range(40)] + [(40, "a", 1.0, None), (41, None, 1.0, 1.0)]
    data = spark.createDataFrame(rows, "k int, m string, x double, y double")
    effort = rk.weighted_effort(data, "m", {"x": 0.25, "y": 0.75}, "k")
    assert not effort._jdf.queryExecution().executedPlan().toString().count("Join")  # written, so labels do not rank anew
    want = {}
    for k, m, x, y in rows[:40]:
        group = [r for r in rows if r[1] == m]
        ranks = []
        for v, all_v in ((x, [r[2] for r in group]), (y, [-1e9 if r[3] is None else r[3] for r in group])):
            ranks.append(round(10 * (sum(o < v for o in all_v) + (all_v.count(v) - 1) / 2) / (len(group) - 1), 3))
        want[k] = 0.25 * ranks[0] + 0.75 * ranks[1]
    got = {r.k: r.effort for r in effort.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.00051 for k in want)


def test_kappa_of_equal_labels(spark):
    rows = spark.createDataFrame([(x, x) for x in ["easy", "hard", "medium", "easy"]], "a string, b string")
    row = st.agreement(rows).first()
    assert row.exact == 1 and row.kappa == 1


def test_ridge_recovers_a_line(spark):
    rows = spark.range(200).select(F.col("id").alias("f"), (F.log1p("id") * 2 + 1).alias("y"), F.lit("g").alias("g"), (F.col("id") % 4).alias("fold"))
    got = {r.alpha: r.rho for r in st.choose_alpha(rows, ["f"], "g", "y", "fold", [0.01]).collect()}
    assert got[0.01] > 0.999


def test_ladder(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, True), (2, 2, True)], "instance_id int, level int, passed boolean")
    got = {r.instance_id: (r.depth, r.first_failed, r.monotone) for r in ev.ladder(rows).collect()}
    assert got == {1: (1, 2, False), 2: (2, None, True)}


def test_downgrade_is_idempotent(spark):
    rows = spark.createDataFrame([(1, 1, "data", "X = 3", 1, 2, "essential"), (1, 2, "logic", "X = 3", 1, 2, "essential")],
                                 "instance_id int, range_id int, role string, code string, start_line int, end_line int, necessity string")
    names = spark.createDataFrame([(1, "X")], "instance_id int, name string")
    once = ev.downgraded(rows, names)
    assert sorted(map(str, once.collect())) == sorted(map(str, ev.downgraded(once, names).collect()))
    assert {r.range_id: r.necessity for r in once.collect()} == {1: "supporting", 2: "essential"}


def test_read_files(spark, tmp_path):
    run = tmp_path / "run_1" / "validation" / "solver_agent" / "a" / "m" / "i1" / "rollout_2"
    run.mkdir(parents=True)
    (run / "answer.json").write_text('{"x": 1}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "t.log").write_text("2026-01-01 00:00:00.000 /a.py:3 f event=line locals={'i': '0'}\n")
    docs = artifacts.read_json(spark, str(tmp_path), "null")
    assert {r.doc for r in docs.collect()} == {'{"x": 1}', "null"}
    row = artifacts.answer_keys(docs).first()
    assert (row.layout, row.scope, row.instance_id, row.rollout) == ("validation", "a/m", "i1", 2)
    assert artifacts.read_traces(spark, str(tmp_path)).first().locals == {"i": "0"}


def test_functions_of_a_file(spark):
    code = "class A:\n    def run(self, x):\n" + "        x += 1\n" * 8 + "        return x\n    def __init__(self):\n" + "        pass\n" * 9
    rows = so.functions(spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.py", None)], "path string, text string")).collect()
    assert [(r.qualname, r.assigns, r.augassigns, r.returns) for r in rows] == [("A.run", 0, 8, 1)]  # each kind for itself

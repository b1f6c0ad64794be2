"""How the work of queries is dealt: what is sent to all tasks, and over how many tasks rows go."""

from pyspark.sql import functions as F

from tests.compare import SF
from tracemill.operators import calltree as ct
from tracemill.operators import evidence as ev
from tracemill.operators import joins as jn
from tracemill.operators import reports as rp
from tracemill.operators import scoring as sc
from tracemill.operators import source_code as so
from tracemill.operators.conformity import conformity
from tracemill.sources.dealt import dealt
from tracemill.streaming.accumulate import accumulate


def _plan(df):
    """The plan as it was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_models_are_never_broadcast(spark):
    models = spark.range(2000).select(F.concat(F.lit("big-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("model"))
    prices = spark.createDataFrame([("big", 3.0)], "name string, input double")
    found = jn.price_lookup(models, prices, spark.createDataFrame([("nick", "big")], "name string, target string"))
    plan = _plan(found)
    assert found.where("priced_as = 'big' and input = 3.0").count() == 2000
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan


def test_conformity_sends_no_answers_to_all_tasks(spark):
    """Level by level, however small the packed files look."""
    answers = spark.range(300).select(F.col("id").alias("answer_id"), F.lit('{"a":[{"b":"int"}]}').alias("template"), F.when(F.col("id") % 3 == 0, '{"a":[{"b":1},2]}').otherwise('{"a":[]}').alias("doc")).coalesce(1)
    found = conformity(answers)
    assert "Broadcast" not in _plan(found)
    assert found.where("not conforms and errors = 1").count() == 100 and found.where("conforms").count() == 200


def test_code_of_one_file_goes_to_all_tasks(spark):
    """One partition of many sources is parsed by as many tasks as there are cores at least, by more if they are many."""
    one = spark.range(400).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("path"), F.lit("import os\nfor x in y:\n    z: int = f(x)\n").alias("text")).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    for found in (so.test_features(one), so.functions(one, least=1)):
        assert found.rdd.getNumPartitions() >= cores
    assert ev.docstring_lines(one.withColumnRenamed("path", "file")).rdd.getNumPartitions() >= cores
    assert so.test_features(one).select("source_lines", "imports", "calls").distinct().collect() == [(3, 1, 1)]
    assert dealt(one, each=10).rdd.getNumPartitions() == 40


def test_metrics_in_one_pass(spark):
    """Counts of a body, without those of inner functions; functions inside statements are known."""
    text = "def f(a, b):\n    x: int\n    y: int = 1\n    z = y\n    z += g(a)\n    try:\n        while a:\n            for i in b:\n                break\n    except ValueError:\n        raise\n    finally:\n        h()\n    def g(q):\n        return q\n    return x and y\nif f:\n    def h():\n        'doc'\n        return 1\n"
    row = so.functions(spark.createDataFrame([("m", text)], "path string, text string"), least=4).where("qualname = 'f'").first()
    want = {"loops": 2, "while_loops": 1, "max_loop_nesting": 2, "excepts": 1, "finallys": 1, "raises": 1, "calls": 2, "num_local_calls": 2, "assigns": 2, "augassigns": 1, "returns": 1, "boolops": 1, "breaks_continues": 1, "n_params": 2}
    assert {k: row[k] for k in want} == want and row.local_calls == ["g", "h"]
    docs = ev.docstring_lines(spark.createDataFrame([("m", text), ("n", "x = 1")], "file string, text string")).collect()
    assert [tuple(x) for x in docs] == [("m", 19)]


def test_items_are_dealt_by_their_number(spark, monkeypatch):
    """The window over answers keeps as many tasks as the rows ask for."""
    from tracemill.sources import fixtures

    monkeypatch.setattr(fixtures, "dealt", lambda rows, *keys: dealt(rows, *keys, each=500))
    items = fixtures.base_items(spark, SF)
    assert items.rdd.getNumPartitions() == -(-items.count() // 500) > spark.sparkContext.defaultParallelism


def test_answers_are_taken_apart_once(spark):
    docs = [(1, '{"a":[{"b":"x1"},[2,3]],"c":{"d":[]},"e":null}'), (2, "[[1],[2.5],true]"), (3, "7"), (4, "{broken"), (5, '{"k[":1}')]
    found = rp.answer_statistics(sc.leaves(spark.createDataFrame(docs, "answer_id long, doc string")))
    assert _plan(found).split("Initial Plan")[0].count("MapInArrow") == 1
    got = {x.answer_id: (x.leaves, x.fields, x.depth, x.characters, x.digits, x.lists, x.elements, x.longest_list) for x in found.collect()}
    assert got == {1: (5, 3, 3, 10, 3, 1, 2, 2), 2: (3, 1, 2, 8, 3, 1, 3, 3), 3: (1, 1, 0, 1, 1, 0, 0, 0), 5: (1, 1, 2, 1, 1, 1, 1, 1)}


def test_runs_are_not_one_task(spark, monkeypatch):
    """Each run comes in as many files as it has tasks, and is one batch of the table."""
    from tracemill.plans import corpus_queries as cq

    made = []
    monkeypatch.setattr(cq, "accumulate", lambda source, *rest: made.append(accumulate(source, *rest)) or made[-1])
    found = cq.QUERIES["in1_accumulated"][0](spark, SF)
    assert found.count() > 0
    assert len(made) == 3 and made[-1].log().where("batch >= 0").count() == 3
    files = spark.read.parquet(made[-1].path.removesuffix("/table") + "/in").inputFiles()
    assert len(files) > 3


def test_activations_in_one_stream(spark):
    """Chunks of traces go through a task one after the other, with no group of their own."""
    events = spark.range(3000).select((F.col("id") % 50).alias("trace_id"), F.col("id").alias("seq"), F.concat(F.lit("f"), (F.col("id") % 7 % 3).cast("string")).alias("func"),
                                      F.when(F.col("id") % 5 == 0, "call").when(F.col("id") % 5 == 3, "return").otherwise("line").alias("event"))
    whole, cut = (ct.activations(events, chunk=c, fan=3) for c in (1000, 7))
    got = [sorted(map(tuple, x.collect()), key=str) for x in (whole, cut)]
    assert got[0] == got[1] and len(got[0]) > 500
    assert ct.activations(events.limit(0)).count() == 0

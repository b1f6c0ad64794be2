"""Queries of screening, joins, incremental state, trajectories, evidence, checkpoints and perturbation with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calltree as ct
from ..operators import checkpoints as ck
from ..operators import evidence as ev
from ..operators import incremental as inc
from ..operators import joins as jn
from ..operators import ranking as rk
from ..operators import scoring as sc
from ..operators import screening as sr
from ..operators import trajectory as tj
from ..operators.trace import event_statistics
from ..sources.fixtures import call_edges, expected_elements, instances, line_ranges, rollouts, seen_ranges, table, trace_events, verdicts, with_views
from ..sources.shared import shared_path, written
from ..streaming.accumulate import accumulate
from .report_queries import ATTEMPTS_SQL, attempts
from .scoring_queries import _docs

_LS = "line_ranges seen_ranges"
_REQ = """sl AS (SELECT DISTINCT instance_id, 'src/' || file AS file, unnest(range(start_line, end_line + 1)) AS line, 1 AS s FROM seen_ranges),
 rl AS (SELECT DISTINCT instance_id, file, range_id, necessity, unnest(range(start_line, end_line + 1)) AS line FROM line_ranges)"""
_LADDER = """cp AS (SELECT answer_id AS instance_id, pos AS level, CASE WHEN token = '3' THEN 0.0 ELSE 1.0 END AS score FROM expected_elements),
 lv AS (SELECT instance_id, level, bool_and(score = 1) AS passed, avg(score) AS mean_score FROM cp GROUP BY ALL),
 nm AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY level) AS o FROM lv),
 la AS (SELECT instance_id, count(*) AS levels, min(o) FILTER (NOT passed) AS f, min(level) FILTER (NOT passed) AS first_failed, max(o) FILTER (passed) AS p FROM nm GROUP BY 1),
 ladder AS (SELECT instance_id, levels, coalesce(f - 1, levels) AS depth, first_failed, f IS NULL OR p IS NULL OR p < f AS monotone FROM la)"""


def _rules():
    return {
        "long_enough": lambda: (F.col("n_chars") >= 500, F.concat(F.lit("chars "), F.col("n_chars").cast("string"))),
        "english": lambda: (F.col("lang") == "en", F.col("lang")),
        "no_rights": lambda: (~F.col("text").contains("All rights reserved"), F.lit("reserved")),
    }


def _screened(s, d):
    return sr.apply_rules(table(s, d, "documents"), _rules(), "doc_id")


def _logs(s, d):
    return table(s, d, "orders").select("o_orderkey", F.concat(
        F.lit("collected\n= "), (F.col("o_orderkey") % 9).cast("string"), F.lit(" passed"), F.when(F.col("o_orderkey") % 4 == 0, ", 1 failed").otherwise(""), F.lit(" in 1s =\n"),
        F.when(F.col("o_orderkey") % 25 == 0, "== FAILURES ==").otherwise("")).alias("log"))


def _commands(s, d):
    shell = F.when(F.col("l_suppkey") % 6 == 0, "python -m pytest tests/ -q").when(F.col("l_suppkey") % 6 == 1, "grep -rn foo src").when(F.col("l_suppkey") % 6 == 2, F.concat(F.lit("cat src/"), F.col("l_partkey").cast("string"), F.lit(".py"))).when(
        F.col("l_suppkey") % 6 == 3, "ls -la").when(F.col("l_suppkey") % 6 == 4, "echo x > answer.json").when(F.col("l_partkey") % 3 == 0, "pip install pkg; mv a b").when(
        F.col("l_partkey") % 3 == 1, "python trace_all.py --Coverage | head").otherwise("make all")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("rollout_id"), shell.alias("command"))


def _required(s, d):
    return line_ranges(s, d)


def _seen(s, d):
    return ev.seen_lines(line_ranges(s, d), seen_ranges(s, d))


def _executed(s, d):
    return line_ranges(s, d).where("range_id % 2 = 0").select("instance_id", "file", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()


def _levels(s, d):
    return ev.level_results(expected_elements(s, d).select(F.col("answer_id").alias("instance_id"), F.col("pos").alias("level"), F.when(F.col("token") == "3", 0.0).otherwise(1.0).alias("score")))


def _usage(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("rollout_id"), F.col("l_partkey").alias("input_tokens"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey")).alias("cache_creation"),
                                          (F.col("l_linenumber") * 10).alias("cache_read"), F.col("l_suppkey").alias("output_tokens"), F.col("l_tax").cast("double").alias("cost"))


_REASONS = """CASE tokens % 9 WHEN 0 THEN 'Session LIMIT reached' WHEN 1 THEN 'your weekly limit' WHEN 2 THEN 'Too Many Requests' WHEN 3 THEN 'Invalid API key' WHEN 4 THEN 'rate_limit_event seen'
 WHEN 5 THEN 'no valid JSON in the reply' WHEN 6 THEN 'answer mismatch' WHEN 8 THEN 'usage limit reached' END"""
_PATHS = """CASE p_partkey % 12 WHEN 0 THEN '/testbed/validation_answers/x/answer.json' WHEN 1 THEN '/w/validation_answers/x/try.py' WHEN 2 THEN '/x/qa_instances_eval/1/question.json' WHEN 3 THEN '/x/qa_instances_eval/1/files/t.py'
 WHEN 4 THEN '/x/qa_instances_eval/1/README' WHEN 5 THEN '/testbed/help.PY' WHEN 6 THEN '/testbed/pkg/tests/test_a.py' WHEN 7 THEN '/testbed/pkg/answer.txt' WHEN 8 THEN '/usr/lib/x.Go' WHEN 9 THEN '/v/validation_answers/q/answer.json/ ' WHEN 10 THEN 'answer.json' ELSE '/testbed/a/b.tsx' END"""
_WRITES = """CASE l_suppkey % 7 WHEN 0 THEN 'echo x > /testbed/validation_answers/a/answer.json' WHEN 1 THEN 'python -c "json.dump(x, open(p))" /testbed/validation_answers/q/answer.json' WHEN 2 THEN 'cat a | tee -a /testbed/log.txt >> "/testbed/b.txt"'
 WHEN 3 THEN 'echo > /tmp/x' WHEN 4 THEN 'cp a /validation_answers/b/answer.json' WHEN 6 THEN 'ls > /testbed/c; cat /validation_answers/z' END"""
_RESULT = """CASE l_suppkey % 4 WHEN 0 THEN concat('{"modelUsage":{"a":{"inputTokens":', l_partkey, ',"outputTokens":', l_suppkey, ',"costUSD":0.5},"b":{"inputTokens":7,"cacheCreationInputTokens":2,"cacheReadInputTokens":1,"costUSD":0.25}},"usage":{"input_tokens":999},"total_cost_usd":9}')
 WHEN 1 THEN concat('{"modelUsage":{},"usage":{"input_tokens":', l_partkey, ',"output_tokens":3,"cache_creation_input_tokens":', l_suppkey, '},"total_cost_usd":0.5}') WHEN 2 THEN concat('{"usage":{"input_tokens":', l_partkey, '},"total_cost_usd":0.25}') ELSE '{"type":"result"}' END"""
_MODULES = """CASE p_partkey % 4 WHEN 0 THEN '\"\"\"Module doc.\\n\\nmore\"\"\"\\n\\nx = 1\\n# c\\n\\ndef f():\\n    \"\"\"doc\"\"\"\\n    return x\\n' WHEN 1 THEN 'class A:\\n    \"\"\"a\\n    b\\n    \"\"\"\\n    y = 1\\n'
 WHEN 2 THEN 'def broken(:\\n    \"\"\"no docstring\"\"\"\\n# c\\n' ELSE repeat('x = 1\\n', p_size) END"""
_FUN = """fl AS (SELECT DISTINCT instance_id, file, range_id, CASE range_id % 5 WHEN 0 THEN 'upstream' WHEN 1 THEN 'target' WHEN 2 THEN 'direct' ELSE 'deeper' END AS class, line FROM rl),
 fn AS (SELECT instance_id, class, file, range_id, count(*) AS n, count(s) AS hit FROM fl LEFT JOIN sl USING (instance_id, file, line) GROUP BY ALL)"""
_COVER = """cover AS (SELECT instance_id, count(*) FILTER (class <> 'upstream') AS required_functions, coalesce(sum(n) FILTER (class <> 'upstream'), 0) AS required_lines, sum(hit) FILTER (class <> 'upstream') / sum(n) FILTER (class <> 'upstream') AS recall,
 count(*) FILTER (class <> 'upstream' AND hit = n) / nullif(count(*) FILTER (class <> 'upstream'), 0) AS function_recall,
 count(*) FILTER (class <> 'upstream') > 0 AND count(*) FILTER (class <> 'upstream' AND hit = n) = count(*) FILTER (class <> 'upstream') AS sufficient FROM fn GROUP BY 1)"""
_RECALL = """recall AS (SELECT instance_id, count(*) AS entries, count(*) FILTER (h >= 0.9 * n) AS read_entries, count(*) FILTER (h >= 0.9 * n) / count(*) AS recall,
 CASE WHEN count(*) FILTER (necessity = 'essential') > 0 THEN count(*) FILTER (h >= 0.9 * n AND necessity = 'essential') / count(*) FILTER (necessity = 'essential') END AS essential_recall,
 sum(n) AS lines, sum(h) AS lines_read, count(*) FILTER (h >= 0.9 * n) = count(*) AS complete,
 count(*) FILTER (necessity = 'essential') > 0 AND count(*) FILTER (h >= 0.9 * n AND necessity = 'essential') = count(*) FILTER (necessity = 'essential') AS essential_complete FROM e GROUP BY 1)"""
_FOLD = "CASE WHEN {0} BETWEEN 12 AND 15 THEN 12 WHEN {0} BETWEEN 10 AND 20 THEN 10 WHEN {0} BETWEEN 30 AND 31 THEN 30 WHEN {0} <= 45 THEN 1 ELSE {0} END"
_SCOPED = """si AS (SELECT DISTINCT instance_id, instance_id % 10 <> 0 AS ans, CASE WHEN instance_id % 4 <> 0 THEN instance_id % 4 = 1 END AS fc, CASE WHEN instance_id % 3 <> 0 THEN 'k' || instance_id % 3 END AS category FROM lv),
 sc AS (SELECT *, 'overall' AS scope, 'all' AS name FROM si WHERE ans UNION ALL SELECT *, 'final', CASE WHEN fc THEN 'correct' ELSE 'wrong' END FROM si WHERE ans AND fc IS NOT NULL UNION ALL SELECT *, 'category', coalesce(category, 'unknown') FROM si WHERE ans)"""
#: A forest of calls, a row of orders each; the caller is one of the three frames before.
_FRAMES_SQL = """SELECT trace_id, activation, CASE WHEN activation > 1 THEN activation - 1 - k % least(activation - 1, 3) END AS parent, func FROM (
 SELECT o_custkey % 40 AS trace_id, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS activation, o_orderkey % 5 AS k, 'g' || o_orderkey % 13 AS func FROM orders)"""


def _frames(s, d):
    table(s, d, "orders").createOrReplaceTempView("frame_orders")
    return s.sql(_FRAMES_SQL.replace("FROM orders", "FROM frame_orders"))


def _activation_depths(s, d):
    """Least depth of each function below f0, f3 being a library's, over the activations of all traces."""
    made = written(ct.activations(trace_events(s, d)), "frames")
    return ct.least_depths(made, F.col("func") == "f0", F.col("func") == "f3", ["trace_id", "func"])


def _functions(s, d):
    """Each line range as a function at a depth from -1 to 3."""
    return line_ranges(s, d).select("instance_id", "file", F.col("range_id").cast("string").alias("function"), (F.col("range_id") % 5 - 1).alias("depth"), F.explode(F.sequence("start_line", "end_line")).alias("line"))


def _answered(s, d, rows, condition, name):
    told = rows.withColumn("correct", F.expr("CASE WHEN instance_id % 4 <> 0 THEN instance_id % 3 = 0 END"))
    made = ev.correctness_table(told, condition)
    return made.select(F.lit(name).alias("condition"), *made.columns)


def _scored_reads(s, d):
    read = ev.required_recall(line_ranges(s, d), _seen(s, d)).select("instance_id", F.col("recall").alias("required"), "complete")
    return ev.coverage(_functions(s, d), _seen(s, d)).join(read, "instance_id", "left").withColumns({
        "correct": F.expr("CASE WHEN instance_id % 4 <> 0 THEN instance_id % 3 = 0 END"), "category": F.col("instance_id") % 3})


def _plans(s, d):
    """A plan, a manifest, known targets and prompts, one instance a part."""
    part = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("instance_id"), F.col("p_brand").alias("category"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("file"),
                                      F.concat(F.lit("q"), (F.col("p_partkey") % 4).cast("string")).alias("qualname"), "p_partkey", "p_size")
    four = ["instance_id", "category", "file", "qualname"]
    text = F.concat(F.lit("Look.\nStructural metrics of the target (from static analysis):\n  "), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('{"m": '), F.col("p_partkey").cast("string"), F.lit("}"))).otherwise("{broken}"), F.lit("\nGo."))
    targets = part.where("p_partkey % 4 = 1 and p_size % 3 <> 0").select("file", "qualname", F.concat(F.lit('{"t":'), F.col("p_size").cast("string"), F.lit("}")).alias("metrics"))
    return part.where("p_partkey % 4 = 0").select(*four, F.lit('{"p":1}').alias("metrics")), part.select(*four), targets, part.select("instance_id", text.alias("text"))


def _statements(s):
    """Nested statements of three functions."""
    ranges = [(1, 45, 1), (10, 20, 10), (12, 15, 12), (30, 31, 30)]
    return s.createDataFrame([(f"f{k}", *r) for k in range(3) for r in ranges], "func string, start_line int, end_line int, target int")


def _checkpoint_answers(s, d):
    """A checkpoint of each kind for every part, and its answers."""
    k, v = "p_partkey % 7", "p_partkey % 5"
    specs = table(s, d, "part").select(
        F.col("p_partkey").alias("instance_id"), F.lit("c").alias("checkpoint"), F.expr("concat('f', p_partkey % 3)").alias("func"), F.lit("path").alias("level"),
        F.expr(f"CASE {k} WHEN 1 THEN 'line' WHEN 2 THEN 'line_set' WHEN 3 THEN 'enum' WHEN 4 THEN 'name' WHEN 5 THEN 'value' ELSE 'int' END").alias("kind"),
        F.expr(f"CASE {k} WHEN 2 THEN '[1,10,12]' WHEN 3 THEN 'return' WHEN 4 THEN 'ValueError' WHEN 5 THEN '[1, (2, 3)]' ELSE CAST(p_size AS STRING) END").alias("expected"),
        F.expr(f"CASE {k} WHEN 0 THEN array(p_size, p_size + 1) WHEN 1 THEN array({_FOLD.format('p_size')}) WHEN 2 THEN array(1, 10, 12) END").alias("accept"))
    answer = f"""CASE {k} WHEN 0 THEN CASE {v} WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat('"', p_size + 1, '"') WHEN 2 THEN concat(p_size, '.0') ELSE 'true' END
 WHEN 1 THEN CAST(CASE WHEN {v} IN (1, 2) THEN p_size + 1 ELSE p_size END AS STRING) WHEN 2 THEN concat('[', p_size, ', ', p_size + 1, ', "30", 12.0, null, true]')
 WHEN 3 THEN CASE WHEN {v} < 2 THEN '" Return "' ELSE '"exception"' END WHEN 4 THEN CASE WHEN {v} < 3 THEN '"builtins.ValueError"' ELSE '"ValueError.x"' END
 WHEN 5 THEN CASE {v} WHEN 0 THEN '[1, [2, 3]]' WHEN 1 THEN '"[1, (2, 3.0000001)]"' WHEN 2 THEN '"(1, [2, 3])"' WHEN 3 THEN '[true, [2, 3]]' ELSE '"[1, (2, 3), 4]"' END ELSE CAST(p_size AS STRING) END"""
    answers = table(s, d, "part").where(f"NOT ({k} = 0 AND {v} = 4)").select(F.col("p_partkey").alias("instance_id"), F.lit("c").alias("checkpoint"), F.expr(answer).alias("answer"))
    return specs, answers, _statements(s), s.createDataFrame([(f"f{i}", 30) for i in range(3)], "func string, line int")


def _laddered(s, d):
    return _levels(s, d).select("instance_id").distinct().select(
        "instance_id", F.expr("CASE WHEN instance_id % 3 <> 0 THEN concat('k', instance_id % 3) END").alias("category"), (F.col("instance_id") % 10 != 0).alias("answered"),
        F.expr("CASE WHEN instance_id % 4 <> 0 THEN instance_id % 4 = 1 END").alias("final_correct"))


def _goals(s, d):
    """How many candidates meet each goal, with and without an increase of every metric."""
    pick = {"a": (5, 3), "b": (7, 2), "c": (3, 4), "combined": (11, 6)}
    rows = instances(s, d).select("instance_id", *[(F.col("instance_id") % k[0]).cast("double").alias(f"new_{m}") for m, k in pick.items() if m != "combined"], *[(F.col("instance_id") % k[1]).cast("double").alias(f"old_{m}") for m, k in pick.items()],
                                  F.when(F.col("instance_id") % 13 != 0, F.col("instance_id") % 11).cast("double").alias("new_combined"), F.expr("CASE instance_id % 5 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' WHEN 3 THEN 'very_hard' ELSE 'unknown' END").alias("label"))
    made = None
    for goal in ("none", "increased", *ev.GOALS):
        for every in (False, True):
            one = ev.score_deltas(rows, ["a", "b", "c"], goal, all_up=every).agg(F.count("*").alias("n"), F.count_if("target_met").alias("met"), F.sum("d_a").alias("d_a"))
            one = one.select(F.lit(goal).alias("goal"), F.lit(every).alias("every"), "n", "met", "d_a")
            made = one if made is None else made.union(one)
    return made


def _accumulated(s, d):
    """Verdicts that come run by run, each merged as what a stream of files has new; the last one has later runs of some and earlier ones of others."""
    at = shared_path(s, "runs")
    runs = written(verdicts(s, d), "verdicts")
    for k in (1, 2, 0):  # a run is as many files as it has tasks, and one batch
        runs.where(F.col("run_pos") % 3 == k).write.mode("append").parquet(f"{at}/in")
        table_now = accumulate(s.readStream.schema(runs.schema).parquet(f"{at}/in"), ["scope", "instance_id"], "run_pos", f"{at}/table")
    return table_now.read()


def _traced(s, d):
    """Traces with values, and what is known of their four functions."""
    x = F.coalesce(F.col("x").cast("string"), F.lit("..."))
    events = trace_events(s, d).withColumns({
        "retval": F.when(F.col("event") == "return", F.when(F.col("line") % 3 == 0, "None").otherwise(F.concat(F.lit("["), F.col("line").cast("string"), F.lit("]")))),
        "exc": F.when(F.col("event") == "exception", F.concat(F.lit("pkg.Error"), (F.col("line") % 2).cast("string"), F.lit(": text"))),
        "locals": F.when(F.col("event").isin("call", "return"), F.create_map(F.lit("x"), x, F.lit("y"), F.col("line").cast("string"), F.lit("z"), F.lit("<object at 0x1>")))})
    functions = s.createDataFrame([(f"f{k}", 8 + k, 8, ["x", "y"] if k % 2 else ["y"], k == 3) for k in range(4)], "func string, def_line int, start_line int, params array<string>, suspendable boolean")
    ranges = [(10, 29, 10), (14, 21, 14), (16, 17, 16), (24, 25, 24)]
    statements = s.createDataFrame([(f"f{k}", *r) for k in range(4) for r in ranges], "func string, start_line int, end_line int, target int")
    ignored = s.createDataFrame([(f"f{k}", 24) for k in range(4)], "func string, line int")
    loops = s.createDataFrame([(f"f{k}", 14, 16 + k) for k in range(4)] + [("f1", 24, 25)], "func string, line int, body_line int")
    return events, functions, statements, ignored, loops


QUERIES = {
    "sr2_test_passed": (
        lambda s, d: _logs(s, d).select("o_orderkey", sr.test_passed(F.col("log")).alias("ok")),
        "SELECT o_orderkey, o_orderkey % 4 <> 0 AND o_orderkey % 25 <> 0 AS ok FROM orders"),
    "sr4_answer_leak": (
        lambda s, d: sr.leak_rule(sr.distinctive_leaves(sc.leaves(_docs(s, d)), ["pos"]), table(s, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.concat_ws(" ", F.col("o_totalprice").cast("string"), "o_orderpriority", F.col("o_custkey").cast("string")).alias("text"))).select("answer_id", "n"),
        with_views("base_items", """SELECT answer_id, count(*) AS n FROM (SELECT DISTINCT answer_id, CAST(floor(l_quantity) AS INT) AS v FROM base_items WHERE floor(l_quantity) >= 10
 UNION SELECT answer_id, count(*) AS v FROM base_items GROUP BY 1 HAVING count(*) >= 10) GROUP BY 1""")),
    "sr5_trace_minima": (
        lambda s, d: sr.minimum_rule(event_statistics(trace_events(s, d)).withColumn("category", F.concat(F.lit("c"), (F.col("trace_id") % 3).cast("string"))),
                                     s.createDataFrame([("c0", 40, 15), ("c1", 30, 18), ("c2", 45, 12)], "category string, min_line_events int, min_lines int"), "category", ["line_events", "lines"]).select(
            "trace_id", "passed", F.array_join("short", ",").alias("short")),
        with_views("trace_events", """WITH t AS (SELECT trace_id, count(*) FILTER (event = 'line') AS le, count(DISTINCT line) AS ln, 'c' || (trace_id % 3) AS category FROM trace_events GROUP BY 1),
 m AS (SELECT * FROM t JOIN (VALUES ('c0', 40, 15), ('c1', 30, 18), ('c2', 45, 12)) AS v(category, a, b) USING (category))
 SELECT trace_id, le >= a AND ln >= b AS passed, concat_ws(',', CASE WHEN le < a THEN 'line_events' END, CASE WHEN ln < b THEN 'lines' END) AS short FROM m""")),
    "sr6_indirection": (
        lambda s, d: table(s, d, "part").select("p_partkey", sr.indirection(F.when(F.col("p_partkey") % 3 == 0, F.lit("x = run(1)")).when(F.col("p_partkey") % 3 == 1, F.lit("call_it (2)")).otherwise(F.lit("running()")), F.lit("run"), F.array(F.lit("call_it"))).alias("kind")),
        "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'semi_direct' ELSE 'indirect' END AS kind FROM part"),
    "sr7_test_counts": (
        lambda s, d: table(s, d, "part").select("p_partkey", sr.test_count_rule(F.repeat(F.lit("def test_x():\n  pass\n"), (F.col("p_size") % 20)), F.col("p_partkey") % 2 == 0).alias("ok")),
        "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size % 20 BETWEEN 10 AND 15 ELSE p_size % 20 = 1 END AS ok FROM part"),
    "sr8_verdicts": (
        lambda s, d: _screened(s, d).select("doc_id", "kept", F.array_join("failed", ",").alias("failed")),
        """SELECT doc_id, n_chars >= 500 AND lang = 'en' AND NOT contains(text, 'All rights reserved') AS kept,
 concat_ws(',', CASE WHEN n_chars < 500 THEN 'long_enough' END, CASE WHEN lang <> 'en' THEN 'english' END, CASE WHEN contains(text, 'All rights reserved') THEN 'no_rights' END) AS failed FROM documents"""),
    "sr8_rule_failures": (
        lambda s, d: sr.rule_failures(_screened(s, d)),
        """SELECT * FROM (SELECT 'long_enough' AS rule, count(*) FILTER (n_chars < 500) AS failures FROM documents UNION ALL SELECT 'english', count(*) FILTER (lang <> 'en') FROM documents
 UNION ALL SELECT 'no_rights', count(*) FILTER (contains(text, 'All rights reserved')) FROM documents) WHERE failures > 0"""),
    "sr9_infrastructure_causes": (
        lambda s, d: rollouts(s, d).withColumn("reason", F.expr(_REASONS)).groupBy(sr.infrastructure_cause(F.col("reason")).alias("cause"), sr.never_answered(F.col("reason")).alias("silent"), sr.refused(F.col("reason")).alias("refused")).agg(F.count("*").alias("n")),
        with_views("rollouts", """SELECT CASE WHEN tokens % 9 IN (0, 1, 8) THEN 'provider usage limit' WHEN tokens % 9 = 2 THEN 'provider rate limit' WHEN tokens % 9 = 3 THEN 'auth failure' END AS cause,
 tokens % 9 BETWEEN 2 AND 5 AS silent, tokens % 9 BETWEEN 2 AND 4 AS refused, count(*) AS n FROM rollouts GROUP BY ALL""")),
    "sr10_leak_free_files": (
        lambda s, d: sr.without_answers(table(s, d, "part").select("p_partkey", F.concat(F.lit("a/"), F.when(F.col("p_partkey") % 3 == 0, "oracle.json").when(F.col("p_partkey") % 3 == 1, "parser.py").otherwise("main.py")).alias("path"))),
        "SELECT p_partkey, 'a/main.py' AS path FROM part WHERE p_partkey % 3 = 2"),
    "sr11_normal_ranges": (
        lambda s, d: sr.normal_ranges(line_ranges(s, d).withColumn("role", F.lit(None).cast("string")), line_ranges(s, d).select("file").distinct().where("file not like '%#1%'").withColumn("n_lines", F.lit(30))).select("range_id", "dropped", "end_line", "role"),
        with_views("line_ranges", """SELECT range_id, CASE WHEN file LIKE '%#1%' THEN 'no such file' WHEN start_line < 1 THEN 'no start' WHEN start_line > 30 THEN 'beyond the file' END AS dropped,
 CASE WHEN file LIKE '%#1%' THEN end_line ELSE least(end_line, 30) END AS end_line, 'logic' AS role FROM line_ranges""")),
    "sr12_range_overlaps": (
        lambda s, d: sr.range_overlaps(line_ranges(s, d), ["instance_id", "file"], "range_id").select("range_id"),
        with_views("line_ranges", """SELECT range_id FROM (SELECT range_id, start_line, max(end_line) OVER (PARTITION BY instance_id, file ORDER BY start_line, range_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM line_ranges) WHERE start_line <= e""")),
    "sr12_unexecuted_runs": (
        lambda s, d: sr.unexecuted_runs(line_ranges(s, d), _seen(s, d), ["instance_id", "file"]),
        with_views(_LS, f"""WITH {_REQ}, m AS (SELECT range_id, line, s FROM rl LEFT JOIN sl USING (instance_id, file, line)),
 g AS (SELECT range_id, line - row_number() OVER (PARTITION BY range_id ORDER BY line) AS g FROM m WHERE s IS NULL), r AS (SELECT range_id, max(n) AS li FROM (SELECT range_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY 1)
 SELECT m.range_id, count(*) AS lines, count(s) AS executed, coalesce(any_value(li), 0) AS longest_idle FROM m LEFT JOIN r USING (range_id) GROUP BY 1""")),
    "sr12_range_warnings": (
        lambda s, d: sr.range_warnings(line_ranges(s, d).withColumn("role", F.when(F.col("range_id") % 4 == 0, "data").otherwise("callee")), _seen(s, d), 5),
        with_views(_LS, f"""WITH {_REQ}, m AS (SELECT range_id, line, s FROM rl LEFT JOIN sl USING (instance_id, file, line)),
 g AS (SELECT range_id, line - row_number() OVER (PARTITION BY range_id ORDER BY line) AS g FROM m WHERE s IS NULL), r AS (SELECT range_id, max(n) AS idle FROM (SELECT range_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY 1),
 k AS (SELECT m.range_id, count(s) AS ran, coalesce(any_value(idle), 0) AS idle FROM m LEFT JOIN r USING (range_id) GROUP BY 1)
 SELECT DISTINCT b.range_id, 'overlap' AS warning FROM rl a JOIN rl b ON a.instance_id = b.instance_id AND a.file = b.file AND a.line = b.line AND a.range_id < b.range_id
 UNION ALL SELECT range_id, CASE WHEN ran = 0 THEN 'not executed' ELSE 'long idle run' END FROM k WHERE CASE WHEN ran = 0 THEN range_id % 4 <> 0 ELSE idle >= 5 END""")),
    "sr12_missed_target_lines": (
        lambda s, d: sr.missed_target_lines(line_ranges(s, d).where("range_id % 2 = 0"), _functions(s, d)),
        with_views(_LS, f"""WITH {_REQ}, t AS (SELECT DISTINCT instance_id, file, line FROM rl WHERE range_id % 5 = 1), c AS (SELECT DISTINCT instance_id, file, line FROM rl WHERE range_id % 2 = 0)
 SELECT instance_id, count(*) AS missed, min(line) AS first_missed FROM t ANTI JOIN c USING (instance_id, file, line) GROUP BY 1""")),
    "jn1_oracle_with_answers": (
        lambda s, d: instances(s, d).select("instance_id", "repo").join(rollouts(s, d), "instance_id").groupBy("repo").agg(F.count("*").alias("n"), F.count_if("passed").alias("passes")),
        with_views("instances rollouts", "SELECT repo, count(*) AS n, count(*) FILTER (passed) AS passes FROM instances JOIN rollouts USING (instance_id) GROUP BY 1")),
    "jn2_validated": (
        lambda s, d: jn.validated(instances(s, d), verdicts(s, d), F.col("scope") == "s1").select("instance_id", "repo"),
        with_views("instances verdicts", "SELECT instance_id, repo FROM instances WHERE instance_id IN (SELECT instance_id FROM verdicts WHERE scope = 's1' AND passed)")),
    "jn5_not_rejected": (
        lambda s, d: instances(s, d).join(verdicts(s, d).where("not passed and run_pos = 1"), "instance_id", "left_anti").select("instance_id"),
        with_views("instances verdicts", "SELECT instance_id FROM instances WHERE instance_id NOT IN (SELECT instance_id FROM verdicts WHERE NOT passed AND run_pos = 1)")),
    "jn6_unreported": (
        lambda s, d: jn.unreported(rollouts(s, d).select("instance_id", "model").distinct(), verdicts(s, d).where("passed"), ["instance_id"]),
        with_views("rollouts verdicts", "SELECT DISTINCT instance_id, model, instance_id NOT IN (SELECT instance_id FROM verdicts WHERE passed) AS interrupted FROM rollouts")),
    "jn7_suffix_pairs": (
        lambda s, d: jn.suffix_pairs(line_ranges(s, d), seen_ranges(s, d), ["instance_id"]),
        with_views(_LS, """SELECT DISTINCT a.instance_id, a.file AS file_a, b.file AS file_b FROM (SELECT DISTINCT instance_id, file FROM line_ranges) a JOIN (SELECT DISTINCT instance_id, file FROM seen_ranges) b
 ON a.instance_id = b.instance_id AND (a.file = b.file OR ends_with(a.file, '/' || b.file) OR ends_with(b.file, '/' || a.file))""")),
    "jn8_lines_in_ranges": (
        lambda s, d: jn.lines_in_ranges(seen_ranges(s, d).select("instance_id", F.concat(F.lit("src/"), "file").alias("file"), F.col("start_line").alias("line")).distinct(), line_ranges(s, d), ["instance_id", "file"]).select("instance_id", "file", "line", "range_id"),
        with_views(_LS, """SELECT p.instance_id, p.file, line, range_id FROM (SELECT DISTINCT instance_id, 'src/' || file AS file, start_line AS line FROM seen_ranges) p JOIN line_ranges r
 ON r.instance_id = p.instance_id AND r.file = p.file AND line BETWEEN r.start_line AND r.end_line""")),
    "jn9_backfill": (
        lambda s, d: jn.backfill(table(s, d, "part").where("p_partkey % 3 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("size")), table(s, d, "part").select("p_partkey", "p_brand"),
                                 table(s, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("size")), "p_partkey", ["p_brand"], ["size"]),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN p_size ELSE max(p_size) OVER (PARTITION BY p_brand) END AS size FROM part"),
    "jn9_plan_entries": (
        lambda s, d: jn.plan_entries(*_plans(s, d)),
        """WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS i, p_brand, p_size, p_partkey % 4 AS k FROM part)
 SELECT i AS instance_id, p_brand AS category, 'f' || p_size AS file, 'q' || k AS qualname, CASE WHEN k = 0 THEN '{"p":1}' WHEN k = 1 AND p_size % 3 <> 0 THEN '{"t":' || p_size || '}'
  WHEN p_partkey % 5 = 0 THEN '{"m": ' || p_partkey || '}' ELSE '{}' END AS metrics, CASE WHEN k = 0 THEN 'plan' WHEN k = 1 AND p_size % 3 <> 0 THEN 'target' ELSE 'prompt' END AS origin FROM p"""),
    "jn10_caller_hops": (
        lambda s, d: jn.caller_hops(call_edges(s, d)).select("module", "func", F.array_join("callers", ",").alias("callers"), F.array_join("callers_2hop", ",").alias("callers_2hop")),
        with_views("call_edges", """WITH o AS (SELECT DISTINCT module, callee AS func, caller FROM call_edges WHERE caller <> callee),
 t AS (SELECT DISTINCT o.module, o.func, u.caller FROM o JOIN o u ON u.module = o.module AND u.func = o.caller WHERE u.caller <> o.func EXCEPT SELECT * FROM o),
 a AS (SELECT module, func, array_to_string(list_sort(list(caller))[1:6], ',') AS callers FROM o GROUP BY ALL), b AS (SELECT module, func, array_to_string(list_sort(list(caller))[1:6], ',') AS callers_2hop FROM t GROUP BY ALL)
 SELECT module, func, callers, callers_2hop FROM a LEFT JOIN b USING (module, func)""")),
    "jn11_price_lookup": (
        lambda s, d: jn.price_lookup(table(s, d, "part").select(F.concat_ws("-", F.when(F.col("p_partkey") % 3 == 0, "big").when(F.col("p_partkey") % 3 == 1, "small-fast").otherwise("nick"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("model")),
                                     s.createDataFrame([("big", 3.0), ("small", 1.0), ("small-fast", 0.5)], "name string, input double"), s.createDataFrame([("nick", "big")], "name string, target string")),
        """SELECT CASE p_partkey % 3 WHEN 0 THEN 'big' WHEN 1 THEN 'small-fast' ELSE 'nick' END || '-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS model, CASE p_partkey % 3 WHEN 1 THEN 'small-fast' ELSE 'big' END AS priced_as,
 CASE p_partkey % 3 WHEN 1 THEN 0.5 ELSE 3.0 END AS input FROM part"""),
    "in1_superseded": (
        lambda s, d: inc.superseded(verdicts(s, d).where("run_pos <= 3"), verdicts(s, d).where("run_pos > 3"), ["scope", "instance_id"]).select("scope", "instance_id", "passed"),
        with_views("verdicts", "SELECT scope, instance_id, arg_max(passed, run_pos) AS passed FROM verdicts GROUP BY ALL")),
    "in1_accumulated": (
        lambda s, d: _accumulated(s, d),
        with_views("verdicts", "SELECT scope, instance_id, max(run_pos) AS run_pos, arg_max(passed, run_pos) AS passed FROM verdicts GROUP BY ALL")),
    "in2_cascade": (
        lambda s, d: inc.cascade(rollouts(s, d), ["m0", "m1", "m2"]),
        with_views("rollouts", """WITH f AS (SELECT instance_id, model, count(*) FILTER (passed) AS p, count(*) AS n FROM rollouts GROUP BY ALL), a AS (SELECT instance_id, min(model) AS tier, arg_min(p, model) AS p, arg_min(n, model) AS n FROM f WHERE p > 0 GROUP BY 1)
 SELECT i.instance_id, tier, CASE WHEN tier IS NULL THEN 'rejected' WHEN p = n THEN 'all' ELSE 'partial' END AS band FROM (SELECT DISTINCT instance_id FROM rollouts) i LEFT JOIN a USING (instance_id)""")),
    "in3_merge_scope": (
        lambda s, d: inc.merge_scope(instances(s, d).select("instance_id", "category"), instances(s, d).where("instance_id % 10 = 0").select("instance_id", F.lit("new").alias("category")), instances(s, d).where("instance_id % 5 = 0"), "instance_id"),
        with_views("instances", "SELECT instance_id, category FROM instances WHERE instance_id % 5 <> 0 UNION ALL SELECT instance_id, 'new' FROM instances WHERE instance_id % 10 = 0")),
    "in4_recovered_bands": (
        lambda s, d: inc.recovered_bands(rollouts(s, d)),
        with_views("rollouts", """SELECT instance_id, CASE WHEN count(*) FILTER (contains(reason, 'session limit')) = 0 THEN CASE WHEN bool_and(passed) THEN 'all' WHEN bool_or(passed) THEN 'partial' ELSE 'none' END END AS band,
 count(*) FILTER (contains(reason, 'session limit')) AS broken FROM rollouts GROUP BY 1""")),
    "in5_pending": (
        lambda s, d: inc.pending(instances(s, d).select("instance_id"), rollouts(s, d).where("rollout = 3"), ["instance_id"]),
        with_views("instances rollouts", "SELECT instance_id FROM instances WHERE instance_id NOT IN (SELECT instance_id FROM rollouts WHERE rollout = 3)")),
    "tj2_path_classes": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.expr(_PATHS).alias("path")).select("p_partkey", tj.path_class(F.col("path")).alias("c"), tj.is_source(F.col("path")).alias("source")),
        """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'answer' WHEN 1 THEN 'validation_workspace' WHEN 2 THEN 'question' WHEN 3 THEN 'test_bundle' WHEN 4 THEN 'qa_bundle' WHEN 5 THEN 'workspace_helper'
 WHEN 6 THEN 'repository' WHEN 7 THEN 'repository' WHEN 8 THEN 'external' WHEN 9 THEN 'answer' WHEN 10 THEN 'external' ELSE 'repository' END AS c, p_partkey % 12 IN (1, 3, 5, 6, 8, 11) AS source FROM part"""),
    "tj3_command_effort": (
        lambda s, d: tj.command_effort(_commands(s, d)),
        """WITH c AS (SELECT l_orderkey AS rollout_id, l_suppkey % 6 AS k, l_partkey % 3 AS m, CASE l_suppkey % 6 WHEN 2 THEN 'cat ' || l_partkey WHEN 5 THEN '5-' || l_partkey % 3 ELSE CAST(l_suppkey % 6 AS VARCHAR) END AS command FROM lineitem)
 SELECT rollout_id, count(*) AS commands, count(*) - count(DISTINCT command) AS repeated, count(*) FILTER (k IN (1, 3)) AS search_commands, count(*) FILTER (k = 0 OR k = 5 AND m = 1) AS execution_commands,
 count(*) FILTER (k = 0) AS test_commands, count(*) FILTER (k = 2 OR k = 5 AND m = 1) AS inspection_commands, count(*) FILTER (k = 5 AND m = 0) AS mutation_commands,
 count(*) FILTER (k = 5 AND m = 0) AS install_commands, count(*) FILTER (k = 5 AND m = 1) AS instrumentation_commands FROM c GROUP BY 1"""),
    "tj4_written_paths": (
        lambda s, d: table(s, d, "lineitem").select(F.col("l_orderkey").alias("rollout_id"), F.expr(_WRITES).alias("command")).select("rollout_id", F.explode(tj.written_paths(F.col("command"))).alias("path")).groupBy(
            "rollout_id").agg(F.count("*").alias("n"), F.count_if(tj.path_class(F.col("path")) == "answer").alias("answers")),
        """SELECT l_orderkey AS rollout_id, sum(CASE l_suppkey % 7 WHEN 2 THEN 2 ELSE 1 END) AS n, count(*) FILTER (l_suppkey % 7 IN (0, 1, 4)) AS answers FROM lineitem WHERE l_suppkey % 7 IN (0, 1, 2, 4, 6) GROUP BY 1"""),
    "tj5_first_times": (
        lambda s, d: tj.first_times(table(s, d, "events").withColumnRenamed("user_id", "rollout_id"), F.col("event_type") == "signup", F.col("event_type") == "purchase", F.col("event_type") == "error"),
        """SELECT user_id AS rollout_id, (epoch_us(min(ts) FILTER (event_type = 'signup')) - epoch_us(min(ts))) / 1e6 AS to_tool, (epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts))) / 1e6 AS to_run,
 (epoch_us(min(ts) FILTER (event_type = 'error')) - epoch_us(min(ts))) / 1e6 AS to_answer FROM events GROUP BY 1"""),
    "tj6_usage_totals": (
        lambda s, d: tj.usage_totals(_usage(s, d)).withColumn("cost", F.round("cost", 6)),
        """SELECT l_orderkey AS rollout_id, sum(l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey ELSE 0 END + l_linenumber * 10) AS context_tokens, sum(l_suppkey) AS output_tokens,
 sum(l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey ELSE 0 END + l_linenumber * 10 + l_suppkey) AS total_tokens, round(sum(CAST(l_tax AS DOUBLE)), 6) AS cost FROM lineitem GROUP BY 1"""),
    "tj6_result_usage": (
        lambda s, d: tj.result_usage(table(s, d, "lineitem").select(F.col("l_orderkey").alias("rollout_id"), F.col("l_linenumber").alias("n"), F.expr(_RESULT).alias("doc"))).groupBy("rollout_id").agg(
            *[F.sum(c).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_creation", "cache_read")], F.sum("cost").alias("cost")),
        """WITH u AS (SELECT l_orderkey AS rollout_id, l_suppkey % 4 AS k, l_partkey AS p, l_suppkey AS q FROM lineitem)
 SELECT rollout_id, sum(CASE k WHEN 0 THEN p + 7 WHEN 1 THEN p WHEN 2 THEN p ELSE 0 END)::BIGINT AS input_tokens, sum(CASE k WHEN 0 THEN q WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 0 END)::BIGINT AS output_tokens,
 sum(CASE k WHEN 0 THEN 2 WHEN 1 THEN q ELSE 0 END)::BIGINT AS cache_creation, sum(CASE k WHEN 0 THEN 1 ELSE 0 END)::BIGINT AS cache_read, sum(CASE k WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0 END)::DOUBLE AS cost FROM u GROUP BY 1"""),
    "tj7_raw_effort": (
        lambda s, d: tj.raw_effort(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("rollout_id")).agg(
            F.count("*").alias("tool_calls"), F.count_distinct("l_partkey").alias("files_read"), F.count_distinct(F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey"))).alias("source_files_read"),
            F.sum("l_partkey").alias("read_characters"), F.count_if(F.col("l_suppkey") % 2 == 0).alias("commands"), F.count_if(F.col("l_suppkey") % 6 == 0).alias("search_commands"),
            F.count_if(F.col("l_suppkey") % 6 == 2).alias("execution_commands"), F.count_if(F.col("l_suppkey") % 6 == 4).alias("test_commands"), F.count_distinct("l_suppkey").alias("helper_files"),
            F.count_if(F.col("l_linenumber") == 1).alias("write_calls"), F.count_if(F.col("l_linenumber") == 2).alias("edit_calls"), F.max("l_linenumber").alias("messages"),
            F.sum("l_suppkey").alias("thinking_tokens"), F.sum("l_linenumber").alias("output_tokens"), F.count_if(F.col("l_linenumber") > 4).alias("tool_errors"),
            F.count_if(F.col("l_linenumber") < 4).alias("answer_writes"), F.lit(2).alias("repeated"), F.lit(1).alias("denials"),
            F.max("l_partkey").alias("duration_ms"), F.sum("l_partkey").alias("context_tokens"))).select("rollout_id", *tj.EFFORT_WEIGHTS),
        """SELECT l_orderkey AS rollout_id,
 round(count(*) + 2 * count(DISTINCT l_partkey) + 3 * count(DISTINCT l_partkey) FILTER (l_partkey % 2 = 0) + 2 * count(*) FILTER (l_suppkey % 6 = 0) + sum(l_partkey) / 20000, 6) AS exploration,
 round(count(*) FILTER (l_suppkey % 2 = 0) + 2 * count(*) FILTER (l_suppkey % 6 = 2) + 3 * count(*) FILTER (l_suppkey % 6 = 4) + 3 * count(DISTINCT l_suppkey) + count(*) FILTER (l_linenumber = 1) + count(*) FILTER (l_linenumber = 2), 6) AS execution,
 round(max(l_linenumber) + sum(l_suppkey) / 500 + sum(l_linenumber) / 1000, 6) AS deliberation,
 round(3 * count(*) FILTER (l_linenumber > 4) + 2 * greatest(count(*) FILTER (l_linenumber < 4) - 1, 0) + 2 + 1, 6) AS friction,
 round(max(l_partkey) / 60000 + sum(l_partkey) / 100000, 6) AS resources FROM lineitem GROUP BY 1"""),
    "tj8_solver_reads": (
        lambda s, d: tj.solver_reads(line_ranges(s, d).select(F.col("range_id").alias("run_id"), F.concat(F.lit("[tool] result read_file ok="), F.when(F.col("range_id") % 2 == 0, "True").otherwise("False"), F.lit(" path="), F.regexp_replace("file", " ", "_"), F.lit(" lines="), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("text"))),
        with_views("line_ranges", """SELECT range_id AS run_id, replace(file, ' ', '_') AS path, start_line AS first, end_line AS last FROM line_ranges WHERE range_id % 2 = 0""")),
    "ev1_depth_classes": (
        lambda s, d: table(s, d, "part").groupBy(ev.depth_class(F.col("p_size") % 5 - 1).alias("c")).agg(F.count("*").alias("n")),
        "SELECT CASE WHEN p_size % 5 = 0 THEN 'upstream' WHEN p_size % 5 = 1 THEN 'target' WHEN p_size % 5 = 2 THEN 'direct' ELSE 'deeper' END AS c, count(*) AS n FROM part GROUP BY 1"),
    "ev2_shortest_depths": (
        lambda s, d: ev.depths_from_roots(call_edges(s, d), call_edges(s, d).groupBy("module").agg(F.min("caller").alias("root"))),
        with_views("call_edges", """WITH r AS (SELECT module, min(caller) AS root, min(caller) AS func, 0 AS depth FROM call_edges GROUP BY 1
 UNION SELECT r.module, r.root, e.callee, r.depth + 1 FROM r JOIN call_edges e ON e.module = r.module AND e.caller = r.func WHERE r.depth < 60) SELECT module, root, func, min(depth) AS depth FROM r GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1)),
    "ev2_depths_from_roots": (
        lambda s, d: ev.depths_from_roots(call_edges(s, d), call_edges(s, d).select("module", F.col("caller").alias("root"))), None),
    "ev2_tree_depths": (
        lambda s, d: ct.least_depths(_frames(s, d), F.col("func") == "g3", F.col("func").isin("g7", "g11"), ["trace_id", "func"]),
        f"""WITH RECURSIVE fr AS ({_FRAMES_SQL}), w AS (SELECT trace_id, activation, func, CASE WHEN func = 'g3' THEN 0 ELSE -1 END AS depth FROM fr WHERE parent IS NULL
 UNION ALL SELECT f.trace_id, f.activation, f.func, CASE WHEN f.func = 'g3' THEN 0 WHEN w.depth < 0 THEN -1 WHEN f.func IN ('g7', 'g11') THEN w.depth ELSE w.depth + 1 END FROM fr f JOIN w ON f.trace_id = w.trace_id AND f.parent = w.activation)
 SELECT trace_id, func, coalesce(min(depth) FILTER (depth >= 0), -1) AS call_depth FROM w WHERE func NOT IN ('g7', 'g11') GROUP BY ALL"""),
    "ev2_activation_depths": (
        lambda s, d: _activation_depths(s, d), None),
    "ev3_class_coverage": (
        lambda s, d: ev.class_coverage(_functions(s, d), _seen(s, d)),
        with_views(_LS, f"""WITH {_REQ}, {_FUN} SELECT instance_id, class, count(*) AS functions, count(*) FILTER (hit = n) AS functions_read, sum(n) AS lines, sum(hit) AS lines_read, sum(hit) / sum(n) AS recall FROM fn GROUP BY ALL""")),
    "ev3_coverage": (
        lambda s, d: ev.coverage(_functions(s, d), _seen(s, d)),
        with_views(_LS, f"WITH {_REQ}, {_FUN}, {_COVER} SELECT * FROM cover")),
    "ev4_precision": (
        lambda s, d: ev.read_precision(_executed(s, d), _seen(s, d)),
        with_views(_LS, f"""WITH {_REQ}, x AS (SELECT DISTINCT instance_id, file, line, 1 AS x FROM rl WHERE range_id % 2 = 0), rf AS (SELECT DISTINCT instance_id, file FROM line_ranges), v AS (SELECT sl.* FROM sl JOIN rf USING (instance_id, file))
 SELECT instance_id, count(x) / count(*) AS precision FROM v LEFT JOIN x USING (instance_id, file, line) GROUP BY 1""")),
    "ev5_required_recall": (
        lambda s, d: ev.required_recall(line_ranges(s, d), _seen(s, d)),
        with_views(_LS, f"""WITH {_REQ}, e AS (SELECT instance_id, range_id, necessity, count(*) AS n, count(s) AS h FROM rl LEFT JOIN sl USING (instance_id, file, line) GROUP BY ALL), {_RECALL} SELECT * FROM recall""")),
    "ev5_code_recall": (
        lambda s, d: ev.required_recall(line_ranges(s, d), _seen(s, d), code=line_ranges(s, d).select("file", F.explode(F.sequence("start_line", "end_line")).alias("line")).where("line % 3 <> 0").distinct()),
        with_views(_LS, f"""WITH {_REQ}, k AS (SELECT *, count(*) FILTER (line % 3 <> 0) OVER (PARTITION BY range_id) AS c FROM rl),
 e AS (SELECT instance_id, range_id, necessity, count(*) AS n, count(s) AS h FROM k LEFT JOIN sl USING (instance_id, file, line) WHERE line % 3 <> 0 OR c = 0 GROUP BY ALL), {_RECALL} SELECT * FROM recall""")),
    "ev6_code_lines": (
        lambda s, d: ev.code_lines(table(s, d, "documents").select(F.col("doc_id").alias("file"), "text")).groupBy(F.col("file").alias("doc_id")).agg(F.count("*").alias("n")),
        "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS t FROM documents) WHERE NOT regexp_matches(t, '^[ \t\n\x0b\f\r]*(#[^\n]*)?$') GROUP BY 1"),
    "ev6_docstrings": (
        lambda s, d: ev.code_lines(table(s, d, "part").select(F.col("p_partkey").alias("file"), F.expr(_MODULES).alias("text"))).groupBy("file").agg(F.count("*").alias("n"), F.sum("line").alias("at")),
        "SELECT p_partkey AS file, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE p_size END AS n, CASE p_partkey % 4 WHEN 0 THEN 23 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE p_size * (p_size + 1) // 2 END AS at FROM part"),
    "ev7_downgraded": (
        lambda s, d: ev.downgraded(line_ranges(s, d).withColumns({"role": F.when(F.col("range_id") % 2 == 0, "data").otherwise("logic"), "code": F.concat(F.lit("N"), (F.col("range_id") % 7).cast("string"), F.lit(" = 3"))}),
                                   s.createDataFrame([(i, "N3") for i in range(50)], "instance_id long, name string")).select("range_id", "necessity"),
        with_views("line_ranges", "SELECT range_id, CASE WHEN range_id % 2 = 0 AND range_id % 7 = 3 AND end_line - start_line + 1 <= 3 THEN 'supporting' ELSE necessity END AS necessity FROM line_ranges")),
    "ev9_correctness_tables": (
        lambda s, d: _answered(s, d, ev.coverage(_functions(s, d), _seen(s, d)), "sufficient", "sufficient").union(_answered(s, d, ev.required_recall(line_ranges(s, d), _seen(s, d)), "essential_complete", "fully read")),
        with_views(_LS, f"""WITH {_REQ}, {_FUN}, {_COVER}, e AS (SELECT instance_id, range_id, necessity, count(*) AS n, count(s) AS h FROM rl LEFT JOIN sl USING (instance_id, file, line) GROUP BY ALL), {_RECALL},
 b AS (SELECT 'sufficient' AS condition, instance_id, sufficient AS m FROM cover UNION ALL SELECT 'fully read', instance_id, essential_complete FROM recall), c AS (SELECT *, CASE WHEN instance_id % 4 <> 0 THEN instance_id % 3 = 0 END AS r FROM b)
 SELECT condition, count(*) AS instances, count(*) FILTER (m) AS met, count(*) FILTER (m AND r) AS met_correct, count(*) FILTER (m AND NOT r) AS met_wrong, count(*) FILTER (NOT m AND r) AS unmet_correct,
 count(*) FILTER (NOT m AND NOT r) AS unmet_wrong, count(*) FILTER (r IS NULL) AS no_answer, count(*) FILTER (m) / count(*) AS met_rate FROM c GROUP BY 1""")),
    "ck1_first_activations": (
        lambda s, d: ck.checkpoints(*_traced(s, d)).select("trace_id", "func", "checkpoint", "level", "kind", "expected", F.array_join("accept", ",").alias("accept")), None),
    "ck2_checkpoint_scores": (
        lambda s, d: ck.checkpoint_scores(*_checkpoint_answers(s, d)).select("instance_id", "answered", "score"),
        f"""WITH p AS (SELECT p_partkey AS i, p_size AS s, p_partkey % 7 AS k, p_partkey % 5 AS v, {_FOLD.format('p_size')} AS f, {_FOLD.format('p_size + 1')} AS g FROM part),
 x AS (SELECT *, list_distinct(list_filter([f, g, 12], lambda z: z <> 30)) AS got FROM p), y AS (SELECT *, len(list_intersect(got, [1, 10, 12])) AS h FROM x)
 SELECT i AS instance_id, NOT (k = 0 AND v = 4) AS answered, CASE k WHEN 0 THEN CASE WHEN v < 3 THEN 1.0 ELSE 0.0 END WHEN 1 THEN CASE WHEN v NOT IN (1, 2) OR f = g THEN 1.0 ELSE 0.0 END
 WHEN 2 THEN CASE WHEN h = len(got) AND h = 3 THEN 1.0 WHEN h > 0 THEN round(2 * (h / len(got)) * (h / 3) / (h / len(got) + h / 3), 4) ELSE 0.0 END
 WHEN 3 THEN CASE WHEN v < 2 THEN 1.0 ELSE 0.0 END WHEN 4 THEN CASE WHEN v < 3 THEN 1.0 ELSE 0.0 END WHEN 5 THEN CASE WHEN v < 3 THEN 1.0 ELSE 0.0 END ELSE 1.0 END AS score FROM y"""),
    "ck2_folded_lines": (
        lambda s, d: ck.folded(table(s, d, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("func"), "p_partkey", F.col("p_size").alias("line")), _statements(s)),
        f"SELECT 'f' || p_partkey % 3 AS func, p_partkey, {_FOLD.format('p_size')} AS line FROM part"),
    "ck2_line_set_f1": (
        lambda s, d: ck.line_set_f1(_required(s, d).select("instance_id", F.explode(F.sequence("start_line", "end_line")).alias("line")), seen_ranges(s, d).select("instance_id", F.col("start_line").alias("line")), ["instance_id"]),
        with_views(_LS, """WITH e AS (SELECT DISTINCT instance_id, unnest(range(start_line, end_line + 1)) AS line, 1 AS e FROM line_ranges), p AS (SELECT DISTINCT instance_id, start_line AS line, 1 AS p FROM seen_ranges),
 a AS (SELECT instance_id, count(e) AS e, count(p) AS p, count(*) FILTER (e IS NOT NULL AND p IS NOT NULL) AS h FROM e FULL JOIN p USING (instance_id, line) GROUP BY 1)
 SELECT instance_id, CASE WHEN h = 0 THEN 0 ELSE 2 * (h / p) * (h / e) / (h / p + h / e) END AS score FROM a""")),
    "ck3_level_results": (
        lambda s, d: _levels(s, d),
        with_views("expected_elements", f"WITH {_LADDER} SELECT instance_id, level, passed, mean_score FROM lv")),
    "ck4_ladders": (
        lambda s, d: ev.ladder(_levels(s, d)),
        with_views("expected_elements", f"WITH {_LADDER} SELECT * FROM ladder")),
    "ck5_ladder_summary": (
        lambda s, d: ck.ladder_summary(ev.ladder(_levels(s, d)), ["levels"]),
        with_views("expected_elements", f"WITH {_LADDER} SELECT levels, count(*) AS n, avg(depth) AS mean_depth, avg(CASE WHEN monotone THEN 1.0 ELSE 0 END) AS monotone_rate, count(first_failed) AS failed FROM ladder GROUP BY 1")),
    "ck5_level_rates": (
        lambda s, d: ck.level_rates(_levels(s, d), _laddered(s, d)),
        with_views("expected_elements", f"WITH {_LADDER}, {_SCOPED} SELECT scope, name, level, count(*) AS instances, count(*) FILTER (passed) AS passed, count(*) FILTER (passed) / count(*) AS pass_rate, avg(mean_score) AS mean_score FROM lv JOIN sc USING (instance_id) GROUP BY ALL")),
    "ck5_first_failures": (
        lambda s, d: ck.first_failures(ev.ladder(_levels(s, d)), _laddered(s, d)),
        with_views("expected_elements", f"WITH {_LADDER}, {_SCOPED} SELECT scope, name, coalesce(CAST(first_failed AS VARCHAR), 'none') AS first_failed, count(*) AS n FROM ladder JOIN sc USING (instance_id) GROUP BY ALL")),
    "ck5_ladder_overview": (
        lambda s, d: ck.ladder_overview(ev.ladder(_levels(s, d)), _laddered(s, d), "7"),
        with_views("expected_elements", f"""WITH {_LADDER}, {_SCOPED}, a AS (SELECT scope, name, count(*) AS instances, avg(depth) AS mean_depth, count(*) FILTER (monotone) AS monotone, count(*) FILTER (fc AND first_failed IS NOT NULL AND first_failed <> 7) AS right_after_failure
  FROM ladder JOIN sc USING (instance_id) GROUP BY ALL)
 SELECT scope, name, instances, mean_depth, monotone, monotone / instances AS monotone_rate, right_after_failure FROM a UNION ALL SELECT 'unanswered', 'all', count(*), NULL, NULL, NULL, NULL FROM si WHERE NOT ans""")),
    "pt1_source_pool": (
        lambda s, d: ev.source_pool(rk.quantile_labels(instances(s, d), ["category"]), jn.approved(verdicts(s, d), F.lit(True)), instances(s, d).where("instance_id % 9 = 0")).select("instance_id"),
        with_views("instances verdicts", """WITH cut AS (SELECT category, quantile_cont(score, 0.25) AS q FROM instances GROUP BY 1)
 SELECT instance_id FROM instances JOIN cut USING (category) WHERE score <= q AND instance_id IN (SELECT instance_id FROM verdicts WHERE passed) AND instance_id % 9 <> 0""")),
    "pt4_goals": (
        lambda s, d: _goals(s, d),
        with_views("instances", """WITH i AS (SELECT instance_id AS i, instance_id % 5 - instance_id % 3 AS a, instance_id % 7 - instance_id % 2 AS b, instance_id % 3 - instance_id % 4 AS c, instance_id % 11 - instance_id % 6 AS m, instance_id % 5 AS l, instance_id % 13 = 0 AS no FROM instances),
 g AS (SELECT *, unnest(['none', 'increased', 'medium', 'hard', 'very_hard']) AS goal, unnest([true, false]) AS x FROM i), h AS (SELECT i, a, b, c, m, l, no, goal, unnest([false, true]) AS every FROM (SELECT DISTINCT i, a, b, c, m, l, no, unnest(['none', 'increased', 'medium', 'hard', 'very_hard']) AS goal FROM i))
 SELECT goal, every, count(*) AS n, count(*) FILTER (NOT no AND CASE goal WHEN 'none' THEN true WHEN 'increased' THEN m > 0 AND (NOT every OR a > 0 AND b > 0 AND c > 0)
  ELSE m > 0 AND l < 4 AND l >= CASE goal WHEN 'medium' THEN 1 WHEN 'hard' THEN 2 ELSE 3 END AND (NOT every OR a > 0 AND b > 0 AND c > 0) END) AS met, CAST(sum(a) AS DOUBLE) AS d_a FROM h GROUP BY ALL""")),
    "pt5_flips": (
        lambda s, d: ev.flips(rollouts(s, d).where("rollout = 1").select("instance_id", F.when(F.col("reason") != "session limit reached", F.col("passed")).alias("passed")), rollouts(s, d).where("rollout = 2").select("instance_id", F.when(F.col("reason") != "session limit reached", F.col("passed")).alias("passed"))),
        with_views("rollouts", """WITH r AS (SELECT instance_id, rollout, CASE WHEN reason <> 'session limit reached' THEN passed END AS p FROM rollouts)
 SELECT a.instance_id, CASE WHEN a.p IS NOT NULL AND b.p IS NOT NULL THEN a.p AND NOT b.p END AS flipped FROM r a JOIN r b USING (instance_id) WHERE a.rollout = 1 AND b.rollout = 2""")),
    "pt7_funnel": (
        lambda s, d: ev.funnel(attempts(s, d)),
        with_views("rollouts", f"""WITH a AS ({ATTEMPTS_SQL}), m AS (SELECT trace_ratio, row_number() OVER (ORDER BY trace_ratio) AS r, count(*) OVER () AS t FROM a WHERE trace_ratio <> 0)
 SELECT count(*) AS attempts, count(*) FILTER (stage = 'kept') AS kept, count(*) FILTER (stage = 'harvest') AS harvest_failures, count(*) FILTER (stage = 'screen') AS screening_failures, count(*) FILTER (stage = 'complexity') AS complexity_failures,
 count(*) FILTER (oracle_changed = false) AS oracle_unchanged, count(*) FILTER (stage = 'kept' AND oracle_changed) AS oracle_changed, count(*) FILTER (stage = 'kept' AND trace_changed) AS trace_changed, count(target_met) AS complexity_checked,
 count(*) FILTER (increased) AS complexity_increased, count(*) FILTER (target_met) AS complexity_target_met, count(*) FILTER (trace_ratio > 1) AS longer, count(*) FILTER (trace_ratio > 0 AND trace_ratio < 1) AS shorter,
 count(flipped) AS flip_checked, count(*) FILTER (flipped) AS flipped, count(*) FILTER (infra_error) AS flip_infra_errors, sum(cost) AS flip_cost, (SELECT trace_ratio FROM m WHERE r = t // 2 + 1) AS median_trace_ratio FROM a""")),
    "pt7_upper_median": (
        lambda s, d: ev.upper_median(rollouts(s, d), ["model"], "duration"),
        with_views("rollouts", "SELECT model, list_sort(list(duration))[CAST(floor(count(*) / 2) AS INT) + 1] AS upper_median FROM rollouts GROUP BY 1")),
    "pt8_weak_sources": (
        lambda s, d: ev.weak_sources(rollouts(s, d).select(F.col("instance_id").alias("source_id"), F.col("passed").alias("met"))),
        with_views("rollouts", "SELECT instance_id AS source_id, count(*) AS attempts FROM rollouts GROUP BY 1 HAVING NOT bool_or(passed)")),
    "ev8_coverage_summary": (
        lambda s, d: ev.coverage_summary(_scored_reads(s, d), ["recall", "function_recall", "required"], ["sufficient", "complete"]),
        with_views(_LS, f"""WITH {_REQ}, {_FUN}, {_COVER}, e AS (SELECT instance_id, range_id, necessity, count(*) AS n, count(s) AS h FROM rl LEFT JOIN sl USING (instance_id, file, line) GROUP BY ALL), {_RECALL},
 b AS (SELECT cover.*, recall.recall AS required, complete, CASE WHEN cover.instance_id % 4 <> 0 THEN cover.instance_id % 3 = 0 END AS r, cover.instance_id % 3 AS cat FROM cover LEFT JOIN recall USING (instance_id)),
 c AS (SELECT *, 'overall' AS scope, 'all' AS name FROM b UNION ALL SELECT *, 'answer', CASE WHEN r THEN 'correct' ELSE 'wrong' END FROM b WHERE r IS NOT NULL UNION ALL SELECT *, 'category', CAST(cat AS VARCHAR) FROM b)
 SELECT scope, name, count(*) AS instances, avg(recall) AS recall, avg(function_recall) AS function_recall, avg(required) AS required, avg(CASE WHEN sufficient THEN 1.0 ELSE 0 END) AS sufficient_rate, avg(CASE WHEN complete THEN 1.0 ELSE 0 END) AS complete_rate FROM c GROUP BY ALL""")),
}

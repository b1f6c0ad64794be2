"""Queries of sources, source code and streams with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import ranking as rk
from ..operators import reports as rp
from ..operators import scoring as sc
from ..operators import source_code as so
from ..operators import statistics as st
from ..operators import trajectory as tj
from ..operators.trace import event_statistics
from ..sources import artifacts
from ..sources.fixtures import expected_elements, instances, predicted_elements, rollouts, table, trace_events, with_views
from ..streaming.live_counts import live_counts, run_available


def _code(s, d):
    """A small module for each part: one function of p_size + 2 lines with p_size % 5 branches."""
    body = F.concat(F.lit("def run(a):\n    x = 0\n"), F.repeat(F.lit("    if a: x = g(a)\n"), F.col("p_size") % 5), F.repeat(F.lit("    x += 1\n"), F.col("p_size")), F.lit("    return x\n"))
    broken = F.when(F.col("p_partkey") % 10 == 0, F.concat(body, F.lit("def ("))).otherwise(body)
    return table(s, d, "part").select(F.concat(F.when(F.col("p_partkey") % 4 == 0, "pkg/tests/m").otherwise("pkg/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), broken.alias("text"), "p_partkey", "p_size")


def _answer_files(s, d):
    key = F.col("instance_id").cast("string")
    path = F.when(F.col("rollout") % 3 == 0, F.concat(F.lit("/o/run_1/evaluation/llm/p/m/i"), key, F.lit("/answer.json"))).when(F.col("rollout") % 3 == 1, F.concat(F.lit("/o/run_1/evaluation/a-noexec/m/i"), key, F.lit("/answer.json"))).otherwise(
        F.concat(F.lit("/o/run_2/validation/solver_agent/a/m/i"), key, F.lit("/rollout_"), F.col("rollout").cast("string"), F.lit("/answer.json")))
    return rollouts(s, d).select(path.alias("path"), F.lit("{}").alias("doc"))


#: Instance numbers a report; documents grow in number and not in size.
REPORT_BLOCK = 1000


def _reports(s, d):
    """Verdict reports as JSON, one for each of 20 runs and block of instances; every model has a place in each."""
    verdict = F.struct(F.col("instance_id").cast("string").alias("instance_id"), "passed", F.struct(F.lit(1).alias("pass_count"), F.array(F.struct(F.col("rollout").cast("int").alias("rollout"), "passed", "reason")).alias("rollouts")).alias("details"))
    of = [(F.col("instance_id") % 20).alias("run_dir"), F.floor(F.col("instance_id") / REPORT_BLOCK).alias("block")]
    runs = rollouts(s, d).groupBy(*of, "model").agg(F.collect_list(verdict).alias("verdicts"))
    places = rollouts(s, d).select(*of).distinct().join(F.broadcast(rollouts(s, d).select("model").distinct()))
    full = places.join(runs, ["run_dir", "block", "model"], "left").withColumn("verdicts", F.coalesce("verdicts", F.array()))
    return full.groupBy("run_dir", "block").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("model").alias("validator"), F.lit("all").alias("scope"), "verdicts"))).alias("runs"))).alias("doc"))


def _trajectories(s, d):
    """A trajectory a conversation: each turn a tool use and its result."""
    block = F.array(F.struct(F.lit("tool_use").alias("type"), F.col("turn").cast("string").alias("id"), F.lit("bash").alias("name"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content")),
                    F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.col("turn").cast("string").alias("tool_use_id"), F.col("role").alias("content")))
    events = table(s, d, "conversations").groupBy(F.col("conv_id").alias("rollout_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), F.lit("assistant").alias("type"), F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.struct(block.alias("content")).alias("message")))).alias("events"))
    return events.select("rollout_id", F.to_json(F.struct("events")).alias("doc"))


def _stream(s, d):
    """The events table as a stream of files, with the columns of a trace."""
    schema = table(s, d, "events").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    digits = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    kind = F.col("event_type")
    return raw.select(F.col("user_id").alias("trace_id"), (digits % 20 + 10).alias("line"), F.concat(F.lit("f"), (digits % 4).cast("string")).alias("func"),
                      F.when(kind == "signup", "call").when(kind == "purchase", "return").when(kind == "error", "exception").otherwise("line").alias("event"))


_COUNTS = """SELECT trace_id, func, line, count(*) FILTER (event = 'line') AS hits, count(*) FILTER (event = 'call') AS calls, count(*) FILTER (event = 'exception') AS exceptions FROM trace_events GROUP BY ALL"""

QUERIES = {
    "io1_json_or_default": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", artifacts.json_or_default(F.concat(F.lit('{"a": '), F.when(F.col("o_orderkey") % 3 == 0, "[").otherwise("1"), F.lit("}")), "{}").alias("doc")),
        """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE '{"a": 1}' END AS doc FROM orders"""),
    "io2_answer_keys": (
        lambda s, d: artifacts.answer_keys(_answer_files(s, d)).groupBy("run_dir", "layout", "scope").agg(F.count("*").alias("n"), F.sum("rollout").alias("rollouts")),
        with_views("rollouts", """SELECT CASE WHEN rollout % 3 = 2 THEN '/o/run_2' ELSE '/o/run_1' END AS run_dir, CASE rollout % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'agent' ELSE 'validation' END AS layout,
 CASE rollout % 3 WHEN 0 THEN 'p/m' WHEN 1 THEN 'a-noexec/m' ELSE 'a/m' END AS scope, count(*) AS n, sum(CASE WHEN rollout % 3 = 2 THEN rollout END) AS rollouts FROM rollouts GROUP BY ALL""")),
    "io4_flat_verdicts": (
        lambda s, d: artifacts.flat_rollouts(artifacts.flat_verdicts(_reports(s, d))).groupBy("run_dir", "run_pos", "passed").agg(F.count("*").alias("n")),
        with_views("rollouts", "SELECT instance_id % 20 AS run_dir, CAST(model[2] AS INT) AS run_pos, passed, count(*) AS n FROM rollouts GROUP BY ALL")),
    "so1_source_files": (
        lambda s, d: _code(s, d).where(so.is_source(F.col("path"))).select("path"),
        "SELECT 'pkg/m' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 4 <> 0"),
    "so2_functions": (
        lambda s, d: so.functions(_code(s, d)).select("path", "qualname", "end_lineno", "branches", "assigns", "augassigns", "calls", "num_local_calls", "returns", "body_lines", so.structural_score().alias("score")),
        """WITH c AS (SELECT *, p_size % 5 AS b, p_size + p_size % 5 + 3 AS n FROM part)
 SELECT CASE WHEN p_partkey % 4 = 0 THEN 'pkg/tests/m' ELSE 'pkg/m' END || p_partkey || '.py' AS path, 'run' AS qualname, n AS end_lineno, b AS branches, 1 + b AS assigns, p_size AS augassigns, b AS calls, 0 AS num_local_calls, 1 AS returns, n AS body_lines,
 round((1 + b) * 2 + (1 + b + p_size + least(b, 10)) + least(n, 80) / 10, 2) AS score FROM c WHERE p_partkey % 10 <> 0 AND n >= 8"""),
    "so3_test_features": (
        lambda s, d: so.test_features(_code(s, d)),
        """SELECT CASE WHEN p_partkey % 4 = 0 THEN 'pkg/tests/m' ELSE 'pkg/m' END || p_partkey || '.py' AS path, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size + p_size % 5 + 3 END AS source_lines, 0 AS imports,
 CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size % 5 END AS calls FROM part"""),
    "in6_live_counts": (
        lambda s, d: run_available(s, live_counts(_stream(s, d)), "live"),
        with_views("trace_events", _COUNTS)),
    "tj1_tool_calls": (
        lambda s, d: tj.tool_calls(tj.content_blocks(_trajectories(s, d))).groupBy("rollout_id").agg(F.count("*").alias("uses"), F.count("result").alias("results"), F.count_if(F.col("result") == "user").alias("from_user")),
        "SELECT conv_id AS rollout_id, count(*) AS uses, count(role) AS results, count(*) FILTER (role = 'user') AS from_user FROM conversations GROUP BY 1"),
    "ag11_activity": (
        lambda s, d: rp.activity_histogram(rollouts(s, d).select(F.col("instance_id").alias("rollout_id"), F.explode(F.array("model", "reason")).alias("tool")).withColumn("n", F.lit(1))),
        with_views("rollouts", "SELECT tool, count(*) AS uses, count(DISTINCT instance_id) AS rollouts FROM (SELECT instance_id, model AS tool FROM rollouts UNION ALL SELECT instance_id, reason FROM rollouts) GROUP BY 1")),
    "ag10_effort_groups": (
        lambda s, d: rp.effort_summary(rollouts(s, d).withColumn("reason", F.when(F.col("passed"), F.col("reason"))), ["duration"], ["model", "reason"]),
        with_views("rollouts", "SELECT model, reason, 'duration' AS metric, avg(duration) AS mean, median(duration) AS median, quantile_cont(duration, 0.9) AS p90, sum(duration) AS total FROM rollouts WHERE passed GROUP BY ALL")),
    "wn8_last_result": (
        lambda s, d: table(s, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by(F.length("text"), "turn").cast("long").alias("last_length")),
        "SELECT conv_id, arg_max(length(text), turn) AS last_length FROM conversations WHERE role = 'assistant' GROUP BY 1"),
    "jn3_outcomes_after_labels": (
        lambda s, d: rk.quantile_labels(instances(s, d), ["category"]).join(rollouts(s, d).where("rollout = 1").select("instance_id", "passed"), "instance_id", "left").groupBy("label").agg(F.count("*").alias("n"), F.count_if("passed").alias("passes")),
        with_views("instances rollouts", """WITH cut AS (SELECT category, quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c FROM instances GROUP BY 1)
 SELECT CASE WHEN score <= a THEN 'easy' WHEN score <= b THEN 'medium' WHEN score >= c THEN 'very_hard' ELSE 'hard' END AS label, count(*) AS n, count(*) FILTER (passed) AS passes
 FROM instances JOIN cut USING (category) LEFT JOIN (SELECT instance_id, passed FROM rollouts WHERE rollout = 1) USING (instance_id) GROUP BY 1""")),
    "jn4_verified_missing": (
        lambda s, d: rp.verified_with_unanswered(instances(s, d).select("instance_id", "category"), rollouts(s, d).where("rollout = 4").select("instance_id", F.col("passed").alias("correct")), ["category"]),
        with_views("instances rollouts", """SELECT category, count(*) AS verified, count(passed) AS answered, count(*) FILTER (passed) AS "right", avg(CASE WHEN coalesce(passed, false) THEN 1.0 ELSE 0 END) AS accuracy
 FROM instances LEFT JOIN (SELECT * FROM rollouts WHERE rollout = 4) USING (instance_id) GROUP BY 1""")),
    "sc11_field_shapes": (
        lambda s, d: sc.field_shape(table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "scalar_number").when(F.col("p_partkey") % 4 == 1, "object").otherwise("array").alias("container"), (F.col("p_size") % 4).alias("elements"),
                                                (F.col("p_size") % 3).alias("scalars"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") % 4).otherwise(0).alias("records"), (F.col("p_partkey") % 3).alias("measures")), F.col("p_partkey") % 5 == 0).select("p_partkey", "shape"),
        """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'scalar_number' WHEN p_partkey % 4 = 1 THEN CASE WHEN p_size % 4 > 0 AND p_size % 3 = p_size % 4 THEN 'keyed_records' ELSE 'nested' END
 WHEN p_size % 4 > 0 AND p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 > 0 THEN 'keyed_records' WHEN p_partkey % 5 = 0 THEN 'set' ELSE 'sequence' END
 WHEN p_size % 3 < p_size % 4 THEN 'nested' WHEN p_partkey % 5 = 0 THEN 'set' ELSE 'sequence' END AS shape FROM part"""),
    "sc22_nested_leaf_f1": (
        lambda s, d: sc.set_scores(expected_elements(s, d).withColumn("token", F.concat_ws("=", F.col("pos").cast("string"), "token")), predicted_elements(s, d).withColumn("token", F.concat_ws("=", F.col("pos").cast("string"), "token"))).select("answer_id", "hits", "label"),
        with_views("expected_elements predicted_elements", """WITH e AS (SELECT answer_id, pos, token FROM expected_elements), p AS (SELECT answer_id, pos, token FROM predicted_elements),
 h AS (SELECT answer_id, count(*) AS h FROM e JOIN p USING (answer_id, pos, token) GROUP BY 1), ne AS (SELECT answer_id, count(*) AS e FROM e GROUP BY 1), np AS (SELECT answer_id, count(*) AS p FROM p GROUP BY 1)
 SELECT answer_id, coalesce(h, 0) AS hits, CASE WHEN coalesce(h, 0) = e AND h = p THEN 'correct' WHEN coalesce(h, 0) = p THEN 'missing_elements' WHEN h = e THEN 'extra_elements' ELSE 'wrong_elements' END AS label
 FROM ne LEFT JOIN np USING (answer_id) LEFT JOIN h USING (answer_id)""")),
    "pt3_trace_changes": (
        lambda s, d: ev.trace_changes(trace_events(s, d), trace_events(s, d).select("trace_id").distinct().join(
            trace_events(s, d).groupBy((F.col("trace_id") % 5).alias("g")).agg(F.min("trace_id").alias("baseline_id")), F.col("trace_id") % 5 == F.col("g")).select("trace_id", "baseline_id")),
        with_views("trace_events", """WITH p AS (SELECT trace_id, min(trace_id) OVER (PARTITION BY trace_id % 5) AS baseline_id FROM (SELECT DISTINCT trace_id FROM trace_events)),
 n AS (SELECT trace_id, count(*) FILTER (event = 'line') AS n, string_agg(file || ':' || line, ',' ORDER BY seq) FILTER (event = 'line') AS path FROM trace_events GROUP BY 1), l AS (SELECT DISTINCT trace_id, file, line FROM trace_events WHERE event = 'line'),
 w AS (SELECT trace_id, file, func, lag(line) OVER (PARTITION BY trace_id, file, func ORDER BY seq) AS src, line AS dst FROM trace_events), e AS (SELECT DISTINCT * FROM w WHERE src <> dst),
 nl AS (SELECT p.trace_id, count(*) AS k FROM p JOIN l USING (trace_id) WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.trace_id = p.baseline_id AND b.file = l.file AND b.line = l.line) GROUP BY 1),
 ne AS (SELECT p.trace_id, count(*) AS k FROM p JOIN e USING (trace_id) WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.trace_id = p.baseline_id AND b.file = e.file AND b.func = e.func AND b.src = e.src AND b.dst = e.dst) GROUP BY 1)
 SELECT p.trace_id, p.baseline_id, a.n AS line_events, b.n AS baseline_line_events, round_even(a.n / nullif(b.n, 0), 3) AS trace_ratio, coalesce(nl.k, 0) AS new_lines, coalesce(ne.k, 0) AS new_edges, a.path IS NOT DISTINCT FROM b.path AS same_path
 FROM p JOIN n a ON a.trace_id = p.trace_id JOIN n b ON b.trace_id = p.baseline_id LEFT JOIN nl ON nl.trace_id = p.trace_id LEFT JOIN ne ON ne.trace_id = p.trace_id""")),
    "pt6_gates": (
        lambda s, d: rollouts(s, d).select("instance_id", "rollout", ev.first_failing_gate([("harvest", F.col("tokens") % 7 != 0), ("complexity", F.col("duration") > 20)]).alias("gate")),
        with_views("rollouts", "SELECT instance_id, rollout, CASE WHEN tokens % 7 = 0 THEN 'harvest' WHEN duration <= 20 THEN 'complexity' ELSE 'kept' END AS gate FROM rollouts")),
    "pt9_frozen_refresh": (
        lambda s, d: rk.frozen_labels(instances(s, d).join(rollouts(s, d).where("passed").select("instance_id").distinct(), "instance_id", "left_semi").select("instance_id", "archetype", st.calibrated({"score": (11.0, 1.2, -0.08)}, 0.6, F.lit(0.0)).alias("score")),
                                      s.createDataFrame([("1-URGENT", 3.5, 4.0, 4.5)], "archetype string, q25 double, q50 double, q75 double"), "archetype", "unknown").select("instance_id", "label"),
        with_views("instances rollouts", """WITH c AS (SELECT instance_id, archetype, 10 * (1 - (0.6 + -0.08 * ((ln(1 + score) - 11.0) / 1.2))) AS s FROM instances WHERE instance_id IN (SELECT instance_id FROM rollouts WHERE passed))
 SELECT instance_id, CASE WHEN archetype <> '1-URGENT' THEN 'unknown' WHEN s <= 3.5 THEN 'easy' WHEN s <= 4.0 THEN 'medium' WHEN s >= 4.5 THEN 'very_hard' ELSE 'hard' END AS label FROM c""")),
}

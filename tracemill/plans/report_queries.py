"""Queries of reports, rankings and statistics with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as rk
from ..operators import reports as rp
from ..operators import scoring as sc
from ..operators import statistics as st
from ..operators.trajectory import EFFORT_WEIGHTS
from ..sources.fixtures import expected_elements, instances, line_ranges, predicted_elements, rollouts, seen_ranges, table, verdicts, with_views
from .scoring_queries import _F1, _LABEL, _OVERLAP, _docs

_I, _R, _V = "instances", "rollouts", "verdicts"
_CUT = """cut AS (SELECT category, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.75) AS q75, count(*) AS members FROM instances GROUP BY 1)"""
_LEVEL = "CASE WHEN members = 1 THEN 'medium' WHEN score <= q25 THEN 'easy' WHEN score <= q50 THEN 'medium' WHEN score >= q75 THEN 'very_hard' ELSE 'hard' END"
_LAB = f"{_CUT}, lab AS (SELECT i.*, {_LEVEL} AS label FROM instances i JOIN cut USING (category))"
_COST = "CASE WHEN tokens % 13 = 0 THEN 0.0 WHEN tokens % 997 = 0 THEN NULL ELSE (tokens * 3.0 + least(duration, tokens) * 0.5 + rollout * 15.0) / 1e6 END"
_SCORED = f"{_OVERLAP}, sco AS (SELECT answer_id, {_F1.format(p='precision', r='recall')} AS score, {_LABEL.format(p='precision', r='recall')} AS label, answer_id % 7 AS category FROM pr)"


def _scored(s, d):
    return sc.set_scores(expected_elements(s, d), predicted_elements(s, d)).select(
        "answer_id", "score", "label", (F.col("answer_id") % 7).alias("category"), (F.col("label") == "correct").alias("correct"), "precision", "recall")


def _labelled(s, d):
    return rk.quantile_labels(instances(s, d), ["category"])


def _costs(s, d):


    cost = F.when(F.col("tokens") % 13 == 0, 0.0).when(F.col("tokens") % 997 == 0, None).otherwise(
        rp.token_cost(F.col("tokens"), F.least("duration", F.col("tokens").cast("double")), F.col("rollout"), F.lit(3.0), F.lit(0.5), F.lit(15.0)))
    return rollouts(s, d).withColumn("cost", cost)


def _rank_pairs(s, d):
    """Two labellings of the instances: by score and by second score, both within the category."""
    two = rk.quantile_labels(instances(s, d), ["category"], "score2").select("instance_id", F.col("label").alias("b"))
    return _labelled(s, d).select("instance_id", F.col("label").alias("a")).join(two, "instance_id")


_PAIRS = f"""{_LAB}, cut2 AS (SELECT category, quantile_cont(score2, 0.25) AS q25, quantile_cont(score2, 0.5) AS q50, quantile_cont(score2, 0.75) AS q75, count(*) AS members FROM instances GROUP BY 1),
 prs AS (SELECT l.label AS a, CASE WHEN c.members = 1 THEN 'medium' WHEN score2 <= c.q25 THEN 'easy' WHEN score2 <= c.q50 THEN 'medium' WHEN score2 >= c.q75 THEN 'very_hard' ELSE 'hard' END AS b FROM lab l JOIN cut2 c USING (category)),
 cells AS (SELECT a, b, count(*) AS n, list_position(['easy','medium','hard','very_hard'], a) AS i, list_position(['easy','medium','hard','very_hard'], b) AS j FROM prs GROUP BY ALL)"""

#: Metrics of a function, of its trace and of its test for each part.
_METRICS = {
    "branches": "p_size % 7", "boolops": "p_size % 3", "returns": "p_size % 2 + 1", "loops": "p_size % 4", "while_loops": "p_size % 2", "max_loop_nesting": "p_size % 3",
    "breaks_continues": "p_partkey % 2", "assigns": "p_partkey % 9", "augassigns": "p_partkey % 4", "comprehensions": "p_partkey % 3", "raises": "p_size % 5 % 2", "excepts": "p_partkey % 3",
    "finallys": "p_partkey % 5 % 2", "calls": "p_partkey % 21", "num_local_calls": "p_partkey % 4", "body_lines": "p_size + 8", "distinct_line_transitions": "p_size * 3",
    "dynamic_branch_alternatives": "p_size % 11", "state_change_events": "p_partkey % 997", "call_events": "p_partkey % 301", "distinct_functions": "p_size % 6", "max_call_depth": "p_size % 12",
    "exception_events": "p_partkey % 13", "line_events": "p_partkey * 3", "max_line_repetition": "p_partkey % 701", "distinct_lines": "p_size * 2", "relevant_files": "p_size % 4",
    "relevant_functions": "p_size % 9", "imports": "p_size % 8", "test_calls": "p_size % 30", "source_lines": "p_size * 4", "callers": "p_size % 5",
    "exercise_mode": "CASE p_size % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' WHEN 2 THEN 'semi-direct' ELSE 'unknown' END",
}
_METRICS_SQL = "SELECT p_partkey, " + ", ".join(f"{e} AS {n}" for n, e in _METRICS.items()) + " FROM part"
_SEMANTIC_SQL = """sp AS (SELECT *, round(10 * (1 - exp(-(branches + boolops + 2 * loops + 2 * max_loop_nesting + breaks_continues) / 12::DOUBLE)), 3)::DECIMAL(9,3) AS sc, round(10 * (1 - exp(-(assigns + 2 * augassigns + 2 * comprehensions) / 15::DOUBLE)), 3)::DECIMAL(9,3) AS ss,
  round(10 * (1 - exp(-(calls + 2 * num_local_calls) / 14::DOUBLE)), 3)::DECIMAL(9,3) AS si, round(10 * (1 - exp(-(2 * excepts + raises + 2 * finallys) / 5::DOUBLE)), 3)::DECIMAL(9,3) AS se,
  round(0.55 * 10 * (1 - exp(-distinct_line_transitions / 75::DOUBLE)) + 0.45 * 10 * (1 - exp(-dynamic_branch_alternatives / 8::DOUBLE)), 3)::DECIMAL(9,3) AS dc, round(10 * (1 - exp(-state_change_events / 800::DOUBLE)), 3)::DECIMAL(9,3) AS ds,
  round(0.45 * 10 * (1 - exp(-call_events / 500::DOUBLE)) + 0.3 * 10 * (1 - exp(-distinct_functions / 5::DOUBLE)) + 0.25 * 10 * (1 - exp(-max_call_depth / 10::DOUBLE)), 3)::DECIMAL(9,3) AS di, round(10 * (1 - exp(-exception_events / 20::DOUBLE)), 3)::DECIMAL(9,3) AS de,
  round(0.45 * 10 * (1 - exp(-line_events / 3000::DOUBLE)) + 0.25 * 10 * (1 - exp(-max_line_repetition / 800::DOUBLE)) + 0.2 * 10 * (1 - exp(-distinct_lines / 70::DOUBLE)) + 0.1 * 10 * (1 - exp(-call_events / 500::DOUBLE)), 3)::DECIMAL(9,3) AS execution_workload FROM m),
 sm AS (SELECT *, round(0.35 * sc + 0.65 * dc, 3)::DECIMAL(9,3) AS control_flow, round(0.3 * ss + 0.7 * ds, 3)::DECIMAL(9,3) AS state_tracking, round(0.35 * si + 0.65 * di, 3)::DECIMAL(9,3) AS interprocedural, round(0.35 * se + 0.65 * de, 3)::DECIMAL(9,3) AS exception_semantics FROM sp),
 sc AS (SELECT *, round(0.2 * control_flow + 0.2 * state_tracking + 0.15 * interprocedural + 0.05 * exception_semantics + 0.4 * execution_workload, 3)::DECIMAL(9,3) AS semantic FROM sm)"""


def _metrics(s, d):
    return table(s, d, "part").select("p_partkey", *[F.expr(e).alias(n) for n, e in _METRICS.items()])


def _effort(s, d):
    """Rollouts with the five effort components."""
    return rollouts(s, d).select(
        (F.col("instance_id") * 100 + F.col("rollout")).alias("k"), "model", F.col("duration").alias("exploration"), F.col("tokens").alias("execution"),
        (F.col("tokens") % 97).alias("deliberation"), (F.col("instance_id") % 11).alias("friction"), F.col("rollout").alias("resources"))


#: Attempts at perturbing an instance, one for each rollout.
_ATTEMPT_COLUMNS = {
    "source_id": "instance_id", "attempt_id": "rollout", "category": "concat('c', CAST(instance_id % 3 AS STRING))",
    "flipped": "CASE WHEN tokens % 4 = 0 THEN NULL ELSE tokens % 9 = 1 END", "delta": "CASE WHEN tokens % 7 <> 0 THEN CAST(tokens % 5 AS DOUBLE) - 2 END",
    "increased": "CASE WHEN tokens % 7 <> 0 THEN tokens % 5 > 2 END", "target_met": "CASE WHEN tokens % 6 <> 0 THEN tokens % 5 > 3 END",
    "oracle_changed": "CASE WHEN tokens % 11 <> 0 THEN duration % 2 = 0 END", "trace_changed": "tokens % 3 = 0",
    "new_lines": "tokens % 4", "new_edges": "tokens % 2",
    "trace_ratio": "CASE WHEN tokens % 13 = 0 THEN 0.0 ELSE CAST(tokens % 40 AS DOUBLE) / 20 END",
    "stage": "CASE WHEN tokens % 13 = 0 THEN 'harvest' WHEN tokens % 5 = 1 THEN 'screen' WHEN tokens % 6 = 2 THEN 'complexity' WHEN tokens % 9 = 3 THEN 'flip' ELSE 'kept' END",
    "infra_error": "tokens % 37 = 0", "cost": "CASE WHEN tokens % 4 <> 0 THEN CAST(tokens % 8 AS DOUBLE) / 8 END",
}
ATTEMPTS_SQL = "SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {n}" for n, e in _ATTEMPT_COLUMNS.items()) + " FROM rollouts"


def attempts(s, d):
    return rollouts(s, d).select(*[F.expr(e).alias(n) for n, e in _ATTEMPT_COLUMNS.items()])


#: Scored fields of four shapes, one a rollout.
_SHAPE_COLUMNS = {
    "shape": "CASE tokens % 4 WHEN 0 THEN 'set' WHEN 1 THEN 'sequence' WHEN 2 THEN 'keyed_records' ELSE 'scalar_number' END",
    "label": "CASE WHEN tokens % 3 = 0 THEN 'correct' WHEN tokens % 4 = 0 THEN 'missing_elements' WHEN tokens % 4 = 1 THEN 'truncated' WHEN tokens % 4 = 2 THEN 'values_wrong' ELSE 'scalar_wrong' END",
    "score": "CASE WHEN tokens % 3 = 0 THEN 1.0 ELSE CAST(tokens % 8 AS DOUBLE) / 8 END",
    **{m: f"CASE WHEN tokens % 4 = {k} THEN CAST(tokens % {16 if k else 32} AS DOUBLE) / 32 END" for m, k in
       {"key_f1": 2, "value_accuracy": 2, "prefix_ratio": 1, "relative_error": 3, "median_relative_error": 2, "precision": 0, "recall": 0}.items()},
}


def _shapes(s, d):
    return rollouts(s, d).select(*[F.expr(e).alias(n) for n, e in _SHAPE_COLUMNS.items()])


_DESCRIBED = """en AS (SELECT *, CASE range_id % 6 WHEN 0 THEN 'target' WHEN 1 THEN 'callee' WHEN 2 THEN 'data' WHEN 3 THEN 'configuration' ELSE 'other' END AS role, CASE range_id % 4 WHEN 0 THEN 'executed' WHEN 1 THEN 'trace' WHEN 2 THEN 'read' END AS verified FROM line_ranges),
 ln AS (SELECT instance_id, file, line, bool_or(necessity <> 'supporting') AS e FROM (SELECT instance_id, file, necessity, unnest(range(start_line, end_line + 1)) AS line FROM line_ranges) GROUP BY ALL),
 rn AS (SELECT instance_id, file, line, bool_or(start_line % 5 > 0) AS near FROM (SELECT instance_id, 'src/' || file AS file, start_line, unnest(range(start_line, end_line + 1)) AS line FROM seen_ranges) GROUP BY ALL),
 bo AS (SELECT coalesce(ln.instance_id, rn.instance_id) AS instance_id, ln.line AS q, rn.line AS x, coalesce(e, false) AS e, coalesce(near, false) AS near FROM ln FULL JOIN rn ON ln.instance_id = rn.instance_id AND ln.file = rn.file AND ln.line = rn.line),
 su AS (SELECT instance_id, count(q) AS lines, count(*) FILTER (e) AS essential_lines, count(*) FILTER (q IS NOT NULL AND x IS NOT NULL) AS executed_lines, count(q) FILTER (near) / nullif(count(*) FILTER (near), 0) AS reachable_share FROM bo GROUP BY 1),
 de AS (SELECT instance_id, count(*) AS entries, count(*) FILTER (necessity = 'essential') AS essential_entries, count(DISTINCT file) AS files, count(*) FILTER (role = 'target') AS role_target, count(*) FILTER (role = 'callee') AS role_callee,
 count(*) FILTER (role = 'data') AS role_data, count(*) FILTER (role = 'configuration') AS role_configuration, count(*) FILTER (role = 'other') AS role_other, count(*) FILTER (verified = 'executed') AS verified_executed,
 count(*) FILTER (verified = 'trace') AS verified_trace, count(*) FILTER (verified = 'read') AS verified_read, any_value(lines) AS lines, any_value(essential_lines) AS essential_lines, any_value(executed_lines) AS executed_lines, any_value(reachable_share) AS reachable_share
 FROM en JOIN su USING (instance_id) GROUP BY 1)"""


def _entries(s, d):
    return line_ranges(s, d).withColumns({
        "role": F.expr("CASE range_id % 6 WHEN 0 THEN 'target' WHEN 1 THEN 'callee' WHEN 2 THEN 'data' WHEN 3 THEN 'configuration' WHEN 4 THEN 'caller' END"),
        "verified": F.expr("CASE range_id % 4 WHEN 0 THEN 'executed' WHEN 1 THEN 'trace' WHEN 2 THEN 'read' ELSE 'guessed' END")})


def _ran(s, d):
    return seen_ranges(s, d).select("instance_id", F.concat(F.lit("src/"), "file").alias("file"), (F.col("start_line") % 5 - 1).alias("depth"), F.explode(F.sequence("start_line", "end_line")).alias("line"))


def _records(s, d):
    told = rollouts(s, d).where("rollout = 2").select("instance_id", F.col("passed").alias("correct"))
    rows = instances(s, d).join(told, "instance_id", "left")
    return rows.select("instance_id", F.col("repo").alias("repository"), "category", (F.col("instance_id") % 3 != 0).alias("verified"), F.col("correct").isNotNull().alias("answered"), "correct",
                       F.expr("CASE instance_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' WHEN 2 THEN 'medium' END").alias("combined"), F.expr("CASE WHEN instance_id % 5 > 1 THEN 'easy' ELSE 'very_hard' END").alias("navigation"))


QUERIES = {
    "ag1_grouped_accuracy": (
        lambda s, d: rp.grouped_accuracy(rollouts(s, d).withColumn("kind", F.col("rollout") % 3), [["model", "kind"], ["model"], ["kind"], []], F.col("passed")),
        with_views(_R, """WITH r AS (SELECT *, rollout % 3 AS kind FROM rollouts) SELECT model, kind, grouping(model) * 2 + grouping(kind) AS level, count(*) AS total, count(*) FILTER (passed) AS correct,
 count(*) FILTER (passed) / count(*) AS accuracy FROM r GROUP BY GROUPING SETS ((model, kind), (model), (kind), ())""")),
    "ag2_score_summary": (
        lambda s, d: rp.score_summary(_scored(s, d), []),
        with_views("expected_elements predicted_elements", f"""WITH {_SCORED} SELECT count(*) AS answers, avg(CASE WHEN label = 'correct' THEN 1.0 ELSE 0 END) AS exact_rate, avg(score) AS mean_score,
 avg(score) FILTER (label <> 'correct') AS failed_mean, median(score) FILTER (label <> 'correct') AS failed_median, count(*) FILTER (score >= 0.5) AS at_50, count(*) FILTER (score >= 0.8) AS at_80,
 count(*) FILTER (score >= 0.9) AS at_90, count(*) FILTER (score >= 0.95) AS at_95 FROM sco""")),
    "ag3_summary_by_category": (
        lambda s, d: rp.score_summary(_scored(s, d), ["category"]).select("category", "answers", "exact_rate", "failed_median"),
        with_views("expected_elements predicted_elements", f"""WITH {_SCORED} SELECT category, count(*) AS answers, avg(CASE WHEN label = 'correct' THEN 1.0 ELSE 0 END) AS exact_rate,
 median(score) FILTER (label <> 'correct') AS failed_median FROM sco GROUP BY 1""")),
    "ag3_label_counts": (
        lambda s, d: rp.label_counts(_scored(s, d), ["category"]),
        with_views("expected_elements predicted_elements", f"WITH {_SCORED} SELECT category, label, count(*) AS n FROM sco GROUP BY ALL")),
    "ag4_field_summary": (
        lambda s, d: rp.field_summary(_scored(s, d), "category", ["precision", "recall"]),
        with_views("expected_elements predicted_elements", f"""WITH {_OVERLAP}, f AS (SELECT *, answer_id % 7 AS category, {_LABEL.format(p='precision', r='recall')} AS label FROM pr)
 SELECT category, count(*) AS fields, count(*) FILTER (label = 'correct') AS correct, avg(precision) FILTER (label <> 'correct') AS failed_precision, avg(recall) FILTER (label <> 'correct') AS failed_recall FROM f GROUP BY 1""")),
    "ag4_shape_summary": (
        lambda s, d: rp.shape_summary(_shapes(s, d)).select("shape", "fields", "mean_score", "labels", *[f"failed_mean_{m}" for m in rp.FIELD_METRICS]),
        with_views("rollouts", f"""WITH f AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _SHAPE_COLUMNS.items())} FROM rollouts), l AS (SELECT shape, string_agg(label || ':' || n, ',' ORDER BY label) AS labels FROM (SELECT shape, label, count(*) AS n FROM f GROUP BY ALL) GROUP BY 1)
 SELECT f.shape, count(*) AS fields, avg(score) AS mean_score, any_value(labels) AS labels, {", ".join(f"avg({m}) FILTER (label <> 'correct') AS failed_mean_{m}" for m in rp.FIELD_METRICS)} FROM f JOIN l USING (shape) GROUP BY 1""")),
    "ag5_answer_statistics": (
        lambda s, d: rp.answer_statistics(sc.leaves(_docs(s, d))).select("answer_id", "leaves", "fields", "lists", "elements", "longest_list", "depth"),
        with_views("base_items", "SELECT answer_id, 2 * count(*) + 1 AS leaves, 2 AS fields, 1 AS lists, count(*) AS elements, count(*) AS longest_list, 3 AS depth FROM base_items GROUP BY 1")),
    "ag6_distinct_values": (
        lambda s, d: rp.distinct_values(expected_elements(s, d), predicted_elements(s, d)),
        with_views("expected_elements predicted_elements", "SELECT answer_id, count(*) AS n_values FROM (SELECT answer_id, token FROM expected_elements UNION SELECT answer_id, token FROM predicted_elements) GROUP BY 1")),
    "ag7_accuracy_by_label": (
        lambda s, d: rp.accuracy_by_label(_labelled(s, d), rk.latest_verdicts(verdicts(s, d)), [*rk.LEVELS, "unknown"]),
        with_views("instances verdicts", f"""WITH {_LAB}, lv AS (SELECT scope, instance_id, arg_max(passed, run_pos) AS passed FROM verdicts GROUP BY ALL), sp AS (SELECT DISTINCT scope FROM lv),
 m AS (SELECT scope, label, count(*) AS total, count(*) FILTER (passed) AS correct FROM lab JOIN lv USING (instance_id) GROUP BY ALL)
 SELECT scope, label, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, correct / total AS rate FROM sp CROSS JOIN (SELECT unnest(['easy','medium','hard','very_hard','unknown']) AS label) LEFT JOIN m USING (scope, label)""")),
    "ag8_label_distribution": (
        lambda s, d: rp.label_distribution(_labelled(s, d), "category", rk.LEVELS),
        with_views(_I, f"WITH {_LAB} SELECT category, count(*) FILTER (label = 'easy') AS easy, count(*) FILTER (label = 'medium') AS medium, count(*) FILTER (label = 'hard') AS hard, count(*) FILTER (label = 'very_hard') AS very_hard FROM lab GROUP BY 1")),
    "ag9_effort_summary": (
        lambda s, d: rp.effort_summary(rollouts(s, d), ["duration", "tokens", "rollout"], ["model"]),
        with_views(_R, """WITH l AS (SELECT model, 'duration' AS metric, CAST(duration AS DOUBLE) AS v FROM rollouts UNION ALL SELECT model, 'tokens', tokens FROM rollouts UNION ALL SELECT model, 'rollout', rollout FROM rollouts)
 SELECT model, metric, avg(v) AS mean, median(v) AS median, quantile_cont(v, 0.9) AS p90, sum(v) AS total FROM l GROUP BY ALL""")),
    "ag12_instance_means": (
        lambda s, d: rp.instance_means(rollouts(s, d), ["duration", "tokens"]),
        with_views(_R, """WITH b AS (SELECT instance_id, model, count(*) AS n, sum(duration) AS du, sum(tokens) AS tk FROM rollouts GROUP BY ALL)
 SELECT instance_id, sum(n) AS rollouts, sum(du) / sum(n) AS mean_duration, sum(tk) / sum(n) AS mean_tokens, string_agg(model || ':' || n, ',' ORDER BY model) AS by_model FROM b GROUP BY 1""")),
    "ag14_run_totals": (
        lambda s, d: rp.run_totals(verdicts(s, d), ["scope", "run_pos"]),
        with_views(_V, "SELECT scope, run_pos, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM verdicts GROUP BY ALL")),
    "ag15_rollout_fold": (
        lambda s, d: rp.rollout_fold(rollouts(s, d)),
        with_views(_R, """SELECT instance_id, bool_and(passed) AS all_passed, count(*) FILTER (passed) AS pass_count, count(*) AS rollouts, arg_min(reason, rollout) FILTER (NOT passed) AS first_failure,
 CASE WHEN count(*) FILTER (passed) = count(*) THEN 'all' WHEN count(*) FILTER (passed) > 0 THEN 'partial' ELSE 'none' END AS band FROM rollouts GROUP BY 1""")),
    "ag16_instance_costs": (
        lambda s, d: rp.instance_costs(_costs(s, d), rollouts(s, d).where("passed and rollout = 1")),
        with_views(_R, f"""WITH c AS (SELECT instance_id, sum({_COST}) AS cost FROM rollouts GROUP BY 1), k AS (SELECT DISTINCT instance_id FROM rollouts WHERE passed AND rollout = 1)
 SELECT count(*) AS instances, count(k.instance_id) AS survivors, sum(cost) AS cost, sum(cost) / count(*) AS per_instance, sum(cost) / nullif(count(k.instance_id), 0) AS per_survivor FROM c LEFT JOIN k USING (instance_id)""")),
    "ag16_tier_costs": (
        lambda s, d: rp.tier_costs(_costs(s, d).select(F.col("model").alias("tier"), "instance_id", "cost")),
        with_views(_R, f"""WITH c AS (SELECT model AS tier, instance_id, coalesce({_COST}, 0) AS cost FROM rollouts), i AS (SELECT tier, instance_id, count(*) AS rollouts, count(*) FILTER (cost = 0) AS zero, sum(cost) AS cost FROM c GROUP BY ALL)
 SELECT tier, count(*) AS instances, sum(rollouts) AS rollouts, sum(zero) AS zero_cost_rollouts, sum(cost) AS cost, sum(cost) / count(*) AS per_instance, sum(cost) / sum(rollouts) AS per_rollout FROM i GROUP BY ROLLUP (tier)""")),
    "ag16_pipeline_costs": (
        lambda s, d: rp.pipeline_costs(_costs(s, d).where("rollout = 1"), _costs(s, d).where("rollout > 1"), rollouts(s, d).where("passed")),
        with_views(_R, f"""WITH c AS (SELECT instance_id, rollout, passed, {_COST} AS cost FROM rollouts), t AS (SELECT count(DISTINCT instance_id) FILTER (rollout = 1) AS generated, sum(cost) FILTER (rollout = 1) AS generation_cost,
  sum(cost) FILTER (rollout > 1) AS validation_cost, count(DISTINCT instance_id) FILTER (passed) AS kept FROM c)
 SELECT *, generation_cost + validation_cost AS cost, (generation_cost + validation_cost) / generated AS per_generated, (generation_cost + validation_cost) / kept AS per_survivor FROM t""")),
    "ag17_token_cost": (
        lambda s, d: _costs(s, d).select("instance_id", "rollout", "cost"),
        with_views(_R, f"SELECT instance_id, rollout, {_COST} AS cost FROM rollouts")),
    "ag18_cached_split": (
        lambda s, d: rollouts(s, d).select("instance_id", "rollout", *[c.alias(n) for c, n in zip(rp.cached_split(F.col("tokens"), F.col("duration").cast("long") * 40 - 100), ("cached", "uncached"))]),
        with_views(_R, """SELECT instance_id, rollout, least(greatest(CAST(floor(duration) AS BIGINT) * 40 - 100, 0), tokens) AS cached,
 greatest(tokens - least(greatest(CAST(floor(duration) AS BIGINT) * 40 - 100, 0), tokens), 0) AS uncached FROM rollouts""")),
    "ag19_cost_rollup": (
        lambda s, d: rp.cost_rollup(_costs(s, d).withColumn("run", F.col("instance_id") % 20), ["run", "model"]),
        with_views(_R, f"""WITH c AS (SELECT instance_id % 20 AS run, model, {_COST} AS cost FROM rollouts)
 SELECT run, model, grouping(run) * 2 + grouping(model) AS level, count(*) AS calls, count(*) FILTER (cost = 0) AS free_calls, CASE WHEN bool_or(cost IS NULL) THEN NULL ELSE sum(cost) END AS cost FROM c GROUP BY ROLLUP (run, model)""")),
    "ag20_required_profile": (
        lambda s, d: rp.required_profile(line_ranges(s, d), seen_ranges(s, d).select("instance_id", F.concat(F.lit("src/"), "file").alias("file"), F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()),
        with_views("line_ranges seen_ranges", """WITH l AS (SELECT DISTINCT instance_id, file, unnest(range(start_line, end_line + 1)) AS line FROM line_ranges),
 s AS (SELECT DISTINCT instance_id, 'src/' || file AS file, unnest(range(start_line, end_line + 1)) AS line, 1 AS ran FROM seen_ranges),
 r AS (SELECT instance_id, count(*) AS lines, count(ran) AS ran FROM l LEFT JOIN s USING (instance_id, file, line) GROUP BY 1)
 SELECT e.instance_id, count(*) AS entries, count(*) FILTER (necessity = 'essential') AS essential, count(*) FILTER (necessity = 'supporting') AS supporting, any_value(lines) AS lines, any_value(ran / lines) AS executed_share
 FROM line_ranges e JOIN r USING (instance_id) GROUP BY 1""")),
    "ag20_required_description": (
        lambda s, d: rp.required_description(_entries(s, d), _ran(s, d)),
        with_views("line_ranges seen_ranges", f"""WITH {_DESCRIBED} SELECT * FROM de""")),
    "ag20_required_corpus": (
        lambda s, d: rp.required_corpus(rp.required_description(_entries(s, d), _ran(s, d))),
        with_views("line_ranges seen_ranges", f"""WITH {_DESCRIBED}, o AS (SELECT lines, row_number() OVER (ORDER BY lines) AS r, count(*) OVER () AS t FROM de)
 SELECT count(*) AS analysed, (SELECT lines FROM o WHERE r = t // 2 + 1) AS median_lines, avg(reachable_share) AS mean_reachable_share FROM de""")),
    "ag13_verified_scopes": (
        lambda s, d: rp.verified_report(_records(s, d), ["combined", "navigation"], F.col("repository") == "FRANCE"),
        with_views("instances rollouts", f"""WITH r AS (SELECT i.instance_id, repo AS repository, category, i.instance_id % 3 <> 0 AS verified, o.passed IS NOT NULL AS answered, coalesce(o.passed, false) AS ok,
  CASE i.instance_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' WHEN 2 THEN 'medium' END AS combined, CASE WHEN i.instance_id % 5 > 1 THEN 'easy' ELSE 'very_hard' END AS navigation
  FROM instances i LEFT JOIN (SELECT * FROM rollouts WHERE rollout = 2) o USING (instance_id)),
 x AS (SELECT 'strict' AS variant, unnest(['overall', 'repository', 'category', 'difficulty combined', 'difficulty navigation']) AS scope, unnest(['all', repository, category, coalesce(combined, 'unknown'), navigation]) AS name, answered, ok FROM r WHERE verified
  UNION ALL SELECT 'sensitivity', unnest(['overall', 'difficulty combined', 'difficulty navigation']), unnest(['all', coalesce(combined, 'unknown'), navigation]), answered, ok FROM r WHERE verified OR (repository = 'FRANCE' AND NOT answered))
 SELECT variant, scope, name, count(*) AS total, count(*) FILTER (answered) AS answer_files, count(*) FILTER (NOT answered) AS missing_answer_files, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS incorrect, count(*) FILTER (ok) / count(*) AS accuracy FROM x GROUP BY ALL""")),
    "ag13_verified_report": (
        lambda s, d: rp.verified_with_unanswered(instances(s, d).select("instance_id", "repo"), rollouts(s, d).where("rollout = 2").select("instance_id", F.col("passed").alias("correct")), ["repo"]),
        with_views("instances rollouts", """SELECT repo, count(*) AS verified, count(passed) AS answered, count(*) FILTER (passed) AS "right", avg(CASE WHEN coalesce(passed, false) THEN 1.0 ELSE 0 END) AS accuracy
 FROM instances LEFT JOIN (SELECT * FROM rollouts WHERE rollout = 2) USING (instance_id) GROUP BY 1""")),
    "wn1_cutoffs": (
        # two decimals, cut at quarters: four decimals are exact
        lambda s, d: rk.cutoffs(instances(s, d), ["category"]).select("category", "members", *[F.round(q, 4).alias(q) for q in ("q25", "q50", "q75")]),
        with_views(_I, f"WITH {_CUT} SELECT category, members, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75 FROM cut")),
    "wn2_quantile_labels": (
        lambda s, d: _labelled(s, d).select("instance_id", "label"),
        with_views(_I, f"WITH {_LAB} SELECT instance_id, label FROM lab")),
    "wn3_frozen_labels": (
        lambda s, d: rk.frozen_labels(instances(s, d).select("instance_id", "archetype", "score"), s.createDataFrame([("1-URGENT", 5e4, 1e5, 2e5), ("2-HIGH", 4e4, 9e4, 1.5e5)], "archetype string, q25 double, q50 double, q75 double"), "archetype").select("instance_id", "label"),
        with_views(_I, """SELECT instance_id, CASE WHEN q25 IS NULL THEN 'medium' WHEN score <= q25 THEN 'easy' WHEN score <= q50 THEN 'medium' WHEN score >= q75 THEN 'very_hard' ELSE 'hard' END AS label
 FROM instances LEFT JOIN (VALUES ('1-URGENT', 5e4, 1e5, 2e5), ('2-HIGH', 4e4, 9e4, 1.5e5)) AS t(archetype, q25, q50, q75) USING (archetype)""")),
    "wn4_percentile_ranks": (
        lambda s, d: rk.percentile_ranks(rollouts(s, d).select("model", "instance_id", "rollout", "duration"), ["model"], "duration"),
        with_views(_R, """SELECT model, instance_id, rollout, duration, CASE WHEN count(*) OVER (PARTITION BY model) = 1 THEN 5.0 ELSE
 10.0 * (rank() OVER (PARTITION BY model ORDER BY duration) - 1 + (count(*) OVER (PARTITION BY model, duration) - 1) / 2) / (count(*) OVER (PARTITION BY model) - 1) END AS rank10 FROM rollouts""")),
    "wn5_weighted_effort": (
        lambda s, d: rk.quantile_labels(rk.weighted_effort(_effort(s, d), "model", EFFORT_WEIGHTS, "k"), ["model"], "effort").select("k", "effort", "label"),
        with_views(_R, """WITH e AS (SELECT instance_id * 100 + rollout AS k, model, duration AS exploration, tokens AS execution, tokens % 97 AS deliberation, instance_id % 11 AS friction, rollout AS resources FROM rollouts),
 r AS (SELECT k, model, round(""" + " + ".join(
            f"{w}::DECIMAL(5,4) * CAST(round(10.0 * (rank() OVER (PARTITION BY model ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY model, {c}) - 1) / 2) / (count(*) OVER (PARTITION BY model) - 1), 3) AS DECIMAL(9,3))"
            for c, w in (("exploration", 0.25), ("execution", 0.25), ("deliberation", 0.25), ("friction", 0.10), ("resources", 0.15))) + """, 3)::DOUBLE AS effort FROM e),
 c AS (SELECT model, quantile_cont(effort, 0.25) AS q25, quantile_cont(effort, 0.5) AS q50, quantile_cont(effort, 0.75) AS q75, count(*) AS members FROM r GROUP BY 1)
 SELECT k, effort, CASE WHEN effort <= q25 THEN 'easy' WHEN effort <= q50 THEN 'medium' WHEN effort >= q75 THEN 'very_hard' ELSE 'hard' END AS label FROM r JOIN c USING (model)""")),
    "wn6_outcome_labels": (
        lambda s, d: rk.relabel_by_outcome(_labelled(s, d), "category", "score2", "instance_id").select("instance_id", "label", "outcome_label"),
        with_views(_I, f"""WITH {_LAB}, z AS (SELECT category, label, count(*) AS n, list_position(['easy','medium','hard','very_hard'], label) AS l FROM lab GROUP BY ALL),
 sp AS (SELECT category, label AS outcome_label, sum(n) OVER (PARTITION BY category ORDER BY l) AS t, n FROM z),
 r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score2 DESC, instance_id) AS rn FROM lab)
 SELECT instance_id, label, outcome_label FROM r JOIN sp ON r.category = sp.category AND rn > t - n AND rn <= t""")),
    "wn7_latest_verdicts": (
        lambda s, d: rk.latest_verdicts(verdicts(s, d)),
        with_views(_V, "SELECT scope, instance_id, arg_max(passed, run_pos) AS passed FROM verdicts GROUP BY ALL")),
    "wn9_sample_first": (
        lambda s, d: rk.sample_first(instances(s, d).select("category", "instance_id"), "category", "instance_id", 7),
        with_views(_I, "SELECT category, instance_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY instance_id) AS r FROM instances) WHERE r <= 7")),
    "wn10_eligibility": (
        lambda s, d: rk.eligibility(_metrics(s, d), rk.category_rules(), "p_partkey"),
        f"""WITH m AS ({_METRICS_SQL}) SELECT p_partkey, 'S1_IntraProceduralCFG' AS category, branches * 2 + boolops + returns AS affinity FROM m WHERE branches >= 2
 UNION ALL SELECT p_partkey, 'S2_Loops', loops * 2 + while_loops * 2 + max_loop_nesting * 3 + breaks_continues FROM m WHERE loops >= 1
 UNION ALL SELECT p_partkey, 'S3_ProgramState', assigns + augassigns * 2 + branches FROM m WHERE assigns + augassigns >= 4
 UNION ALL SELECT p_partkey, 'S4_DataFlow', assigns + branches * 2 + loops FROM m WHERE assigns >= 3 AND branches >= 1
 UNION ALL SELECT p_partkey, 'S5_Exceptions', raises * 2 + excepts * 2 + finallys * 3 + branches FROM m WHERE raises + excepts >= 1
 UNION ALL SELECT p_partkey, 'S6_InterProceduralCFG', num_local_calls * 3 + branches FROM m WHERE num_local_calls >= 1
 UNION ALL SELECT p_partkey, 'M1_IntraProceduralCFG', branches * 2 + boolops * 2 + returns + body_lines / 10 FROM m WHERE branches >= 4
 UNION ALL SELECT p_partkey, 'M2_Loops', loops * 2 + max_loop_nesting * 4 + breaks_continues * 2 FROM m WHERE loops >= 2 OR max_loop_nesting >= 2
 UNION ALL SELECT p_partkey, 'M3_ProgramState', assigns + augassigns * 2 + branches * 2 + loops FROM m WHERE assigns + augassigns >= 6
 UNION ALL SELECT p_partkey, 'M4_DataFlow', assigns * 2 + branches * 2 + loops * 2 FROM m WHERE assigns >= 5 AND branches >= 2
 UNION ALL SELECT p_partkey, 'M5_Exceptions', raises * 2 + excepts * 3 + finallys * 3 + num_local_calls FROM m WHERE raises + excepts >= 2
 UNION ALL SELECT p_partkey, 'M6_InterProceduralCFG', num_local_calls * 4 + branches + excepts FROM m WHERE num_local_calls >= 2
 UNION ALL SELECT p_partkey, 'M7_Invariants', loops * 2 + augassigns * 3 + assigns + max_loop_nesting * 2 FROM m WHERE loops >= 1 AND assigns + augassigns >= 3"""),
    "wn11_capped_candidates": (
        lambda s, d: rk.capped_candidates(table(s, d, "part").select("p_partkey", "p_brand", "p_size", F.col("p_retailprice").alias("score")), [(["p_brand", "p_size"], 2), (["p_brand"], 30), ([], 300)], "score", "p_partkey").select("p_partkey"),
        """WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS r1 FROM part),
 b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r2 FROM a WHERE r1 <= 2),
 c AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r3 FROM b WHERE r2 <= 30) SELECT p_partkey FROM c WHERE r3 <= 300"""),
    "wn12_quotas": (
        lambda s, d: rk.share_slots(rk.quota_split(instances(s, d).groupBy("category").agg(F.count("*").alias("n")), 43), 0.3),
        with_views(_I, """WITH g AS (SELECT category, count(*) AS n FROM instances GROUP BY 1), k AS (SELECT count(*) AS k FROM g),
 q AS (SELECT category, n, 43 // k + CASE WHEN row_number() OVER (ORDER BY n DESC, category) <= 43 % k THEN 1 ELSE 0 END AS quota FROM g CROSS JOIN k),
 x AS (SELECT *, quota * 0.3 AS e, CAST(floor(quota * 0.3) AS BIGINT) AS f FROM q),
 l AS (SELECT *, round_even(sum(e) OVER (), 0) - sum(f) OVER () AS rest, row_number() OVER (ORDER BY e - f DESC, quota DESC, category) AS r FROM x)
 SELECT category, n, quota, least(f + CASE WHEN r <= rest THEN 1 ELSE 0 END, quota) AS slots FROM l""")),
    "wn13_target_ranks": (
        lambda s, d: table(s, d, "part").withColumn("score", F.col("p_size") * 2 + F.length("p_name")).select("p_partkey", "score", rp.first_by([F.desc("score"), F.col("p_partkey")], "p_brand").alias("place")),
        "SELECT p_partkey, p_size * 2 + length(p_name) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * 2 + length(p_name) DESC, p_partkey) AS place FROM part"),
    "wn14_best_attempts": (
        lambda s, d: rk.best_attempts(attempts(s, d), "source_id", "attempt_id").select("source_id", "attempt_id"),
        with_views("rollouts", f"""WITH a AS ({ATTEMPTS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(flipped, false) DESC, coalesce(target_met, false) DESC,
 coalesce(increased, false) DESC, coalesce(delta, 0) DESC, coalesce(oracle_changed, false) AND coalesce(trace_changed, false) DESC, coalesce(oracle_changed, false) DESC, coalesce(trace_changed, false) DESC,
 new_lines + new_edges DESC, new_edges DESC, attempt_id) AS rn FROM a) SELECT source_id, attempt_id FROM r WHERE rn = 1""")),
    "st3_set_agreement": (
        lambda s, d: st.set_agreement(expected_elements(s, d), predicted_elements(s, d), ["answer_id"], ["pos"]),
        with_views("expected_elements predicted_elements", """WITH b AS (SELECT answer_id, a, b FROM (SELECT answer_id, pos, 1 AS a FROM expected_elements) FULL JOIN (SELECT answer_id, pos, 1 AS b FROM predicted_elements) USING (answer_id, pos))
 SELECT answer_id, count(*) AS "union", count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*) AS jaccard,
 count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*) < 0.95 AS flagged FROM b GROUP BY 1""")),
    "st5_spearman": (
        lambda s, d: st.spearman(rollouts(s, d).select("model", "duration", "tokens"), "duration", "tokens", ["model"]).withColumn("rho", F.round("rho", 8)),
        with_views(_R, """WITH r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY duration) + (count(*) OVER (PARTITION BY model, duration) - 1) / 2 AS x,
 rank() OVER (PARTITION BY model ORDER BY tokens) + (count(*) OVER (PARTITION BY model, tokens) - 1) / 2 AS y FROM rollouts) SELECT model, round(corr(x, y), 8) AS rho, count(*) AS n FROM r GROUP BY 1""")),
    "st6_confusion": (
        lambda s, d: st.confusion(_rank_pairs(s, d)),
        with_views(_I, f"WITH {_PAIRS} SELECT a, b, n FROM cells")),
    "st7_agreement": (
        lambda s, d: st.agreement(_rank_pairs(s, d)),
        with_views(_I, f"""WITH {_PAIRS}, t AS (SELECT sum(n) AS t FROM cells), ma AS (SELECT i, sum(n) AS ra FROM cells GROUP BY 1), mb AS (SELECT j, sum(n) AS cb FROM cells GROUP BY 1),
 e AS (SELECT sum(CASE WHEN i = j THEN ra * cb / t / t ELSE 0 END) AS chance, sum((i - j) ** 2 * ra * cb / t) AS we FROM ma CROSS JOIN mb CROSS JOIN t)
 SELECT sum(n) AS n, sum(CASE WHEN i = j THEN n ELSE 0 END) / sum(n) AS exact, sum(CASE WHEN abs(i - j) <= 1 THEN n ELSE 0 END) / sum(n) AS within_one, any_value(chance) AS chance, 1 - sum((i - j) ** 2 * n) / any_value(we) AS kappa FROM cells CROSS JOIN e""")),
    "st8_outcome_by_label": (
        lambda s, d: st.outcome_by_label(_labelled(s, d).select("instance_id", "label"), rollouts(s, d), rollouts(s, d).groupBy("instance_id", "model").agg(F.bool_and("passed").alias("passed"), F.avg(F.col("passed").cast("double")).alias("partial"))),
        with_views("instances rollouts", f"""WITH {_LAB}, m AS (SELECT DISTINCT model FROM rollouts), s AS (SELECT instance_id, model, bool_and(passed) AS passed, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS partial FROM rollouts GROUP BY ALL)
 SELECT model, label, count(*) AS n, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS exact_rate, avg(coalesce(partial, 0)) AS mean_score FROM lab CROSS JOIN m LEFT JOIN s USING (instance_id, model) GROUP BY ALL""")),
    "st10_choose_alpha": (
        lambda s, d: st.choose_alpha(instances(s, d).withColumn("success", F.col("score") % 7 / 7).withColumn("fold", F.col("instance_id") % 5), ["score", "score2"], "archetype", "success", "fold", [0.1, 10.0]), None),
    "st12_component_scores": (
        lambda s, d: table(s, d, "part").select("p_partkey", st.saturating(F.col("p_size"), 12.0).alias("semantic"), st.weighted_score([(st.saturating(F.col("p_size"), 5.0), 0.5), (st.saturating(F.col("p_retailprice"), 900.0), 0.5)]).alias("answer")),
        """SELECT p_partkey, least(greatest(10 * (1 - exp(-p_size / 12.0::DOUBLE)), 0), 10) AS semantic, least(greatest(0.5 * (10 * (1 - exp(-p_size / 5.0::DOUBLE))) + 0.5 * (10 * (1 - exp(-p_retailprice / 900.0::DOUBLE))), 0), 10) AS answer FROM part"""),
    "st12_semantic_scores": (
        lambda s, d: _metrics(s, d).select("p_partkey", *[v.alias(k) for k, v in st.semantic_components().items()], st.semantic_score(st.semantic_components()).alias("semantic")),
        f"WITH m AS ({_METRICS_SQL}), {_SEMANTIC_SQL} SELECT p_partkey, control_flow, state_tracking, interprocedural, exception_semantics, execution_workload, semantic FROM sc"),
    "st14_difficulty_scores": (
        lambda s, d: _metrics(s, d).select("p_partkey", st.semantic_score(st.semantic_components()).alias("semantic"), st.navigation_score().alias("navigation")).withColumn(
            "combined", st.mixed_scores((0.40, F.col("semantic")), (0.35, F.lit(5)), (0.25, F.col("navigation")))),
        f"""WITH m AS ({_METRICS_SQL}), {_SEMANTIC_SQL},
 nv AS (SELECT *, 0.35 * CASE exercise_mode WHEN 'direct' THEN 1.5 WHEN 'indirect' THEN 7.0 ELSE 4.0 END + 0.2 * round(10 * (1 - exp(-greatest(0, relevant_files - 1) / 2.5::DOUBLE)), 3)::DECIMAL(9,3) + 0.2 * round(10 * (1 - exp(-greatest(0, relevant_functions - 1) / 6::DOUBLE)), 3)::DECIMAL(9,3)
  + 0.15 * round(10 * (1 - exp(-(imports + test_calls / 8 + source_lines / 40) / 8::DOUBLE)), 3)::DECIMAL(9,3) + 0.1 * round(10 * (1 - exp(-callers / 5::DOUBLE)), 3)::DECIMAL(9,3) AS su FROM sc), nw AS (SELECT *, round(su, 3) AS support FROM nv),
 nx AS (SELECT *, round(0.7 * (10 - support) + 0.3 * round(10 * (1 - exp(-distinct_lines / 75::DOUBLE)), 3)::DECIMAL(9,3), 3) AS navigation FROM nw)
 SELECT p_partkey, semantic, navigation, round(0.4 * semantic + 0.35 * 5 + 0.25 * navigation, 3) AS combined FROM nx"""),
    "st14_combined_score": (
        lambda s, d: instances(s, d).select("instance_id", st.combined_score(st.saturating(F.col("score"), 1e5), st.saturating(F.col("score2") + 1000, 5e3), F.lit(5.0)).alias("combined")),
        with_views(_I, "SELECT instance_id, 0.40 * least(greatest(10 * (1 - exp(-score / 1e5)), 0), 10) + 0.35 * least(greatest(10 * (1 - exp(-(score2 + 1000) / 5e3)), 0), 10) + 0.25 * 5 AS combined FROM instances")),
    "st11_calibrated": (
        lambda s, d: instances(s, d).select("instance_id", st.calibrated({"score": (11.0, 1.2, -0.08)}, 0.6, F.when(F.col("archetype") == "1-URGENT", 0.05)).alias("difficulty")),
        with_views(_I, "SELECT instance_id, 10 * (1 - (0.6 + -0.08 * ((ln(1 + score) - 11.0) / 1.2) + CASE WHEN archetype = '1-URGENT' THEN 0.05 ELSE 0 END)) AS difficulty FROM instances")),
}

"""Queries over traces with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calltree as ct
from ..operators import trace as tr
from ..sources.fixtures import table, trace_events, with_views

DEFS = [(line, f"v{line % 3}") for line in range(10, 30, 5)]
USES = [(line, f"v{line % 3}") for line in range(10, 30) if line % 5 in (1, 2, 0)]
TRIES = [(10, 14, 20, 29, "ValueError"), (15, 19, 10, 14, "KeyError"), (20, 29, 15, 19, "OSError")]
PREDICATES = {"x_below_12": (11, "state < 12"), "x_even": (14, "state % 2 = 0"), "x_natural": (17, "state >= 0"), "never_seen": (99, "state > 0")}

_TE = "trace_events"
_INV = "inv AS (SELECT *, sum(CASE WHEN event = 'call' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, func ORDER BY seq) AS inv FROM trace_events)"
_CARRY = _INV + ", carry AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY trace_id, func, inv ORDER BY seq ROWS UNBOUNDED PRECEDING) AS state FROM inv)"
_DEPTH = """d0 AS (SELECT *, sum(CASE event WHEN 'call' THEN 1 WHEN 'return' THEN -1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS s FROM trace_events),
 deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS depth FROM d0)"""
_TRANS = """nx AS (SELECT trace_id, file || ':' || line AS src, lead(file || ':' || line) OVER (PARTITION BY trace_id ORDER BY seq) AS dst FROM trace_events WHERE event = 'line'),
 tc AS (SELECT trace_id, src, dst, count(*) AS n FROM nx WHERE dst IS NOT NULL GROUP BY ALL)"""


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({names})"


_DU = _INV + f""", l AS (SELECT trace_id, func, inv, seq, line FROM inv WHERE event = 'line' AND inv > 0),
 b AS (SELECT l.*, variable, 0 AS kind FROM l JOIN {_values(USES, 'ln, variable')} ON line = ln
  UNION ALL SELECT l.*, variable, 1 FROM l JOIN {_values(DEFS, 'ln, variable')} ON line = ln),
 du0 AS (SELECT *, last_value(CASE WHEN kind = 1 THEN line END IGNORE NULLS) OVER w AS def_line, last_value(CASE WHEN kind = 1 THEN seq END IGNORE NULLS) OVER w AS def_seq
  FROM b WINDOW w AS (PARTITION BY trace_id, func, inv, variable ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 du AS (SELECT * FROM du0 WHERE kind = 0 AND def_line IS NOT NULL)"""


def _frames(spark):
    return spark.createDataFrame(DEFS, "line int, variable string"), spark.createDataFrame(USES, "line int, variable string")


def _scope(spark, sf):
    return trace_events(spark, sf).select("func").distinct().union(spark.createDataFrame([("f9",)], "func string"))


QUERIES = {
    "tr4_target_filter": (
        lambda s, d: trace_events(s, d).where(tr.target_filter("mod_3", "f1")).groupBy("trace_id").agg(F.count("*").alias("n")),
        with_views(_TE, "SELECT trace_id, count(*) AS n FROM trace_events WHERE contains(file, 'mod_3') AND func = 'f1' GROUP BY 1")),
    "tr5_test_blocks": (
        lambda s, d: tr.blocks(trace_events(s, d), F.col("event") == "call").groupBy("trace_id", "block").agg(F.count("*").alias("n")),
        with_views(_TE, "WITH b AS (SELECT trace_id, sum(CASE WHEN event = 'call' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS block FROM trace_events) SELECT trace_id, block, count(*) AS n FROM b GROUP BY ALL")),
    "tr6_invocations": (
        lambda s, d: tr.invocations(trace_events(s, d)).groupBy("trace_id", "func", "inv").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")),
        with_views(_TE, f"WITH {_INV} SELECT trace_id, func, inv, count(*) AS n, min(seq) AS first_seq FROM inv GROUP BY ALL")),
    "tr7_call_depth": (
        lambda s, d: tr.call_depth(trace_events(s, d)).groupBy("trace_id").agg(F.max("depth").alias("max_depth"), F.sum("depth").alias("depth_sum")),
        with_views(_TE, f"WITH {_DEPTH} SELECT trace_id, max(depth) AS max_depth, sum(depth) AS depth_sum FROM deep GROUP BY 1")),
    "tr8_activations": (lambda s, d: ct.activations(trace_events(s, d)), None),
    "tr9_event_statistics": (
        lambda s, d: tr.event_statistics(trace_events(s, d)),
        with_views(_TE, """WITH h AS (SELECT trace_id, max(n) AS max_line_hits FROM (SELECT trace_id, file, line, count(*) FILTER (event = 'line') AS n FROM trace_events GROUP BY ALL) GROUP BY 1)
 SELECT trace_id, count(*) AS events, count(*) FILTER (event = 'call') AS call_events, count(*) FILTER (event = 'line') AS line_events,
 count(*) FILTER (event = 'return') AS return_events, count(*) FILTER (event = 'exception') AS exception_events,
 count(DISTINCT file || ':' || line) AS lines, count(DISTINCT func) AS functions, any_value(max_line_hits) AS max_line_hits FROM trace_events JOIN h USING (trace_id) GROUP BY 1""")),
    "tr10_line_transitions": (
        lambda s, d: tr.transition_features(trace_events(s, d)),
        with_views(_TE, f"""WITH {_TRANS}, o AS (SELECT trace_id, src, count(*) AS k FROM tc GROUP BY ALL)
 SELECT trace_id, sum(k) AS transitions, count(*) FILTER (k > 1) AS branch_points, sum(CASE WHEN k > 1 THEN k - 1 ELSE 0 END) AS branch_alternatives FROM o GROUP BY 1""")),
    "tr11_transition_entropy": (
        lambda s, d: tr.transition_entropy(trace_events(s, d)).select("trace_id", F.round("entropy", 9).alias("entropy")),
        with_views(_TE, f"""WITH {_TRANS}, t AS (SELECT trace_id, sum(n) AS total, count(*) AS kinds FROM tc GROUP BY 1)
 SELECT trace_id, round(CASE WHEN max(kinds) <= 1 THEN 0 ELSE -sum((n / total) * log2(n / total)) / log2(max(kinds)) END, 9) AS entropy FROM tc JOIN t USING (trace_id) GROUP BY 1""")),
    "tr12_state_changes": (
        lambda s, d: tr.state_changes(trace_events(s, d), F.col("x").isNotNull()),
        with_views(_TE, "SELECT trace_id, count(*) FILTER (event = 'line' AND x IS NOT NULL) AS state_changes FROM trace_events GROUP BY 1")),
    "tr13_executed_path": (
        lambda s, d: tr.executed_path(trace_events(s, d), "f1", 1).select("trace_id", F.array_join("lines", ",").alias("path")),
        with_views(_TE, f"WITH {_INV} SELECT trace_id, string_agg(line, ',' ORDER BY seq) AS path FROM inv WHERE func = 'f1' AND inv = 1 AND event = 'line' GROUP BY 1")),
    "tr14_loop_iterations": (
        lambda s, d: tr.loop_iterations(trace_events(s, d), "f2", 16),
        with_views(_TE, f"WITH {_INV} SELECT trace_id, inv, count(*) FILTER (event = 'line' AND line = 16) AS iterations FROM inv WHERE func = 'f2' AND inv > 0 GROUP BY ALL")),
    "tr15_value_after_iteration": (
        lambda s, d: tr.value_after_iteration(trace_events(s, d), "f2", 16, 1),
        with_views(_TE, f"""WITH {_CARRY}, a AS (SELECT *, lead(state) OVER (PARTITION BY trace_id, inv ORDER BY seq) AS value FROM carry WHERE func = 'f2' AND inv > 0),
 h AS (SELECT *, row_number() OVER (PARTITION BY trace_id, inv ORDER BY seq) AS k FROM a WHERE event = 'line' AND line = 16) SELECT trace_id, inv, value FROM h WHERE k = 1""")),
    "tr16_iteration_extremes": (
        lambda s, d: tr.iteration_extremes(trace_events(s, d), "f2", 16),
        with_views(_TE, f"""WITH {_INV}, i AS (SELECT trace_id, inv, count(*) FILTER (event = 'line' AND line = 16) AS n FROM inv WHERE func = 'f2' AND inv > 0 GROUP BY ALL)
 SELECT trace_id, max(n) AS max_iterations, min(n) AS min_iterations, sum(n) AS total_iterations FROM i GROUP BY 1""")),
    "tr17_line_counts": (
        lambda s, d: tr.line_counts(trace_events(s, d), 8, 31),
        with_views(_TE, """SELECT t.trace_id, r.line, count(e.seq) AS hits FROM (SELECT DISTINCT trace_id FROM trace_events) t CROSS JOIN (SELECT unnest(range(8, 32)) AS line) r
 LEFT JOIN trace_events e ON e.trace_id = t.trace_id AND e.line = r.line AND e.event = 'line' GROUP BY ALL""")),
    "tr18_line_coverage": (
        lambda s, d: tr.line_coverage(trace_events(s, d), "f1", 8, 31),
        with_views(_TE, f"""WITH {_INV}, o AS (SELECT * FROM inv WHERE func = 'f1' AND inv > 0), t AS (SELECT count(*) AS total FROM (SELECT DISTINCT trace_id, inv FROM o)),
 n AS (SELECT line, count(*) AS n FROM (SELECT DISTINCT trace_id, inv, line FROM o WHERE event = 'line') GROUP BY 1)
 SELECT r.line, CASE WHEN n IS NULL THEN 'never' WHEN n = total THEN 'always' ELSE 'sometimes' END AS coverage FROM (SELECT unnest(range(8, 32)) AS line) r CROSS JOIN t LEFT JOIN n USING (line)""")),
    "tr19_carried_state": (
        lambda s, d: tr.carried_state(trace_events(s, d)).select("trace_id", "seq", "func", "inv", "state"),
        with_views(_TE, f"WITH {_CARRY} SELECT trace_id, seq, func, inv, state FROM carry")),
    "tr20_observed_values": (
        lambda s, d: tr.observed_values(trace_events(s, d), "f3", 17, 1),
        with_views(_TE, f"""WITH {_CARRY}, h AS (SELECT *, row_number() OVER (PARTITION BY trace_id, inv ORDER BY seq) AS k FROM carry WHERE func = 'f3' AND inv > 0 AND event = 'line' AND line = 17)
 SELECT trace_id, inv, state AS value FROM h WHERE k = 1""")),
    "tr21_variable_history": (
        lambda s, d: tr.variable_history(trace_events(s, d), [10, 15, 20, 25]),
        with_views(_TE, f"""WITH {_CARRY}, a AS (SELECT *, lead(state) OVER (PARTITION BY trace_id, func, inv ORDER BY seq) AS value FROM carry WHERE inv > 0)
 SELECT trace_id, func, inv, seq, value FROM a WHERE event = 'line' AND line IN (10, 15, 20, 25)""")),
    "tr22_unique_values": (
        lambda s, d: tr.unique_values(trace_events(s, d)).select("trace_id", F.array_join("vals", ",").alias("vals"), "min_value", "max_value"),
        with_views(_TE, """WITH u AS (SELECT DISTINCT trace_id, x FROM trace_events WHERE x IS NOT NULL)
 SELECT trace_id, string_agg(x, ',' ORDER BY x) AS vals, min(x) AS min_value, max(x) AS max_value FROM u GROUP BY 1""")),
    "tr23_def_use_pairs": (
        lambda s, d: tr.def_use_counts(trace_events(s, d), *_frames(s)).select("variable", "def_line", "use_line"),
        with_views(_TE, f"WITH {_DU} SELECT DISTINCT variable, def_line, line AS use_line FROM du")),
    "tr24_def_use_counts": (
        lambda s, d: tr.def_use_counts(trace_events(s, d), *_frames(s)),
        with_views(_TE, f"WITH {_DU} SELECT variable, def_line, line AS use_line, count(*) AS n FROM du GROUP BY ALL")),
    "tr25_dead_definitions": (
        lambda s, d: tr.dead_definitions(trace_events(s, d), *_frames(s)),
        with_views(_TE, f"""WITH {_DU} SELECT DISTINCT trace_id, func, inv, variable, line FROM b WHERE kind = 1 AND NOT EXISTS
 (SELECT 1 FROM du WHERE du.trace_id = b.trace_id AND du.func = b.func AND du.inv = b.inv AND du.variable = b.variable AND du.def_seq = b.seq)""")),
    "tr26_exception_counts": (
        lambda s, d: tr.exception_counts(trace_events(s, d), F.concat(F.lit("E"), (F.col("line") % 3).cast("string"))),
        with_views(_TE, "SELECT 'E' || (line % 3) AS exception_type, count(*) AS n FROM trace_events WHERE event = 'exception' GROUP BY 1")),
    "tr27_escaping_exceptions": (
        lambda s, d: tr.escaping_exceptions(trace_events(s, d)),
        with_views(_TE, f"""WITH {_INV}, a AS (SELECT *, lead(event) OVER (PARTITION BY trace_id, func, inv ORDER BY seq) AS nx FROM inv WHERE inv > 0)
 SELECT trace_id, func, inv, seq, line FROM a WHERE event = 'exception' AND nx = 'return'""")),
    "tr28_caught_exceptions": (
        lambda s, d: tr.caught_exceptions(trace_events(s, d), s.createDataFrame(TRIES, "try_first int, try_last int, handler_first int, handler_last int, kind string")),
        with_views(_TE, f"""WITH {_INV}, a AS (SELECT *, lead(event) OVER w AS nx, lead(line) OVER w AS nl FROM inv WHERE inv > 0 WINDOW w AS (PARTITION BY trace_id, func, inv ORDER BY seq))
 SELECT trace_id, seq, kind FROM a JOIN {_values(TRIES, 'tf, tl, hf, hl, kind')} ON line BETWEEN tf AND tl AND nl BETWEEN hf AND hl WHERE event = 'exception' AND nx = 'line'""")),
    "tr29_crash_matrix": (
        lambda s, d: tr.crash_matrix(trace_events(s, d), F.col("event") == "call", F.concat(F.lit("E"), (F.col("line") % 3).cast("string"))),
        with_views(_TE, """WITH b AS (SELECT *, sum(CASE WHEN event = 'call' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS block FROM trace_events)
 SELECT trace_id, block, arg_max('E' || (line % 3), seq) FILTER (event = 'exception') AS exception_type FROM b GROUP BY ALL""")),
    "tr30_calls_during": (
        lambda s, d: tr.calls_during(trace_events(s, d), "f1", 1),
        with_views(_TE, f"""WITH {_DEPTH}, c AS (SELECT *, row_number() OVER (PARTITION BY trace_id, func ORDER BY seq) AS k FROM deep WHERE event = 'call'),
 bg AS (SELECT trace_id, seq AS f, depth AS dp FROM c WHERE func = 'f1' AND k = 1),
 en AS (SELECT bg.trace_id, min(seq) AS t FROM deep JOIN bg USING (trace_id) WHERE seq > f AND depth < dp GROUP BY 1),
 fl AS (SELECT func, min(line) AS ln FROM c GROUP BY 1)
 SELECT c.trace_id, seq, c.func AS callee FROM c JOIN bg USING (trace_id) LEFT JOIN en USING (trace_id) JOIN fl ON fl.func = c.func WHERE seq > f AND (t IS NULL OR seq < t) AND line = ln""")),
    "tr31_call_counts": (
        lambda s, d: tr.call_counts(trace_events(s, d), _scope(s, d)),
        with_views(_TE, "SELECT s.func, count(e.seq) AS calls FROM (SELECT DISTINCT func FROM trace_events UNION ALL SELECT 'f9') s LEFT JOIN trace_events e ON e.func = s.func AND event = 'call' GROUP BY 1")),
    "tr32_covered_functions": (
        lambda s, d: tr.covered_functions(trace_events(s, d), _scope(s, d)),
        with_views(_TE, "SELECT DISTINCT func FROM trace_events WHERE event = 'call'")),
    "tr33_direct_callers": (
        lambda s, d: tr.direct_callers(trace_events(s, d), "f2"),
        with_views(_TE, """WITH d0 AS (SELECT *, sum(CASE event WHEN 'call' THEN 1 WHEN 'return' THEN -1 WHEN 'exception' THEN -1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS s FROM trace_events),
 deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS level FROM d0),
 c AS (SELECT * FROM deep WHERE event = 'call')
 SELECT caller, count(*) AS calls FROM (SELECT (SELECT arg_max(p.func, p.seq) FROM c p WHERE p.trace_id = c.trace_id AND p.level = c.level - 1 AND p.seq < c.seq) AS caller FROM c WHERE func = 'f2') WHERE caller IS NOT NULL GROUP BY 1""")),
    "tr34_invariants": (
        lambda s, d: tr.invariant_report(trace_events(s, d), PREDICATES),
        with_views(_TE, f"""WITH {_CARRY}, p AS (SELECT * FROM {_values([(n, l) for n, (l, _) in PREDICATES.items()], 'predicate, ln')}),
 o AS (SELECT predicate, CASE predicate {' '.join(f"WHEN '{n}' THEN {e}" for n, (_, e) in PREDICATES.items())} END AS holds FROM carry JOIN p ON line = ln WHERE event = 'line' AND state IS NOT NULL)
 SELECT p.predicate, count(holds) AS observations, count(*) FILTER (NOT holds) AS violations, count(holds) > 0 AND count(*) FILTER (NOT holds) = 0 AS held_always FROM p LEFT JOIN o USING (predicate) GROUP BY 1""")),
    "st1_new_lines": (
        lambda s, d: tr.lines_beyond_first(trace_events(s, d)),
        with_views(_TE, """WITH l AS (SELECT DISTINCT trace_id, file, line FROM trace_events WHERE event = 'line'), b AS (SELECT file, min(trace_id) AS b FROM l GROUP BY 1)
 SELECT l.trace_id, l.file, l.line FROM l JOIN b USING (file) WHERE NOT EXISTS (SELECT 1 FROM l AS x WHERE x.trace_id = b.b AND x.file = l.file AND x.line = l.line)""")),
    "st1_new_edges": (
        lambda s, d: tr.edges_beyond_first(trace_events(s, d)),
        with_views(_TE, """WITH w AS (SELECT trace_id, file, func, lag(line) OVER (PARTITION BY trace_id, file, func ORDER BY seq) AS src, line AS dst FROM trace_events),
 e AS (SELECT DISTINCT trace_id, file, func, src, dst FROM w WHERE src <> dst), b AS (SELECT file, min(trace_id) AS b FROM e GROUP BY 1)
 SELECT e.trace_id, e.file, e.func, e.src, e.dst FROM e JOIN b USING (file) WHERE NOT EXISTS (SELECT 1 FROM e AS x WHERE x.trace_id = b.b AND x.file = e.file AND x.func = e.func AND x.src = e.src AND x.dst = e.dst)""")),
    "st1_first_seen_lines": (
        lambda s, d: tr.first_seen_lines(trace_events(s, d)),
        with_views(_TE, "SELECT min(trace_id) AS trace_id, file, line FROM trace_events WHERE event = 'line' GROUP BY file, line")),
    "st1_first_seen_edges": (
        lambda s, d: tr.first_seen_edges(trace_events(s, d)),
        with_views(_TE, """WITH e AS (SELECT trace_id, file, func, lag(line) OVER (PARTITION BY trace_id, file, func ORDER BY seq) AS src, line AS dst FROM trace_events)
 SELECT min(trace_id) AS trace_id, file, func, src, dst FROM e WHERE src <> dst GROUP BY file, func, src, dst""")),
    "st2_equal_paths": (
        lambda s, d: tr.equal_paths(trace_events(s, d).unionByName(trace_events(s, d).where("line % 2 = 0").withColumns({"trace_id": F.expr("-1 - trace_id % 7"), "seq": F.expr("seq * 1000 + trace_id div 7")}))),
        with_views(_TE, """WITH t AS (SELECT trace_id, seq, file, line, event FROM trace_events UNION ALL SELECT -1 - trace_id % 7, seq * 1000 + trace_id // 7, file, line, event FROM trace_events WHERE line % 2 = 0),
 p AS (SELECT trace_id, count(*) AS steps, string_agg(file || ':' || line, ',' ORDER BY seq, file, line) AS path FROM t WHERE event = 'line' GROUP BY 1)
 SELECT trace_id, steps, min(trace_id) OVER (PARTITION BY path) AS first, count(*) OVER (PARTITION BY path) AS traces FROM p""")),
    "st4_line_sets": (
        lambda s, d: trace_events(s, d).where("event = 'line'").groupBy("line").agg(F.count_distinct("trace_id").alias("traces")).select(
            "line", "traces", (F.col("traces") == 1).alias("only_one")),
        with_views(_TE, "SELECT line, count(DISTINCT trace_id) AS traces, count(DISTINCT trace_id) = 1 AS only_one FROM trace_events WHERE event = 'line' GROUP BY 1")),
    "tr1_text_records": (
        lambda s, d: table(s, d, "documents").select(
            "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
            "doc_id", "pos", F.regexp_extract("line", r"([A-Za-z_]+) = ([0-9a-f\"]+)", 1).alias("key")).where("key <> ''"),
        """SELECT doc_id, pos, regexp_extract(line, '([A-Za-z_]+) = ([0-9a-f"]+)', 1) AS key FROM (
 SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE regexp_extract(line, '([A-Za-z_]+) = ([0-9a-f"]+)', 1) <> ''"""),
}

"""Operators over ranges, trees, logs and streams against plain code."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import SF
from tests.test_brute_force import _slow_activations
from tracemill.operators import calltree as ct
from tracemill.operators import checkpoints as ck
from tracemill.operators import evidence as ev
from tracemill.operators import ranking as rk
from tracemill.operators import statistics as stats
from tracemill.operators import trace as tr
from tracemill.operators.conformity import conformity
from tracemill.operators.prefix import row_numbers, running_total
from tracemill.operators.ranges import innermost
from tracemill.plans.more_queries import QUERIES
from tracemill.sources.artifacts import log_lines, read_traces, write_packed
from tracemill.streaming.accumulate import LatestTable, accumulate

EVENTS = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["call", "line", "return", "exception"])), max_size=25)


def test_running_totals_of_one_large_group(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i, r.randrange(-5, 9) if r.random() < 0.9 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, k int, v int").withColumn("_sum", F.lit("x"))
    got = {x.k: x.t for x in running_total(frame.drop("_sum"), ["g"], [F.desc("k")], F.col("v"), "t").collect()}
    sums = {}
    for g, k, v in sorted(rows, key=lambda x: -x[1]):
        assert got[k] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
    numbers = row_numbers(frame, ["g"], [F.asc("k")], "n").where("g = 'hot'").orderBy("k").collect()
    assert [x.n for x in numbers] == list(range(1, len(numbers) + 1))
    assert running_total(frame.limit(0), ["g"], [F.asc("k")], F.lit(1), "n").count() == 0


@settings(max_examples=400, deadline=None)
@given(EVENTS, EVENTS)
def test_reduced_events_leave_the_same_stack(below, events):
    numbered = [(i + 100, f, e) for i, (f, e) in enumerate(events)]
    stacks = []
    for part in (numbered, ct.reduced(numbered), ct.reduced(ct.reduced(numbered[:9]) + ct.reduced(numbered[9:]))):
        stack = ct.Stack()
        for i, (f, e) in enumerate(below):
            stack.take(i, f, e)
        for row in part:
            stack.take(*row)
        stacks.append(stack.entries)
    assert stacks[0] == stacks[1] == stacks[2]


def test_activations_in_a_tree_of_chunks(spark):
    r = random.Random(5)
    rows = [(t, i, r.choice("abcde"), r.choice(["call", "call", "line", "return", "exception"])) for t, n in ((1, 700), (2, 7), (3, 90), (4, 1)) for i in range(n)]
    rows += [(5, i, "f", "call" if i < 150 else "return") for i in range(300)]  # deep and well nested
    rows += [(None, 1, "a", "call"), (6, 1, None, "call"), (6, 2, "a", "line")]
    events = spark.createDataFrame(rows, "trace_id long, seq long, func string, event string")
    got = {}
    for x in ct.activations(events, chunk=5, fan=2).orderBy("trace_id", "activation").collect():
        got.setdefault(x.trace_id, []).append((x.func, x.call_seq, x.end_seq, x.closed, x.parent, x.depth))
    for t in range(1, 6):
        want = _slow_activations([(i, f, e) for k, i, f, e in rows if k == t])
        assert [g[:4] for g in got[t]] == want
    assert [g[4:] for g in got[5]] == [(k or None, k + 1) for k in range(150)]
    assert len(got[6]) == 1
    whole = [tuple(x) for x in ct.activations(events).orderBy("trace_id", "activation").collect()]
    assert whole == [tuple(x) for x in ct.activations(events, chunk=40, fan=3).orderBy("trace_id", "activation").collect()]


def test_depths_against_a_walk(spark):
    r = random.Random(2)
    frames = []
    for t in range(12):
        for a in range(1, r.choice([2, 40, 200])):
            frames.append((t, a, a - 1 - r.randrange(min(a - 1, 2)) if a > 1 and r.random() < 0.97 else None, f"g{r.randrange(9)}"))
    frames.append((99, 5, 4, "g1"))  # its parent is not there
    target, library = {"g0"}, {"g3", "g4"}
    depth = {}
    for t, a, p, f in frames:
        up = depth.get((t, p), -1)
        depth[t, a] = 0 if f in target else -1 if up < 0 else up + (f not in library)
    rows = spark.createDataFrame(frames, "trace_id long, activation long, parent long, func string")
    is_target, is_library = F.col("func").isin(*target), F.col("func").isin(*library)
    assert {(x.trace_id, x.activation): x.call_depth for x in ct.call_depths(rows, is_target, is_library).collect()} == depth
    least = {}
    for t, a, p, f in frames:
        if f not in library:
            d, was = depth[t, a], least.get(f, -1)
            least[f] = d if was < 0 else min(d, was) if d >= 0 else was
    assert {x.func: x.call_depth for x in ct.least_depths(rows, is_target, is_library, ["func"]).collect()} == least
    assert ct.call_depths(rows.limit(0), is_target, is_library).count() == 0


def test_logs_in_small_splits(spark, tmp_path):
    r = random.Random(3)
    texts = {}
    for name in ("a.log", "b.log", "sub/c.log"):
        lines = ["lost line"]
        for i in range(120):
            lines.append(f"2026-01-01 00:00:00.{i:03d} /t/m.py:{i} m.f event={r.choice(['call', 'line', 'return'])} locals={{'x': 'p" + "q" * r.randrange(60))
            lines += ["more " * r.randrange(20) for _ in range(r.randrange(4))]
            lines[-1] += "'}"
            if r.random() < 0.1:
                lines += ["[TRACE][START] pid=1", "dropped", "dropped too"]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "a.log" else ""))
        texts[name] = "\n".join(lines)
    whole = spark.createDataFrame([(n, i, x) for n, t in texts.items() for i, x in enumerate(t.split("\n"))], "trace_id string, pos long, text string")
    want = sorted((x.trace_id, x.seq, x.line, x.event, x.tail) for x in tr.parse_records(tr.join_continuations(whole)).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert log_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 1
        rows = read_traces(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = sorted((x.trace_id.split(str(tmp_path))[1].lstrip("/"), x.seq, x.line, x.event, x.tail) for x in rows)
    assert got == want and len(got) == 360


def test_logs_of_many_traces_share_files(spark, tmp_path):
    """Lines come back in order whatever a trace is named; a long trace goes over files, a short one takes none of its own."""
    r = random.Random(4)
    names = [None, "a b/c=%\t+", "-7", "x\ny", *(str(i) for i in range(200))]
    rows = []
    for n in names:
        for i in range(900 if n == "-7" else r.randrange(1, 9)):
            rows.append((n, i, r.choice(["[TRACE][START]", "", " \t", "\ttab", f"2026-01-01 00:00:00.0 /m.py:{i} f event=line locals={{'x': {i}}}", "é more\r"])))
    r.shuffle(rows)
    lines = spark.createDataFrame(rows, "trace_id string, pos long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_packed(lines, str(tmp_path / "logs"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "logs").glob("*.txt"))
    holders = [f for f in files if any(x.startswith("-7\t") for x in f.read_bytes().decode().split("\n"))]
    assert len(files) <= 4 and len(holders) > 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted(((x.trace_id, x.pos, x.text) for x in log_lines(spark, str(tmp_path / "logs"), "*.txt", packed=True).collect()), key=str)
        events = sorted(((x.trace_id, x.seq, x.line, x.tail) for x in read_traces(spark, str(tmp_path / "logs"), "*.txt", packed=True).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(rows, key=str)
    assert events == sorted(((x.trace_id, x.seq, x.line, x.tail) for x in tr.parse_records(tr.join_continuations(lines)).collect()), key=str)
    write_packed(spark.createDataFrame([("t", 0, "one\ntwo"), ("t", 1, None)], lines.schema), str(tmp_path / "two"))
    assert sorted((x.trace_id, x.pos, x.text) for x in log_lines(spark, str(tmp_path / "two"), "*.txt", packed=True).collect()) == [("t", 0, "one"), ("t", 1, "two"), ("t", 2, "")]


def test_trace_logs_of_a_table_are_few_files(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("logs-*/**/*.txt"))
    traces = QUERIES["io3_trace_logs"][0](spark, SF).count()
    assert 0 < len(set(shared.glob("logs-*/**/*.txt")) - before) <= 4 < traces


def test_digests_of_paths(spark):
    paths = {1: [10, 11, 12, 11], 2: [10, 11, 12, 11], 3: [10, 12, 11, 11], 4: [10, 11, 12], 5: [], 6: [10, 11, 12, 11, 11]}
    rows = [(t, 7 * i + t, "a.py", n, "f", "line") for t, p in paths.items() for i, n in enumerate(p)] + [(5, 1, "a.py", 1, "f", "call"), (1, 3, "a.py", 1, "f", "call")]
    events = spark.createDataFrame(rows, "trace_id long, seq long, file string, line int, func string, event string")
    got = {x.trace_id: (x.steps, x.first, x.traces) for x in tr.equal_paths(events).collect()}
    assert got == {1: (4, 1, 2), 2: (4, 1, 2), 3: (4, 3, 1), 4: (3, 4, 1), 6: (5, 6, 1)}


def test_quantiles_by_counts(spark):
    r = random.Random(7)
    rows = [(g, r.choice([None, 1.5, 2.0, r.random() * 9])) for g, n in (("a", 1), ("b", 2), ("c", 900), (None, 17)) for _ in range(n)] + [("d", None), ("a", 4.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    at = {"q10": 0.1, "q50": 0.5, "q100": 1.0}
    got = {x.g: x for x in rk.quantiles(frame, ["g"], "v", at).collect()}
    for g in {x[0] for x in rows}:
        own = [v for k, v in rows if k == g and v is not None]
        assert (g in got) == bool(own)
        if own:
            assert got[g].members == len(own)
            assert all(abs(got[g][n] - np.quantile(own, p)) < 1e-12 for n, p in at.items())
    all_rows = rk.quantiles(frame, [], "v", {"m": 0.5}).first()
    assert abs(all_rows.m - np.quantile([v for _, v in rows if v is not None], 0.5)) < 1e-12


def test_outcome_labels_of_one_category(spark):
    r = random.Random(8)
    rows = [("one", i, r.randrange(50), r.choice(rk.LEVELS)) for i in range(1200)]
    frame = spark.createDataFrame(rows, "category string, k int, score int, label string")
    got = {x.k: x.outcome_label for x in rk.relabel_by_outcome(frame, "category", "score", "k").collect()}
    labels = [level for level in rk.LEVELS for _ in range(sum(x[3] == level for x in rows))]
    assert got == {x[1]: label for x, label in zip(sorted(rows, key=lambda x: (-x[2], x[1])), labels)}


def test_innermost_ranges(spark):
    r = random.Random(4)
    ranges = []

    def nest(g, lo, hi):
        if hi < lo:
            return
        ranges.append((g, lo, hi, len(ranges)))
        at = lo + r.randrange(2)
        while at <= hi and r.random() < 0.8:
            end = min(hi, at + r.randrange(1, max(2, (hi - lo) // 2 + 1)))
            if (at, end) != (lo, hi):
                nest(g, at, end)
            at = end + 1

    for g in range(3):
        nest(g, -40, 400 * g)
    points = [(r.randrange(4), r.randrange(-60, 900), i) for i in range(400)]
    got = {x.i: x.name for x in innermost(spark.createDataFrame(points, "g int, p long, i int"), spark.createDataFrame(ranges + [(0, 9, 3, -1)], "g int, a long, b long, name int"), ["g"], "p", "a", "b", ["name"]).collect()}
    for g, p, i in points:
        holding = [x for x in ranges if x[0] == g and x[1] <= p <= x[2]]
        assert got[i] == (min(holding, key=lambda x: (-x[1], x[2], x[3]))[3] if holding else None)


def _slow_conform(template, answer):
    """The number of containers of the answer that are not those of the template."""
    kind = lambda v: dict if isinstance(v, dict) else list if isinstance(v, list) else None
    if kind(template) is None:
        return 0
    if kind(template) is not kind(answer):
        return 1
    if isinstance(template, list):
        return sum(_slow_conform(template[0], v) for v in answer) if template else 0
    only = next(iter(template)).strip() if len(template) == 1 else ""
    if only and (only[0] + only[-1] == "<>" or only.lower() in ("str", "int", "float", "number", "bool", "null", "none", "any", "object", "key")):
        return sum(_slow_conform(template[next(iter(template))], v) for v in answer.values())
    return sum(_slow_conform(t, answer[k]) for k, t in template.items() if k in answer)


def test_conformity_of_random_documents(spark):
    import json

    r = random.Random(6)

    def make(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return r.choice(["int", None, 3, True])
        if kind < 0.6:
            return [make(depth - 1) for _ in range(r.randrange(3))]
        return {k: make(depth - 1) for k in r.sample(["a", "b", "<k>", " Str ", "c.d", "int"], r.choice([0, 1, 1, 2, 3]))}

    rows, want = [], {}
    for i in range(300):
        template, answer = make(3), make(3)
        rows.append((i, json.dumps(template), json.dumps(answer)))
        want[i] = _slow_conform(template, answer)
    rows += [(1000, "{", "{}"), (1001, "{}", "nope"), (1002, None, "{}"), (1003, "{}", None)]
    frame = spark.createDataFrame(rows, "answer_id long, template string, doc string").withColumn("node", F.lit(1))
    got = {x.answer_id: (x.conforms, x.errors) for x in conformity(frame).collect()}
    assert {i: g for i, g in got.items() if i < 1000} == {i: (n == 0, n) for i, n in want.items()}
    assert all(got[i] == (False, 0) for i in range(1000, 1004))


def test_accumulated_batches_and_replays(spark, tmp_path):
    schema = "scope string, k long, run long, ok boolean"
    batches = [[("s", i, b, (i + b) % 3 == 0) for i in range(b, b + 6)] + [("s", 2, 10 - b, b == 1)] for b in range(11)]
    table = LatestTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], schema).schema, ["scope", "k"], "run", compact=4)
    assert table.read().count() == 0
    want = {}
    for n, rows in enumerate(batches):
        table.apply(spark.createDataFrame(rows, schema), n)
        for s, k, run, ok in rows:
            if (s, k) not in want or run >= want[s, k][0]:
                want[s, k] = (run, ok)
        if n in (2, 7):  # the stream says a batch again, another process opens the table
            again = LatestTable(spark, f"file://{tmp_path}/t", table.read().schema, ["scope", "k"], "run", compact=4)
            again.apply(spark.createDataFrame([("s", 2, 99, True)], schema), n)
    assert {(x.scope, x.k): (x.run, x.ok) for x in table.read().collect()} == want
    assert table.log().count() == len(batches) + 1
    for n, rows in enumerate(batches[:3]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    first = accumulate(source, ["scope", "k"], "run", f"file://{tmp_path}/u")
    assert first.log().count() == 4
    assert accumulate(source, ["scope", "k"], "run", f"file://{tmp_path}/u").log().count() == 4  # nothing new


def test_alpha_of_many_folds(spark):
    r = random.Random(9)
    rows = [(i % 400, r.choice("ab"), r.random() * 9, r.random()) for i in range(1200)]
    frame = spark.createDataFrame(rows, "fold int, g string, x double, y double")
    matrix, names, _ = stats.design(frame, ["x"], "g", "y", "fold")
    got = {(x.fold, x.alpha): x.w for x in stats.fold_fits(matrix, names, "fold", [0.5]).collect()}
    assert len(got) == 400
    x = np.log1p([v[2] for v in rows])
    z = np.column_stack([np.ones(len(rows)), (x - x.mean()) / x.std(), [v[1] == "a" for v in rows], [v[1] == "b" for v in rows]])
    y, folds = np.array([v[3] for v in rows]), np.array([v[0] for v in rows])
    for f in (0, 17, 399):
        a, b = z[folds != f], y[folds != f]
        want = np.linalg.lstsq(a.T @ a + np.diag([0, 0.5, 0.5, 0.5]), a.T @ b, rcond=None)[0]
        assert np.allclose(got[f, 0.5], want, atol=1e-8)


def test_checkpoints_by_hand(spark):
    ev_rows, n = [], 0

    def add(func, line, event, retval=None, exc=None, local=None):
        nonlocal n
        n += 1
        ev_rows.append((1, n, "m.py", line, func, event, retval, exc, local))

    add("f", 10, "call", local={"a": "1", "b": "<obj>", "c": "[2]"})
    add("f", 11, "line")
    add("f", 10, "call", local={"a": "7"})  # recursion: not the first activation's events
    add("f", 13, "line")
    add("f", 13, "return", retval="0")
    add("f", 13, "line")
    add("f", 14, "line")
    add("g", 30, "call")
    add("g", 31, "line")
    add("g", 31, "exception", exc="pkg.errors.Bad: no")
    add("g", 31, "return", retval="None", local={"t": "True", "u": "'v'"})
    add("f", 13, "line")
    add("f", 15, "return", retval="{'k': (1, 2)}", local={"a": "1", "c": "[2, 3]", "d": "..."})
    add("g", 30, "call")
    events = spark.createDataFrame(ev_rows, "trace_id long, seq long, file string, line int, func string, event string, retval string, exc string, locals map<string,string>")
    functions = spark.createDataFrame([("f", 10, 9, ["a", "b", "c"], False), ("g", 30, 30, [], False), ("h", 1, 1, [], False)], "func string, def_line int, start_line int, params array<string>, suspendable boolean")
    statements = spark.createDataFrame([("f", 11, 15, 11), ("f", 13, 14, 13)], "func string, start_line int, end_line int, target int")
    ignored = spark.createDataFrame([("f", 11)], "func string, line int")
    loops = spark.createDataFrame([("f", 12, 13), ("g", 40, 41)], "func string, line int, body_line int")
    rows = ck.checkpoints(events, functions, statements, ignored, loops).collect()
    got = {(x.func, x.checkpoint): (x.level, x.kind, x.expected, x.accept) for x in rows}
    assert len(got) == len(rows)
    assert got == {
        ("f", "def_line"): ("locate", "int", "10", [9, 10]), ("f", "invocation_count"): ("entry", "int", "2", None),
        ("f", "arguments.a"): ("entry", "value", "1", None), ("f", "arguments.c"): ("entry", "value", "[2]", None),
        ("f", "executed_lines"): ("path", "line_set", "[13]", [13]), ("f", "exit_kind"): ("path", "enum", "return", None), ("f", "exit_line"): ("path", "line", "11", [11, 13]),
        ("f", "loop_iterations.12"): ("workload", "int", "2", None), ("f", "return_value"): ("state", "value", "{'k': (1, 2)}", None), ("f", "locals_at_exit.c"): ("state", "value", "[2, 3]", None),
        ("g", "def_line"): ("locate", "int", "30", [30]), ("g", "invocation_count"): ("entry", "int", "2", None),
        ("g", "executed_lines"): ("path", "line_set", "[31]", [31]), ("g", "exit_kind"): ("path", "enum", "exception", None), ("g", "exit_line"): ("path", "line", "31", [31]),
        ("g", "exception_type"): ("path", "name", "Bad", None), ("g", "loop_iterations.40"): ("workload", "int", "0", None),
        ("g", "locals_at_exit.t"): ("state", "value", "True", None), ("g", "locals_at_exit.u"): ("state", "value", "'v'", None),
    }


@pytest.mark.parametrize("goal", ["harder", ""])
def test_goals_are_known(spark, goal):
    with pytest.raises(ValueError):
        ev.score_deltas(spark.range(1), [], goal)

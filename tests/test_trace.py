from pyspark.sql import functions as F

from tracemill.operators import calltree as ct
from tracemill.operators import trace as tr

SAMPLE = [
    "2026-01-01 00:00:00.000 /testbed/pkg/target.py:9 pkg.target event=call locals={}",
    "2026-01-01 00:00:00.001 /testbed/pkg/target.py:10 pkg.target event=line locals={'i': '0'}",
    "2026-01-01 00:00:00.002 /testbed/pkg/target.py:11 pkg.target event=line locals={'s': 'a\n locals=b'}",
    "2026-01-01 00:00:00.003 /testbed/pkg/target.py:10 pkg.target event=line locals={}",
    "[TRACE][START] pid=1",
    "2026-01-01 00:00:00.004 /testbed/pkg/target.py:12 pkg.target event=return retval=None locals={}",
]


def _parsed(spark):
    text = "noise\n" + "\n".join(SAMPLE)
    lines = spark.createDataFrame([(1, i, line) for i, line in enumerate(text.split("\n"))], "trace_id long, pos long, text string")
    return tr.split_tail(tr.parse_records(tr.join_continuations(lines)))


def test_records_continue_over_lines(spark):
    rows = _parsed(spark).orderBy("seq").collect()
    assert [r.line for r in rows] == [9, 10, 11, 10, 12]
    assert rows[1].locals == {"i": "0"}
    assert rows[2].locals == {}  # a representation broken over lines is no literal
    assert rows[4].retval == "None"


def test_depth_never_below_zero(spark):
    events = spark.createDataFrame([(1, i, "f", e) for i, e in enumerate(["return", "return", "call", "call", "return"])], "trace_id long, seq long, func string, event string")
    assert [r.depth for r in tr.call_depth(events).orderBy("seq").collect()] == [0, 0, 1, 2, 1]


def test_transitions_of_the_sample(spark):
    lines = [10, 11, 10, 12]
    events = spark.createDataFrame([(1, i, "a.py", n, "f", "line") for i, n in enumerate(lines)], "trace_id long, seq long, file string, line int, func string, event string")
    row = tr.transition_features(events).first()
    assert (row.transitions, row.branch_points, row.branch_alternatives) == (3, 1, 1)


def test_activations_recover(spark):
    seq = [("call", "a"), ("call", "b"), ("return", "a"), ("return", "c"), ("call", "a")]
    events = spark.createDataFrame([(1, i, f, e) for i, (e, f) in enumerate(seq)], "trace_id long, seq long, func string, event string")
    rows = {r.activation: r for r in ct.activations(events).collect()}
    assert rows[1].closed and not rows[2].closed and rows[2].parent == 1
    assert rows[3].orphan and rows[3].closed and not rows[4].closed


def test_empty_events(spark):
    events = spark.createDataFrame([], "trace_id long, seq long, file string, line int, func string, event string, x int")
    assert ct.activations(events).count() == 0
    assert tr.line_counts(events, 1, 3).count() == 0
    assert tr.transition_entropy(events).count() == 0
    assert tr.event_statistics(events).select(F.sum("events")).first()[0] is None


def test_activations_in_chunks(spark):
    import random

    r = random.Random(3)
    rows = [(t, i, r.choice("abcd"), r.choice(["call", "call", "line", "return", "exception"])) for t, n in ((1, 120), (2, 7), (3, 40)) for i in range(n)]
    events = spark.createDataFrame(rows, "trace_id long, seq long, func string, event string")
    whole, cut = ([tuple(x) for x in ct.activations(events, chunk).orderBy("trace_id", "activation").collect()] for chunk in (10**6, 25))
    assert whole == cut and len(whole) > 40

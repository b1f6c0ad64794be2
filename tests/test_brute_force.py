"""Operators that SQL does not express, against plain code over the same rows."""

import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from tests.compare import SF
from tracemill.functions import matching as m
from tracemill.operators import answers as an
from tracemill.operators import source_code as so
from tracemill.operators import statistics as st
from tracemill.operators import calltree as ct
from tracemill.operators import trace as tr
from tracemill.operators import trajectory as tj
from tracemill.plans import all_queries
from tracemill.sources.fixtures import expected_elements, instances, predicted_elements, trace_events


def test_similarity_of_all_answers(spark):
    sides = []
    for frame in (expected_elements(spark, SF), predicted_elements(spark, SF)):
        tokens = {}
        for x in frame.orderBy("answer_id", "pos").collect():
            tokens.setdefault(x.answer_id, []).append(x.token)
        sides.append(tokens)
    got = {x.answer_id: x.similarity for x in all_queries()["sc17_similarity"][0](spark, SF).collect()}
    assert set(got) == set(sides[0]) | set(sides[1])
    for k, v in got.items():
        a, b = (s.get(k, []) for s in sides)
        assert abs(v - (1.0 if a == b else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())) < 1e-9


def _slow_activations(events):
    """Activations of one trace: (func, start, end, closed) from lists of open calls."""
    out, opened = [], []
    for seq, func, event in events:
        at = max((i for i, o in enumerate(opened) if o[0] == func), default=None)
        if event == "call" or at is None:
            opened.append([func, seq])
            at = len(opened) - 1
        while len(opened) - 1 > at:
            f, s = opened.pop()
            out.append((f, s, seq, False))
        if event == "return":
            f, s = opened.pop()
            out.append((f, s, seq, True))
    return sorted([*out, *((f, s, events[-1][0], False) for f, s in opened)], key=lambda x: x[1])


def test_activations_of_all_traces(spark):
    traces = {}
    for x in trace_events(spark, SF).orderBy("trace_id", "seq").collect():
        traces.setdefault(x.trace_id, []).append((x.seq, x.func, x.event))
    got = {}
    for x in ct.activations(trace_events(spark, SF)).orderBy("trace_id", "activation").collect():
        got.setdefault(x.trace_id, []).append((x.func, x.call_seq, x.end_seq, x.closed))
    for trace, events in traces.items():
        assert [(f, e, c) for f, _, e, c in got[trace]] == [(f, e, c) for f, _, e, c in _slow_activations(events)]


def _design(rows, features, group):
    x = np.log1p(np.maximum(np.array([[r[f] for f in features] for r in rows], float), 0))
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    names = sorted({r[group] for r in rows})
    return np.hstack([np.ones((len(rows), 1)), x, np.array([[r[group] == n for n in names] for r in rows], float)]), names


def _slow_ridge(x, y, alpha):
    penalty = alpha * np.eye(x.shape[1])
    penalty[0, 0] = 0
    return np.linalg.lstsq(x.T @ x + penalty, x.T @ y, rcond=None)[0]


def _success(spark):
    return instances(spark, SF).withColumn("success", F.col("score") % 7 / 7).withColumn("fold", F.col("instance_id") % 5)


def test_ridge_fit(spark):
    rows = _success(spark).collect()
    x, names = _design(rows, ["score", "score2"], "archetype")
    want = x @ _slow_ridge(x, np.array([r.success for r in rows], float), 1.0)
    weights = {t.term: t.weight for t in all_queries()["st9_ridge_fit"][0](spark, SF).collect()}
    got = x @ np.array([weights[t] for t in ["intercept", "score", "score2", *(f"archetype={n}" for n in names)]])
    assert np.abs(got - want).max() < 1e-6


def test_choice_of_alpha(spark):
    rows = _success(spark).collect()
    x, _ = _design(rows, ["score", "score2"], "archetype")
    y, fold = np.array([r.success for r in rows], float), np.array([r.fold for r in rows])
    got = {r.alpha: r.rho for r in all_queries()["st10_choose_alpha"][0](spark, SF).collect()}

    def ranks(v):
        _, place, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[place]

    for alpha, rho in got.items():
        p = np.empty(len(y))
        for f in set(fold.tolist()):
            p[fold == f] = x[fold == f] @ _slow_ridge(x[fold != f], y[fold != f], alpha)
        assert abs(np.corrcoef(ranks(p.round(9)), ranks(y))[0, 1] - rho) < 1e-6
    assert len(got) == 2


SOURCE = """
class Box:
    def run(self, items, k=1):
        total: int = 0
        for x in items:
            while x and k:
                if x > 2 or k:
                    break
            total += helper(x)
        try:
            with open(k) as f:
                y = [z for z in f if z]
        except ValueError:
            raise
        except (KeyError, OSError):
            pass
        finally:
            self.close()

        def inner(a):
            if a:
                for b in a:
                    return helper(b)
            return None

        return total


def helper(x):
    return x


if True:
    def hidden():
        return [
            1,
            2,
            3,
            4,
            5,
            6]
"""


def test_metrics_of_a_function(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def broken("), ("c.py", None)], "path string, text string")
    rows = {x.qualname: x for x in so.functions(files).withColumn("score", so.structural_score()).collect()}
    assert set(rows) == {"Box.run"}  # inner functions are too short, those in conditions no targets
    r = rows["Box.run"]
    assert (r.branches, r.loops, r.while_loops, r.max_loop_nesting, r.excepts, r.raises, r.finallys) == (1, 2, 1, 2, 2, 1, 1)
    assert (r.calls, r.local_calls, r.assigns, r.augassigns, r.returns, r.boolops, r.comprehensions, r.with_blocks, r.breaks_continues) == (3, ["helper"], 2, 1, 1, 2, 1, 1, 1)
    assert r.score == round(2 * (1 + 1 + 2 + 2 + 2) + (2 + 1 + 4 + 1 + 1 + 3) + r.body_lines / 10, 2)
    tests = {x.path: (x.source_lines, x.imports, x.calls) for x in so.test_features(files).collect()}
    assert tests["b.py"] == tests["c.py"] == (0, 0, 0) and tests["a.py"] == (SOURCE.count("\n"), 0, 4)
    paths = ["pkg/a.py", "pkg/tests/a.py", "docs/a.py", "pkg/setup_x.py", "x_qa/a.py", ".git/a.py", "pkg/a.txt", "vendored/a.py", "pkg/a_test.py"]
    kept = spark.createDataFrame([(p,) for p in paths], "path string").where(so.is_source(F.col("path")))
    assert [x.path for x in kept.collect()] == ["pkg/a.py", "pkg/a_test.py"]


def test_commands_overlap(spark):
    commands = ["cd x && python -m pytest -q | head -3", "rg foo", "pip3 install x; rm y", "python3 trace_it.py", "cat a", "cat a", "echo ls", None]
    row = tj.command_effort(spark.createDataFrame([(1, c) for c in commands], "rollout_id long, command string")).first()
    assert (row.commands, row.repeated, row.search_commands, row.execution_commands, row.test_commands) == (8, 1, 2, 2, 1)
    assert (row.inspection_commands, row.mutation_commands, row.install_commands, row.instrumentation_commands) == (3, 1, 1, 1)


def test_values_of_any_kind():
    met = [(1, 1.0000001), ("a\\b", "a/b"), (None, "null"), (True, "TRUE"), (True, 1), (2, "2"), ([1], "(1)") and ([1], "[1]"), ({"a": 1}, "{'a': 1, 'b': 2}"), ([], []), (float("inf"), float("inf"))]
    for e, p in met:
        assert m.same(e, p, "x"), (e, p)
    for e, p in [(1, "one"), ("1", 1), ([1, 2], [2, 1]), ({"a": None}, {}), (None, 0), (False, "0"), (0, "false"), ([1], "1"), ("a", None)]:
        assert not m.same(e, p, "x"), (e, p)
    r = random.Random(1)
    for _ in range(200):
        items = [r.choice([1, "a", None, {"k": 2}, [3]]) for _ in range(r.randrange(6))]
        other = items[:]
        r.shuffle(other)
        assert m.same(items, other, "unique_values") and m.unified(items, items, "x")[0] == m.unified(items, items, "x")[1]


def test_answers_of_odd_rows(spark):
    rows = [(1, '{"a": 1}', None), (2, '{"a": 1}', ""), (3, "{}", "{}"), (4, "[]", "[]"), (5, "3", "3"), (6, '{"a": [{"b": 1}]}', '{"a": [1]}')] * 2
    answers = spark.createDataFrame(rows, "answer_id long, expected string, predicted string")
    got = {x.answer_id: (x.correct, x.kind) for x in an.verdicts(answers).collect()}
    assert got == {1: (False, "invalid_json"), 2: (False, "invalid_json"), 3: (True, None), 4: (True, None), 5: (True, None), 6: (False, "type_mismatch")}
    assert {x.label for x in an.field_scores(an.answer_fields(answers)).where("answer_id in (1, 2)").collect()} == {"missing_field"}
    assert an.answer_scores(answers.limit(0)).count() == 0 and st.to_ten is not None

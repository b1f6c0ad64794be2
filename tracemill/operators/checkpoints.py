"""Checkpoints of a traced function's first activation, their scores, and ladders of levels."""

from __future__ import annotations

import ast
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compare as c
from ..sources.shared import written
from .calltree import activations
from .ranges import innermost
from .trace import invocations

# Levels of a ladder in order, the final answer behind them; how many arguments, locals and loops are asked for.
LADDER = ["locate", "entry", "path", "workload", "state", "answer"]
MOST_ARGUMENTS, MOST_LOCALS, MOST_LOOPS, MOST_VALUE_CHARS = 4, 4, 8, 200
# Representations of values that tell little; they are asked for last.
TRIVIAL = ["None", "True", "False", "0", "''", "[]", "{}", "()"]
_BY = ["trace_id", "func"]


@F.pandas_udf(T.StringType())
def literal_repr(text: pd.Series) -> pd.Series:
    """The representation of a complete Python literal; null for object representations and cut or long values."""

    def one(t: str | None) -> str | None:
        t = (t or "").strip()
        if not t or len(t) > MOST_VALUE_CHARS or "..." in t:
            return None
        try:
            return repr(ast.literal_eval(t))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None

    return text.map(one)


def first_activations(events: DataFrame) -> DataFrame:
    """The events of the first activation of each function of a trace that began with a call, recursion apart.

    An event belongs to the innermost activation of its function that is open.
    """
    spans = written(activations(events), "activations").where(~F.col("orphan"))
    placed = innermost(events, spans, _BY, "seq", "call_seq", "end_seq", ["activation"])
    first = spans.groupBy(*_BY).agg(F.min("activation").alias("activation"), F.count("*").alias("calls"))
    return placed.join(first, [*_BY, "activation"])


def folded(lines: DataFrame, statements: DataFrame, line: str = "line", by: list[str] | None = None) -> DataFrame:
    """``lines`` with ``line`` replaced by the first line of the innermost statement (start_line, end_line, target) around it."""
    found = innermost(lines, statements, by or ["func"], line, "start_line", "end_line", ["target"])
    return found.withColumn(line, F.coalesce(F.col("target").cast(lines.schema[line].dataType), F.col(line))).drop("target")


def _row(name: Column | str, level: str, kind: str, expected: Column, accept: Column | None = None) -> list[Column]:
    return [*map(F.col, _BY), (F.lit(name) if isinstance(name, str) else name).alias("checkpoint"), F.lit(level).alias("level"), F.lit(kind).alias("kind"),
            expected.cast("string").alias("expected"), (F.lit(None) if accept is None else accept).cast("array<int>").alias("accept")]


def _named_values(rows: DataFrame, source: str, most: int, prefix: str, level: str, other: Column | None = None) -> DataFrame:
    """Literal values of a map of representations, the telling ones first, ``most`` of them."""
    each = rows.select(*_BY, *([other.alias("other")] if other is not None else []), F.explode(source).alias("name", "text"))
    valued = each.withColumn("value", literal_repr("text")).where("value is not null")
    if other is not None:  # what is as it was on entry is not asked for again
        known = F.try_element_at("other", F.col("name"))
        valued = valued.withColumn("was", literal_repr(F.coalesce(known, F.lit("...")))).where("was is null or was <> value")
    order = Window.partitionBy(*_BY).orderBy(F.col("value").isin(TRIVIAL), "name")
    return valued.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(*_row(F.concat(F.lit(prefix), "name"), level, "value", F.col("value")))


def checkpoints(events: DataFrame, functions: DataFrame, statements: DataFrame, ignored: DataFrame, loops: DataFrame) -> DataFrame:
    """trace_id, func, checkpoint, level, kind, expected, accept: nine kinds of facts in long form.

    ``events``: trace_id, seq, func, line, event, retval, exc, locals (map of
    representations); ``functions``: func, def_line, start_line, params, suspendable;
    ``statements``: func, start_line, end_line, target; ``ignored``: func, line;
    ``loops``: func, line, body_line, at most ``MOST_LOOPS`` of a function counted. Of
    every function that was called: where it is defined, how often it was called; and of
    its first activation, if it returned and cannot be suspended, the arguments, executed
    lines (folded onto their statements), kind and line of the exit, exception, loop
    counts, return value and final locals.
    """
    first = written(first_activations(events), "first-activations")
    called = first.groupBy(*_BY).agg(F.first("calls").alias("calls")).join(functions, "func")
    out = called.select(*_row("def_line", "locate", "int", F.col("def_line"), F.array_sort(F.array_distinct(F.array("def_line", "start_line")))))
    out = out.union(called.select(*_row("invocation_count", "entry", "int", F.col("calls"))))

    is_return = F.col("event") == "return"
    before = F.when(~is_return, F.struct("seq", "event", "line"))
    facts = first.groupBy(*_BY).agg(
        F.min_by("locals", F.when(F.col("event") == "call", F.col("seq"))).alias("arguments"), F.count_if(is_return).alias("returns"),
        F.max_by(F.struct("line", "retval", "locals"), F.when(is_return, F.col("seq"))).alias("end"), F.max(before).alias("last"),
        F.max_by("exc", F.when(F.col("event") == "exception", F.col("seq"))).alias("exc"), F.max_by("line", F.when(F.col("event") == "line", F.col("seq"))).alias("last_line"))
    raised = F.coalesce((F.col("last.event") == "exception") & (F.col("last.line") == F.col("end.line")) & (F.trim(F.coalesce("end.retval", F.lit(""))) == "None"), F.lit(False))
    facts = written(facts.where("returns > 0").withColumn("raised", raised).join(functions.where(~F.col("suspendable")), "func"), "facts")
    inside = first.join(facts.select(*_BY, "start_line", "def_line"), _BY)

    ran = folded(inside.where("event = 'line'").select(*_BY, "line", "start_line", "def_line").distinct(), statements)
    skip = ran.join(ignored.select("func", "line"), ["func", "line"], "left_anti").where("line <> start_line and line <> def_line")
    lines = skip.groupBy(*_BY).agg(F.array_sort(F.collect_set("line")).alias("lines"))
    ends = folded(facts.select(*_BY, F.explode(F.array_compact(F.array("end.line", "last_line"))).alias("line")), statements).groupBy(*_BY).agg(F.array_sort(F.collect_set("line")).alias("lines"))
    hits = inside.where("event = 'line'").groupBy(*_BY, F.col("line").alias("body_line")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*_BY).orderBy("loop")
    spine = facts.select(*_BY).join(loops.select("func", F.col("line").alias("loop"), "body_line"), "func").withColumn("r", F.row_number().over(order)).where(F.col("r") <= MOST_LOOPS)
    counts = spine.join(hits, [*_BY, "body_line"], "left")
    asked = facts.withColumn("arguments", F.map_filter(F.coalesce("arguments", F.create_map().cast("map<string,string>")), lambda k, v: F.array_contains("params", k)))
    place = Window.partitionBy(*_BY).orderBy(F.array_position(F.col("params"), F.col("name")))
    given = asked.select(*_BY, "params", F.explode("arguments").alias("name", "text")).withColumn("value", literal_repr("text")).where("value is not null").withColumn("r", F.row_number().over(place))
    returned = facts.withColumn("value", literal_repr(F.coalesce("end.retval", F.lit(""))))
    kind = F.element_at(F.split(F.trim(F.substring_index("exc", ":", 1)), r"\."), -1)
    for more in (
        given.where(F.col("r") <= MOST_ARGUMENTS).select(*_row(F.concat(F.lit("arguments."), "name"), "entry", "value", F.col("value"))),
        lines.select(*_row("executed_lines", "path", "line_set", F.to_json("lines"), F.col("lines"))),
        facts.select(*_row("exit_kind", "path", "enum", F.when(F.col("raised"), "exception").otherwise("return"))),
        ends.select(*_row("exit_line", "path", "line", F.get("lines", 0), F.col("lines"))),
        facts.where("raised").withColumn("kind", kind).where("kind <> ''").select(*_row("exception_type", "path", "name", F.col("kind"))),
        counts.select(*_row(F.concat(F.lit("loop_iterations."), F.col("loop").cast("string")), "workload", "int", F.coalesce("n", F.lit(0)))),
        returned.where("not raised and value is not null").select(*_row("return_value", "state", "value", F.col("value"))),
        _named_values(asked, "end.locals", MOST_LOCALS, "locals_at_exit.", "state", F.col("arguments")),
    ):
        out = out.union(more)
    return out


@F.pandas_udf(T.BooleanType())
def _same_value(expected: pd.Series, answer: pd.Series) -> pd.Series:
    """Whether an answer (JSON text, or the representation of a value) denotes the expected literal; numbers within 1e-6."""

    def plain(v: object) -> object:
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, (set, frozenset)):
            return ("set", sorted(repr(plain(x)) for x in v))
        return {repr(plain(k)): plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    def same(a: object, b: object) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            numbers = [isinstance(v, (int, float)) and not isinstance(v, bool) for v in (x, y)]
            if all(numbers):
                if not math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=1e-6):
                    return False
            elif type(x) is not type(y):
                return False
            elif isinstance(x, list):
                if len(x) != len(y):
                    return False
                todo += zip(x, y)
            elif isinstance(x, dict):
                if x.keys() != y.keys():
                    return False
                todo += ((x[k], y[k]) for k in x)
            elif x != y:
                return False
        return True

    def readings(text: str) -> list:
        try:
            found = [json.loads(text)]
        except ValueError:
            found = [text]
        if isinstance(found[0], str):
            try:
                found.insert(0, ast.literal_eval(found[0].strip()))
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                pass
        return found

    def one(want: str | None, got: str | None) -> bool:
        if want is None or got is None:
            return False
        try:
            goal = plain(ast.literal_eval(want))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return False
        return any(same(goal, plain(v)) for v in readings(got))

    return pd.Series([one(w, g) for w, g in zip(expected, answer)], dtype=bool)


def _text(answer: Column) -> Column:
    """A JSON string without its quotes, any other JSON as it is."""
    return F.coalesce(F.when(answer.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), answer, F.lit("}")), "$.v")), answer)


def _whole(text: Column) -> Column:
    """A whole number, also given as 3.0 or as text; not true or false."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("long")).when(trimmed.rlike(r"^[+-]?\d+\.0*([eE][+]?\d+)?$"), trimmed.try_cast("double").cast("long"))


def checkpoint_scores(specs: DataFrame, answers: DataFrame, statements: DataFrame, ignored: DataFrame, key: str = "instance_id") -> DataFrame:
    """key, checkpoint, level, answered, score of every checkpoint.

    ``specs``: key, checkpoint, func, level, kind, expected, accept (may be null);
    ``answers``: key, checkpoint, answer (JSON text); ``statements`` and ``ignored`` fold
    and drop answered lines. An int must be accepted, a line after folding, a set of lines
    has its F1, an enum is compared in lower case, a name by the answer's last part, a
    value as a Python literal. One answer for each checkpoint is expected.
    """
    both = written(specs.join(answers, [key, "checkpoint"], "left"), "answered")
    told = F.col("answer").isNotNull()
    text, accepted = _text(F.col("answer")), F.coalesce("accept", F.array(F.col("expected").try_cast("int")))
    number = _whole(text)
    lines = both.where(told & F.col("kind").isin("line", "line_set"))
    given = lines.withColumn("each", F.when(F.col("kind") == "line", F.array("answer")).otherwise(F.coalesce(F.from_json("answer", "array<string>"), F.array().cast("array<string>"))))
    given = given.select(key, "checkpoint", "func", "kind", "accept", F.explode("each").alias("t")).withColumn("line", _whole(_text(F.col("t")))).where("line is not null")
    met = folded(given.drop("t"), statements)
    dropped = ignored.select("func", F.col("line").cast("long").alias("line")).distinct().withColumn("gone", F.lit(True))
    met = met.join(dropped, ["func", "line"], "left").where("kind = 'line' or gone is null")
    found = met.groupBy(key, "checkpoint").agg(F.collect_set(F.col("line").cast("int")).alias("found"))
    scored = both.join(found, [key, "checkpoint"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<int>")))
    hits, n_found, n_want = F.size(F.array_intersect("found", "accept")), F.size("found"), F.size(F.array_distinct("accept"))
    f1 = F.round(c.f1(c.precision(hits, n_found, n_want), c.recall(hits, n_found, n_want)), 4)
    one = lambda ok: F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)
    score = (
        F.when(~told, 0.0).when(F.col("kind") == "int", one(F.array_contains(accepted, number.cast("int"))))
        .when(F.col("kind") == "line", one(F.size(F.array_intersect("found", accepted)) > 0))
        .when(F.col("kind") == "line_set", F.when((hits == n_found) & (hits == n_want), 1.0).when(hits > 0, f1).otherwise(0.0))
        .when(F.col("kind") == "enum", one(F.lower(F.trim(text)) == F.lower("expected")))
        .when(F.col("kind") == "name", one(F.element_at(F.split(F.trim(text), r"\."), -1) == F.col("expected")))
        .otherwise(F.when(F.col("same"), 1.0).otherwise(0.0)))
    marked = scored.withColumn("same", F.when(F.col("kind") == "value", _same_value("expected", "answer")))
    return marked.select(key, "checkpoint", "level", told.alias("answered"), score.alias("score"))


def _scopes(instances: DataFrame) -> DataFrame:
    """An answered instance counts in all, in those with its final result, and in its category."""
    each = F.array_compact(F.array(
        F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("name")),
        F.when(F.col("final_correct").isNotNull(), F.struct(F.lit("final").alias("scope"), F.when(F.col("final_correct"), "correct").otherwise("wrong").alias("name"))),
        F.struct(F.lit("category").alias("scope"), F.coalesce("category", F.lit("unknown")).alias("name"))))
    return instances.where("answered").withColumn("s", F.explode(each)).select("*", "s.scope", "s.name").drop("s")


def level_rates(levels: DataFrame, instances: DataFrame) -> DataFrame:
    """scope, name, level, instances, passed, pass_rate, mean_score over answered instances.

    ``levels``: instance_id, level, passed, mean_score; ``instances``: instance_id, category, answered, final_correct.
    """
    rows = levels.join(_scopes(instances), "instance_id")
    return rows.groupBy("scope", "name", "level").agg(F.count("*").alias("instances"), F.count_if("passed").alias("passed"), F.avg("mean_score").alias("mean_score")).select(
        "scope", "name", "level", "instances", "passed", (F.col("passed") / F.col("instances")).alias("pass_rate"), "mean_score")


def first_failures(ladders: DataFrame, instances: DataFrame) -> DataFrame:
    """scope, name, first_failed (none where nothing failed), n over answered instances."""
    rows = ladders.join(_scopes(instances), "instance_id")
    return rows.groupBy("scope", "name", F.coalesce(F.col("first_failed").cast("string"), F.lit("none")).alias("first_failed")).agg(F.count("*").alias("n"))


def ladder_overview(ladders: DataFrame, instances: DataFrame, answer_level: str = "answer") -> DataFrame:
    """scope, name, instances, mean_depth, monotone, monotone_rate, right_after_failure; unanswered instances as a row of their own.

    ``right_after_failure`` counts instances whose final answer is right though a level before it failed.
    """
    rows = ladders.join(_scopes(instances), "instance_id")
    failed = F.col("first_failed").isNotNull() & (F.col("first_failed").cast("string") != answer_level)
    told = rows.groupBy("scope", "name").agg(
        F.count("*").alias("instances"), F.avg("depth").alias("mean_depth"), F.count_if("monotone").alias("monotone"), F.count_if(F.coalesce(F.col("final_correct"), F.lit(False)) & failed).alias("right_after_failure"))
    silent = instances.where("not answered").groupBy(F.lit("unanswered").alias("scope"), F.lit("all").alias("name")).agg(F.count("*").alias("instances"))
    return told.unionByName(silent, allowMissingColumns=True).select(
        "scope", "name", "instances", "mean_depth", "monotone", (F.col("monotone") / F.col("instances")).alias("monotone_rate"), "right_after_failure")


def ladder_summary(ladders: DataFrame, by: list[str]) -> DataFrame:
    """Instances, mean depth, share of monotone ladders and failed ones, by any columns of the ladders."""
    return ladders.groupBy(*by).agg(F.count("*").alias("n"), F.avg("depth").alias("mean_depth"), F.avg(F.col("monotone").cast("double")).alias("monotone_rate"),
                                    F.count("first_failed").alias("failed"))


def call_facts(events: DataFrame) -> DataFrame:
    """trace_id, checkpoint, func, value over all calls of a function: how many, first line, distinct executed lines, last event and its line."""
    per = invocations(events).where("inv > 0").groupBy(*_BY).agg(
        F.max("inv").alias("calls"), F.min_by("line", "seq").alias("first_line"), F.count_distinct(F.when(F.col("event") == "line", F.col("line"))).alias("executed_lines"),
        F.max_by("event", "seq").alias("exit_kind"), F.max_by("line", "seq").alias("exit_line"))
    names = ["calls", "first_line", "executed_lines", "exit_kind", "exit_line"]
    return per.select(*_BY, F.explode(F.array(*[F.struct(F.lit(n).alias("checkpoint"), F.col(n).cast("string").alias("value")) for n in names])).alias("c")).select(
        "trace_id", "func", "c.checkpoint", "c.value")


def line_set_f1(expected: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """f1 of two sets of lines for each checkpoint."""
    both = expected.select(*by, "line").distinct().withColumn("_e", F.lit(1)).join(predicted.select(*by, "line").distinct().withColumn("_p", F.lit(1)), [*by, "line"], "full")
    agg = both.groupBy(*by).agg(F.count("_e").alias("e"), F.count("_p").alias("p"), F.count_if(F.col("_e").isNotNull() & F.col("_p").isNotNull()).alias("h"))
    n = [F.col("h"), F.col("p"), F.col("e")]
    return agg.select(*by, c.f1(c.precision(*n), c.recall(*n)).alias("score"))

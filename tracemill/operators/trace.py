"""Trace mining: windows and aggregates over line-level execution events.

Events are rows (trace_id, seq, file, line, func, event), ordered by ``seq`` in a
trace; ``event`` is call, line, return or exception. Windows run over one trace, or
over one function of one trace, so a run over many traces needs one shuffle by
trace and no global order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .prefix import row_numbers, running_total

#: One event: time, path:line, function, kind; then its tail, over any number of lines.
HEAD = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+) (\S+):(\d+) (\S+) event=(call|line|return|exception)"
TAIL = r"(?s)" + HEAD + "(.*)$"  # [\s\S]* takes four times as long
MARKER = "[TRACE]"


def _trace(*more: str) -> Window:
    return Window.partitionBy("trace_id", *more).orderBy("seq")


def _running(*more: str) -> Window:
    return _trace(*more).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def join_continuations(lines: DataFrame) -> DataFrame:
    """trace_id, pos, text -> trace_id, pos, record: lines that start nothing continue the record before.

    A marker line ends a record; what follows it up to the next record is dropped. The
    records are counted over ranges of lines, so one long log is dealt over all tasks.
    """
    marker = F.col("text").startswith(MARKER)
    begun = lines.select("trace_id", "pos", "text", (marker | F.col("text").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+ \S+:\d+ \S+ event=")).alias("start"))
    before = running_total(begun, ["trace_id"], [F.asc("pos")], F.col("start").cast("long"), "rec")
    numbered = before.withColumn("rec", F.col("rec") + F.col("start").cast("long")).where("rec > 0")
    ends = numbered.where(F.col("start") & marker)
    told = numbered.join(ends.select("trace_id", "rec"), ["trace_id", "rec"], "left_anti")
    whole = told.groupBy("trace_id", "rec").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    joined = whole.select("trace_id", F.get("parts", 0)["pos"].alias("pos"), F.array_join("parts.text", "\n").alias("record"))
    return joined.union(ends.select("trace_id", "pos", F.col("text").alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """trace_id, pos, record -> events with ts, file, line, func, event, tail; other records are dropped."""
    part = lambda k, pattern=HEAD: F.regexp_extract("record", pattern, k)
    return records.where(F.col("record").rlike(HEAD)).select(
        "trace_id", F.col("pos").alias("seq"), part(1).alias("ts"), part(2).alias("file"), part(3).cast("int").alias("line"),
        part(4).alias("func"), part(5).alias("event"), part(6, TAIL).alias("tail"))


def split_tail(events: DataFrame) -> DataFrame:
    """Events with retval, exc and locals (map of representations) out of ``tail``.

    The locals begin at the first `` locals=`` whose remainder is a literal dict.
    """
    import ast

    @F.pandas_udf("struct<prefix string, locals map<string,string>>")
    def parts(tail: pd.Series) -> pd.DataFrame:
        rows = []
        for t in tail:
            found, at = None, (t or "").find(" locals=")
            while at >= 0 and found is None:
                try:
                    value = ast.literal_eval(t[at + 8:].strip())
                    if isinstance(value, dict):
                        found = (t[:at], {str(k): str(v) for k, v in value.items()})
                except (ValueError, SyntaxError):
                    pass
                at = t.find(" locals=", at + 1)
            rows.append(found or (t or "", {}))
        return pd.DataFrame(rows, columns=["prefix", "locals"])

    split = events.withColumn("_p", parts("tail"))
    some = lambda c: F.when(c != "", c)
    return split.select(
        *events.columns, some(F.regexp_extract("_p.prefix", r"(?s)retval=(.*)", 1)).alias("retval"),
        some(F.regexp_extract("_p.prefix", r"(?s)exc=(.*)", 1)).alias("exc"), F.col("_p.locals").alias("locals"))


def target_filter(file_part: str, name: str) -> Column:
    """File holds the part; the function is the name, inside it, ends in it, or has it as last component."""
    func = F.col("func")
    return F.col("file").contains(file_part) & (
        (func == name) | func.startswith(f"{name}.") | func.endswith(f".{name}") | (F.element_at(F.split("func", r"\."), -1) == name))


def blocks(events: DataFrame, is_start: Column) -> DataFrame:
    """Events with ``block``: how many start markers came up to here in the trace."""
    return events.withColumn("block", F.sum(F.when(is_start, 1).otherwise(0)).over(_running()))


def invocations(events: DataFrame) -> DataFrame:
    """Events with ``inv``, the number of their function's calls so far; 0 before the first."""
    return events.withColumn("inv", F.sum(F.when(F.col("event") == "call", 1).otherwise(0)).over(_running("func")))


def call_depth(events: DataFrame) -> DataFrame:
    """Events with ``depth``: calls less returns, never below zero."""
    step = F.when(F.col("event") == "call", 1).when(F.col("event") == "return", -1).otherwise(0)
    summed = events.withColumn("_s", F.sum(step).over(_running()))
    return summed.withColumn("depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(_running()))).drop("_s")


def event_statistics(events: DataFrame) -> DataFrame:
    """Per trace: events of each kind, distinct lines and functions, most hits of a line."""
    hits = events.groupBy("trace_id", "file", "line").agg(F.count_if(F.col("event") == "line").alias("n"))
    most = hits.groupBy("trace_id").agg(F.max("n").alias("max_line_hits"))
    kinds = {k: F.count_if(F.col("event") == k).alias(f"{k}_events") for k in ("call", "line", "return", "exception")}
    return events.groupBy("trace_id").agg(
        F.count("*").alias("events"), *kinds.values(), F.count_distinct("file", "line").alias("lines"),
        F.count_distinct("func").alias("functions")).join(most, "trace_id")


def transition_counts(events: DataFrame) -> DataFrame:
    """trace_id, src, dst, n over successive line events, self-transitions too."""
    place = F.struct("file", "line")
    pairs = events.where(F.col("event") == "line").select("trace_id", place.alias("src"), F.lead(place).over(_trace()).alias("dst"))
    return pairs.where("dst is not null").groupBy("trace_id", "src", "dst").agg(F.count("*").alias("n"))


def transition_features(events: DataFrame) -> DataFrame:
    """Distinct transitions, branch points (lines with more than one successor) and their alternatives."""
    by_line = transition_counts(events).groupBy("trace_id", "src").agg(F.count("*").alias("out"), F.sum("n").alias("n"))
    return by_line.groupBy("trace_id").agg(
        F.sum("out").alias("transitions"), F.count_if(F.col("out") > 1).alias("branch_points"),
        F.sum(F.when(F.col("out") > 1, F.col("out") - 1).otherwise(0)).alias("branch_alternatives"))


def transition_entropy(events: DataFrame) -> DataFrame:
    """Entropy of the transitions over log2 of their number; 0 for one or none."""
    counts = transition_counts(events)
    total = counts.groupBy("trace_id").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    p = F.col("n") / F.col("total")
    return counts.join(total, "trace_id").groupBy("trace_id").agg(
        F.max("kinds").alias("kinds"), (-F.sum(p * F.log2(p))).alias("h")).select(
        "trace_id", F.when(F.col("kinds") <= 1, 0.0).otherwise(F.col("h") / F.log2("kinds")).alias("entropy"))


def state_changes(events: DataFrame, changed: Column) -> DataFrame:
    return events.groupBy("trace_id").agg(F.count_if((F.col("event") == "line") & changed).alias("state_changes"))


def executed_path(events: DataFrame, func: str, k: int) -> DataFrame:
    """trace_id, lines: the line events of the k-th invocation, in order."""
    of = invocations(events.where(F.col("func") == func)).where((F.col("inv") == k) & (F.col("event") == "line"))
    return of.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("p")).select("trace_id", F.col("p.line").alias("lines"))


def loop_iterations(events: DataFrame, func: str, body_line: int) -> DataFrame:
    """trace_id, inv, iterations: hits of the loop body's first line, zero for invocations without any."""
    of = invocations(events.where(F.col("func") == func)).where("inv > 0")
    return of.groupBy("trace_id", "inv").agg(F.count_if((F.col("event") == "line") & (F.col("line") == body_line)).alias("iterations"))


def iteration_extremes(events: DataFrame, func: str, body_line: int) -> DataFrame:
    return loop_iterations(events, func, body_line).groupBy("trace_id").agg(
        F.max("iterations").alias("max_iterations"), F.min("iterations").alias("min_iterations"), F.sum("iterations").alias("total_iterations"))


def line_counts(events: DataFrame, first: int, last: int) -> DataFrame:
    """trace_id, line, hits for every line of the range, zero where not executed."""
    counts = events.where((F.col("event") == "line") & F.col("line").between(first, last)).groupBy("trace_id", "line").agg(F.count("*").alias("hits"))
    spine = events.select("trace_id").distinct().select("trace_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("line"))
    return spine.join(counts, ["trace_id", "line"], "left").select("trace_id", "line", F.coalesce("hits", F.lit(0)).alias("hits"))


def line_coverage(events: DataFrame, func: str, first: int, last: int) -> DataFrame:
    """line, coverage: executed in always, sometimes or never over all invocations of the function."""
    of = invocations(events.where(F.col("func") == func)).where("inv > 0")
    total = of.select("trace_id", "inv").distinct().agg(F.count("*").alias("total"))
    seen = of.where(F.col("event") == "line").select("trace_id", "inv", "line").distinct().groupBy("line").agg(F.count("*").alias("n"))
    spine = total.select("total", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("line"))
    return spine.join(seen, "line", "left").select("line", F.when(F.col("n").isNull(), "never").when(F.col("n") == F.col("total"), "always").otherwise("sometimes").alias("coverage"))


def carried_state(events: DataFrame, value: str = "x", name: str = "state") -> DataFrame:
    """The current value of a local at every event of an invocation, from changed-only deltas."""
    return invocations(events).withColumn(name, F.last(value, ignorenulls=True).over(_running("func", "inv")))


def value_after_iteration(events: DataFrame, func: str, body_line: int, n: int) -> DataFrame:
    """trace_id, inv, value: the carried value at the event after the n-th hit of the body line."""
    carried = carried_state(events.where(F.col("func") == func)).where("inv > 0")
    after = carried.withColumn("value", F.lead("state").over(_trace("func", "inv")))
    hits = after.where((F.col("event") == "line") & (F.col("line") == body_line)).withColumn("k", F.row_number().over(_trace("inv")))
    return hits.where(F.col("k") == n).select("trace_id", "inv", "value")


def observed_values(events: DataFrame, func: str, line: int, k: int) -> DataFrame:
    """trace_id, inv, value at the k-th hit of a line in each invocation."""
    carried = carried_state(events.where(F.col("func") == func)).where("inv > 0")
    hits = carried.where((F.col("event") == "line") & (F.col("line") == line)).withColumn("k", F.row_number().over(_trace("inv")))
    return hits.where(F.col("k") == k).select("trace_id", "inv", F.col("state").alias("value"))


def variable_history(events: DataFrame, assigned: list[int]) -> DataFrame:
    """trace_id, func, inv, seq, value: what is seen at the event after each assignment line."""
    after = carried_state(events).where("inv > 0").withColumn("value", F.lead("state").over(_trace("func", "inv")))
    return after.where((F.col("event") == "line") & F.col("line").isin(assigned)).select("trace_id", "func", "inv", "seq", "value")


def unique_values(events: DataFrame, value: str = "x") -> DataFrame:
    """Per trace: distinct values in order, least and greatest."""
    return events.where(F.col(value).isNotNull()).groupBy("trace_id").agg(
        F.array_sort(F.collect_set(value)).alias("vals"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def def_use_events(events: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Each use with the last definition of its variable before it in the invocation.

    ``defs`` and ``uses`` are (line, variable). On one line uses come before
    definitions. trace_id, func, inv, seq, variable, def_line, def_seq, use_line.
    """
    lines = invocations(events).where((F.col("event") == "line") & (F.col("inv") > 0)).select("trace_id", "func", "inv", "seq", "line")
    reads = lines.join(uses, "line").select("*", F.lit(0).alias("kind"))
    writes = lines.join(defs, "line").select("*", F.lit(1).alias("kind"))
    order = Window.partitionBy("trace_id", "func", "inv", "variable").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    made = lambda c: F.last(F.when(F.col("kind") == 1, F.col(c)), ignorenulls=True).over(order)
    both = reads.unionByName(writes).withColumns({"def_line": made("line"), "def_seq": made("seq")})
    return both.where((F.col("kind") == 0) & F.col("def_line").isNotNull()).select(
        "trace_id", "func", "inv", "seq", "variable", "def_line", "def_seq", F.col("line").alias("use_line"))


def def_use_counts(events: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """variable, def_line, use_line, n; the distinct pairs are its rows."""
    return def_use_events(events, defs, uses).groupBy("variable", "def_line", "use_line").agg(F.count("*").alias("n"))


def dead_definitions(events: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """trace_id, func, inv, variable, line of definitions no use has read, once a line."""
    lines = invocations(events).where((F.col("event") == "line") & (F.col("inv") > 0)).select("trace_id", "func", "inv", "seq", "line")
    made = lines.join(defs, "line")
    used = def_use_events(events, defs, uses).select("trace_id", "func", "inv", "variable", F.col("def_seq").alias("seq"))
    return made.join(used, ["trace_id", "func", "inv", "variable", "seq"], "left_anti").select("trace_id", "func", "inv", "variable", "line").distinct()


def exception_counts(events: DataFrame, exc_type: Column) -> DataFrame:
    return events.where(F.col("event") == "exception").groupBy(exc_type.alias("exception_type")).agg(F.count("*").alias("n"))


def escaping_exceptions(events: DataFrame) -> DataFrame:
    """Exceptions that their frame's next event, a return, lets out."""
    after = invocations(events).where("inv > 0").withColumn("next", F.lead("event").over(_trace("func", "inv")))
    return after.where((F.col("event") == "exception") & (F.col("next") == "return")).select("trace_id", "func", "inv", "seq", "line")


def caught_exceptions(events: DataFrame, tries: DataFrame) -> DataFrame:
    """trace_id, seq, kind: raised in a try body, with the frame's next line event in one of its handlers.

    ``tries``: try_first, try_last, handler_first, handler_last, kind.
    """
    after = invocations(events).where("inv > 0").withColumns({
        "next": F.lead("event").over(_trace("func", "inv")), "next_line": F.lead("line").over(_trace("func", "inv"))})
    raised = after.where((F.col("event") == "exception") & (F.col("next") == "line"))
    by_line = tries.select("kind", "handler_first", "handler_last", F.explode(F.sequence("try_first", "try_last")).alias("line"))
    return raised.join(by_line, "line").where(F.col("next_line").between(F.col("handler_first"), F.col("handler_last"))).select("trace_id", "seq", "kind")


def crash_matrix(events: DataFrame, is_start: Column, exc_type: Column) -> DataFrame:
    """trace_id, block, exception_type of each block's last exception, null where it is safe."""
    return blocks(events, is_start).groupBy("trace_id", "block").agg(
        F.max_by(F.when(F.col("event") == "exception", exc_type), F.when(F.col("event") == "exception", F.col("seq"))).alias("exception_type"))


def calls_during(events: DataFrame, func: str, k: int) -> DataFrame:
    """Calls made while the k-th invocation of ``func`` is on the stack: trace_id, seq, callee.

    Resumptions (a call at another line than the function's first) and synthetic
    frames (names in angle brackets) are dropped.
    """
    deep = call_depth(events)
    calls = deep.where(F.col("event") == "call").withColumn("k", F.row_number().over(_trace("func")))
    begin = calls.where((F.col("func") == func) & (F.col("k") == k)).select("trace_id", F.col("seq").alias("from"), F.col("depth").alias("at"))
    ends = deep.join(begin, "trace_id").where((F.col("seq") > F.col("from")) & (F.col("depth") < F.col("at"))).groupBy("trace_id").agg(F.min("seq").alias("to"))
    span = begin.join(ends, "trace_id", "left")
    first = calls.groupBy("func").agg(F.min("line").alias("first_line"))
    return calls.join(span, "trace_id").where((F.col("seq") > F.col("from")) & (F.col("to").isNull() | (F.col("seq") < F.col("to")))).join(
        first, "func").where((F.col("line") == F.col("first_line")) & ~F.col("func").startswith("<")).select("trace_id", "seq", F.col("func").alias("callee"))


def call_counts(events: DataFrame, scope: DataFrame) -> DataFrame:
    """func, calls over a scope of functions, zero where none was called."""
    counts = events.where(F.col("event") == "call").groupBy("func").agg(F.count("*").alias("n"))
    return scope.join(counts, "func", "left").select("func", F.coalesce("n", F.lit(0)).alias("calls"))


def covered_functions(events: DataFrame, scope: DataFrame) -> DataFrame:
    return events.where(F.col("event") == "call").select("func").join(scope, "func", "left_semi").distinct()


def direct_callers(events: DataFrame, func: str) -> DataFrame:
    """caller, calls: the function on top of the stack at each call of ``func``.

    Here the stack pops on returns and exceptions; the caller is the last call at
    one level less.
    """
    pops = F.col("event").isin("return", "exception")
    step = F.when(F.col("event") == "call", 1).when(pops, -1).otherwise(0)
    deep = events.withColumn("_s", F.sum(step).over(_running()))
    deep = deep.withColumn("level", F.col("_s") - F.least(F.lit(0), F.min("_s").over(_running()))).where(F.col("event") == "call")
    # the caller of a call at level d is the latest call at level d - 1 before it
    up = Window.partitionBy("trace_id", "up").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    as_caller = deep.select("trace_id", "seq", F.col("level").alias("up"), F.col("func").alias("c"), F.lit(None).cast("string").alias("called"))
    as_call = deep.select("trace_id", "seq", (F.col("level") - 1).alias("up"), F.lit(None).cast("string").alias("c"), F.col("func").alias("called"))
    found = as_caller.union(as_call).withColumn("caller", F.last("c", ignorenulls=True).over(up))
    return found.where((F.col("called") == func) & F.col("caller").isNotNull()).groupBy("caller").agg(F.count("*").alias("calls"))


def invariant_report(events: DataFrame, predicates: dict[str, tuple[int, str]]) -> DataFrame:
    """predicate, observations, violations, held_always; ``predicates``: name -> (line, SQL over state).

    An observation is a line event at the predicate's line with a known state; a
    predicate that was never observed did not hold.
    """
    carried = carried_state(events).where((F.col("event") == "line") & F.col("state").isNotNull())
    checks = F.array(*[F.struct(F.lit(n).alias("predicate"), F.lit(l).alias("at"), F.expr(e).alias("holds")) for n, (l, e) in predicates.items()])
    seen = carried.select("line", F.explode(checks).alias("c")).where(F.col("line") == F.col("c.at"))
    report = seen.groupBy("c.predicate").agg(F.count("*").alias("observations"), F.count_if(~F.col("c.holds")).alias("violations"))
    names = events.sparkSession.createDataFrame([(n,) for n in predicates], "predicate string")
    full = names.join(report, "predicate", "left").select(
        "predicate", F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("violations", F.lit(0)).alias("violations"))
    return full.withColumn("held_always", (F.col("observations") > 0) & (F.col("violations") == 0))


def new_lines(trace: DataFrame, baseline: DataFrame) -> DataFrame:
    """file, line executed in the trace and not in the baseline."""
    lines = lambda t: t.where(F.col("event") == "line").select("file", "line").distinct()
    return lines(trace).join(lines(baseline), ["file", "line"], "left_anti")


def beyond_first(rows: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Rows (trace_id, keys) that the first trace with the same ``by`` does not have; that trace is the baseline."""
    first = rows.groupBy(by).agg(F.min("trace_id").alias("trace_id"))
    baseline = rows.join(first, [by, "trace_id"]).select(*keys).distinct()
    return rows.select("trace_id", *keys).distinct().join(baseline, keys, "left_anti")


def lines_beyond_first(events: DataFrame) -> DataFrame:
    """trace_id, file, line executed in a trace and not in the first trace of the file."""
    return beyond_first(events.where(F.col("event") == "line"), "file", ["file", "line"])


def edges_beyond_first(events: DataFrame) -> DataFrame:
    """trace_id, file, func, src, dst taken in a trace and not in the first trace of the file."""
    return beyond_first(_edges(events), "file", ["file", "func", "src", "dst"])


def first_seen_lines(events: DataFrame) -> DataFrame:
    """trace_id, file, line of every line that no trace before executed."""
    return events.where(F.col("event") == "line").groupBy("file", "line").agg(F.min("trace_id").alias("trace_id")).select("trace_id", "file", "line")


def function_edges(events: DataFrame) -> DataFrame:
    """file, func, src, dst between successive different lines of one function, over all events."""
    return _edges(events).select("file", "func", "src", "dst").distinct()


def _edges(events: DataFrame) -> DataFrame:
    before = F.lag("line").over(_trace("file", "func"))
    return events.withColumn("src", before).where(F.col("src").isNotNull() & (F.col("src") != F.col("line"))).select(
        "trace_id", "file", "func", "src", F.col("line").alias("dst"))


def trace_edges(events: DataFrame) -> DataFrame:
    """trace_id, file, func, src, dst: the distinct edges of each trace."""
    return _edges(events).distinct()


def first_seen_edges(events: DataFrame) -> DataFrame:
    """trace_id, file, func, src, dst of every edge that no trace before took."""
    return _edges(events).groupBy("file", "func", "src", "dst").agg(F.min("trace_id").alias("trace_id"))


#: Two primes below 2^31 and a base for each: sums of products modulo both tell paths apart.
_MODULI = [(2147483647, 1103515245), (2147483629, 69069)]
_DIGIT, _DIGITS = 256, 5


def _power(base: int, modulus: int, exponent: Column) -> Column:
    """base ** exponent modulo a prime, from tables of the digits of the exponent (below 256 ** 5)."""
    out = None
    for k in range(_DIGITS):
        table = F.lit([pow(base, d * _DIGIT**k, modulus) for d in range(_DIGIT)])
        factor = F.get(table, F.shiftright(exponent, 8 * k).bitwiseAND(F.lit(_DIGIT - 1)).cast("int")).cast("long")
        out = factor if out is None else out * factor % modulus
    return out


def path_digest(events: DataFrame) -> DataFrame:
    """trace_id, steps, digest of the ordered lines: equal paths have equal digests, and others have not, but for a chance of 2^-60.

    The digest is a sum over the lines, each times a power of its place, so tasks add up
    their parts; places are counted over ranges. No path stands in one row or one task.
    """
    lines = events.where(F.col("event") == "line").select("trace_id", "seq", "file", "line")
    placed = row_numbers(lines, ["trace_id"], [F.asc("seq"), F.asc("file"), F.asc("line")], "place")
    sums = [(F.sum(F.pmod(F.xxhash64(F.lit(k), "file", "line"), F.lit(p)) * _power(b, p, F.col("place")) % p) % p).alias(f"_d{k}") for k, (p, b) in enumerate(_MODULI)]
    return placed.groupBy("trace_id").agg(F.count("*").alias("steps"), *sums).select(
        "trace_id", "steps", (F.col("_d0") * F.lit(1 << 31) + F.col("_d1")).alias("digest"))


def equal_paths(events: DataFrame) -> DataFrame:
    """trace_id, steps, first: the least trace with the same path, and how many there are (``traces``)."""
    digests = written(path_digest(events), "digests")
    groups = digests.groupBy("steps", "digest").agg(F.min("trace_id").alias("first"), F.count("*").alias("traces"))
    return digests.join(groups, ["steps", "digest"]).select("trace_id", "steps", "first", "traces")

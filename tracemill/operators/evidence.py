"""Evidence coverage, checkpoint ladders and perturbation analysis."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import canonical_json
from ..sources.dealt import dealt
from ..sources.shared import shared_path
from .joins import suffix_pairs
from .source_code import FILES_A_TASK, statements
from .trace import path_digest, trace_edges


def depth_class(depth: Column) -> Column:
    """target, direct or deeper by call depth; below zero is upstream."""
    return F.when(depth < 0, "upstream").when(depth == 0, "target").when(depth == 1, "direct").otherwise("deeper")


def depths_from_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """module, root, func, depth: least number of calls from each root within its module, until no function is new.

    ``edges``: module, caller, callee; ``roots``: module, root. Each round's frontier is written to the shared folder.
    """
    spark = edges.sparkSession
    keys, path = ["module", "root", "func"], shared_path(spark, "depths")
    roots.select("module", "root", F.col("root").alias("func")).distinct().withColumn("depth", F.lit(0)).write.parquet(f"{path}/0")
    schema = spark.read.parquet(f"{path}/0").schema
    met = lambda k: spark.read.schema(schema).parquet(*[f"{path}/{i}" for i in range(k)])
    k = 1
    while True:
        frontier = spark.read.schema(schema).parquet(f"{path}/{k - 1}")
        if frontier.isEmpty():
            return met(k)
        reached = edges.join(frontier.select("module", "root", F.col("func").alias("caller")), ["module", "caller"]).select(
            "module", "root", F.col("callee").alias("func")).distinct()
        reached.join(met(k).select(*keys), keys, "left_anti").withColumn("depth", F.lit(k)).write.parquet(f"{path}/{k}")
        k += 1


def _lines(ranges: DataFrame, *keep: str) -> DataFrame:
    return ranges.select(*keep, F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()


def seen_lines(required: DataFrame, seen: DataFrame) -> DataFrame:
    """instance_id, file, line that were read, under the file names of ``required`` (one name may be a tail of the other)."""
    pairs = suffix_pairs(required, seen, ["instance_id"])
    read = seen.select("instance_id", F.col("file").alias("file_b"), "start_line", "end_line").join(pairs, ["instance_id", "file_b"])
    return _lines(read.withColumnRenamed("file_a", "file"), "instance_id", "file")


CLASSES = ["target", "direct", "deeper"]


def class_coverage(functions: DataFrame, seen: DataFrame) -> DataFrame:
    """instance_id, class, functions, functions_read, lines, lines_read, recall of executed functions by class of depth.

    ``functions``: instance_id, file, function, depth, line, a row for each executed line;
    ``seen``: instance_id, file, line. A function is read if every line of it was.
    """
    lines = functions.select("instance_id", "file", "function", depth_class(F.col("depth")).alias("class"), "line").distinct()
    marked = lines.join(seen.select("instance_id", "file", "line").distinct().withColumn("_s", F.lit(1)), ["instance_id", "file", "line"], "left")
    each = marked.groupBy("instance_id", "class", "file", "function").agg(F.count("*").alias("n"), F.count("_s").alias("hit"))
    return each.groupBy("instance_id", "class").agg(
        F.count("*").alias("functions"), F.count_if(F.col("hit") == F.col("n")).alias("functions_read"), F.sum("n").alias("lines"), F.sum("hit").alias("lines_read")).withColumn(
        "recall", F.col("lines_read") / F.col("lines"))


def coverage(functions: DataFrame, seen: DataFrame) -> DataFrame:
    """instance_id, required_functions, required_lines, recall, function_recall, sufficient: the target, direct and deeper classes together.

    Reading is sufficient if every required function was read whole; upstream code is not required.
    """
    own = F.col("class").isin(CLASSES)
    part = lambda c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0))
    agg = class_coverage(functions, seen).groupBy("instance_id").agg(*[part(c).alias(c) for c in ("functions", "functions_read", "lines", "lines_read")])
    return agg.select(
        "instance_id", F.col("functions").alias("required_functions"), F.col("lines").alias("required_lines"), (F.col("lines_read") / F.nullif("lines", F.lit(0))).alias("recall"),
        (F.col("functions_read") / F.nullif("functions", F.lit(0))).alias("function_recall"), ((F.col("functions") > 0) & (F.col("functions_read") == F.col("functions"))).alias("sufficient"))


def read_precision(executed: DataFrame, seen: DataFrame) -> DataFrame:
    """Share of the lines read that were executed."""
    marked = seen.distinct().join(executed.distinct().withColumn("_x", F.lit(1)), ["instance_id", "file", "line"], "left")
    return marked.groupBy("instance_id").agg((F.count("_x") / F.count("*")).alias("precision"))


def required_recall(ranges: DataFrame, seen: DataFrame, enough: float = 0.9, code: DataFrame | None = None) -> DataFrame:
    """Entries read at ``enough`` of their lines, over all and over essential entries; ``complete`` if all were.

    With ``code`` (file, line) only lines that carry code count; an entry without any keeps all its lines.
    """
    lines = _lines(ranges, "instance_id", "file", "range_id", "necessity")
    if code is not None:
        marked = lines.join(code.select("file", "line").distinct().withColumn("_c", F.lit(1)), ["file", "line"], "left")
        some = F.count("_c").over(Window.partitionBy("instance_id", "range_id"))  # one entry's lines
        lines = marked.withColumn("_n", some).where("_c is not null or _n = 0").drop("_c", "_n")
    lines = lines.join(seen.withColumn("_s", F.lit(1)), ["instance_id", "file", "line"], "left")
    entry = lines.groupBy("instance_id", "range_id", "necessity").agg(F.count("*").alias("n"), F.count("_s").alias("hit"))
    ok, essential = F.col("hit") >= enough * F.col("n"), F.col("necessity") == "essential"
    return entry.groupBy("instance_id").agg(
        F.count("*").alias("entries"), F.count_if(ok).alias("read_entries"), (F.count_if(ok) / F.count("*")).alias("recall"),
        F.when(F.count_if(essential) > 0, F.count_if(ok & essential) / F.count_if(essential)).alias("essential_recall"),
        F.sum("n").alias("lines"), F.sum("hit").alias("lines_read"), (F.count_if(ok) == F.count("*")).alias("complete"),
        ((F.count_if(essential) > 0) & (F.count_if(ok & essential) == F.count_if(essential))).alias("essential_complete"))


def downgraded(entries: DataFrame, test_names: DataFrame) -> DataFrame:
    """Short data or configuration assignments whose name the test assigns too become supporting."""
    name = F.regexp_extract("code", r"^\s*([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)", 1)
    short = (F.col("end_line") - F.col("start_line") + 1 <= 3) & F.col("role").isin("data", "configuration")
    named = entries.withColumn("_n", name).join(test_names.select("instance_id", F.col("name").alias("_n")).distinct().withColumn("_t", F.lit(True)), ["instance_id", "_n"], "left")
    return named.withColumn("necessity", F.when(short & F.col("_t").isNotNull(), "supporting").otherwise(F.col("necessity"))).drop("_n", "_t")


def docstring_lines(files: DataFrame) -> DataFrame:
    """file, line of the docstrings of modules, classes and functions of Python files (file, text); other texts have none."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"]):
                if not text or '"' not in text and "'" not in text:  # a docstring is quoted
                    continue
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError, MemoryError, RecursionError):
                    continue
                for node in statements(tree):
                    if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body:
                        first = node.body[0]
                        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                            rows += [(file, n) for n in range(first.lineno, first.end_lineno + 1)]
            yield pd.DataFrame(rows, columns=["file", "line"])

    kind = files.schema["file"].dataType
    return dealt(files.select("file", "text"), each=FILES_A_TASK).mapInPandas(of, T.StructType([T.StructField("file", kind), T.StructField("line", T.LongType())]))


def code_lines(files: DataFrame) -> DataFrame:
    """file, line of (file, text): lines, from 1, that are not blank, a comment or part of a docstring."""
    lines = dealt(files.select("file", "text"), each=FILES_A_TASK).select("file", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "text")).where(~F.col("text").rlike(r"^\s*(#.*)?$"))
    return lines.select("file", (F.col("pos") + 1).cast("long").alias("line")).join(docstring_lines(files), ["file", "line"], "left_anti")


def coverage_summary(rows: DataFrame, means: list[str], rates: list[str]) -> DataFrame:
    """scope, name, instances, means (nulls skipped) and rates: overall, correct, wrong and by category.

    ``rows``: category, correct (null without an answer), the columns named. An instance without an answer counts in its category and overall.
    """
    each = F.array_compact(F.array(
        F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("name")),
        F.when(F.col("correct").isNotNull(), F.struct(F.lit("answer").alias("scope"), F.when(F.col("correct"), "correct").otherwise("wrong").alias("name"))),
        F.struct(F.lit("category").alias("scope"), F.coalesce(F.col("category").cast("string"), F.lit("unknown")).alias("name"))))
    scoped = rows.withColumn("_s", F.explode(each)).select("*", "_s.scope", "_s.name")
    return scoped.groupBy("scope", "name").agg(
        F.count("*").alias("instances"), *[F.avg(m).alias(m) for m in means], *[F.avg(F.coalesce(F.col(r), F.lit(False)).cast("double")).alias(f"{r}_rate") for r in rates])


def correctness_table(rows: DataFrame, condition: str) -> DataFrame:
    """One row: instances, how many meet the condition, and each combination with a right or wrong answer; unanswered apart. Null is not met."""
    met, right = F.coalesce(F.col(condition), F.lit(False)), F.col("correct")
    return rows.agg(
        F.count("*").alias("instances"), F.count_if(met).alias("met"), F.count_if(met & right).alias("met_correct"), F.count_if(met & ~right).alias("met_wrong"),
        F.count_if(~met & right).alias("unmet_correct"), F.count_if(~met & ~right).alias("unmet_wrong"), F.count_if(right.isNull()).alias("no_answer"),
        (F.count_if(met) / F.nullif(F.count("*"), F.lit(0))).alias("met_rate"))


def level_results(scores: DataFrame) -> DataFrame:
    """instance_id, level, passed (all of its checkpoints right), mean score."""
    return scores.groupBy("instance_id", "level").agg(F.bool_and(F.col("score") == 1).alias("passed"), F.avg("score").alias("mean_score"))


def ladder(levels: DataFrame) -> DataFrame:
    """Per instance: levels, depth (passes before the first failure), first failed level, monotone (no pass after a failure)."""
    order = Window.partitionBy("instance_id").orderBy("level")
    numbered = levels.withColumn("ord", F.row_number().over(order))
    agg = numbered.groupBy("instance_id").agg(
        F.count("*").alias("levels"), F.min(F.when(~F.col("passed"), F.col("ord"))).alias("_fail"),
        F.min(F.when(~F.col("passed"), F.col("level"))).alias("first_failed"), F.max(F.when(F.col("passed"), F.col("ord"))).alias("_pass"))
    return agg.select("instance_id", "levels", F.coalesce(F.col("_fail") - 1, "levels").cast("long").alias("depth"), "first_failed",
                      (F.col("_fail").isNull() | F.col("_pass").isNull() | (F.col("_pass") < F.col("_fail"))).alias("monotone"))


def source_pool(instances: DataFrame, validated: DataFrame, rejected: DataFrame, passing: DataFrame | None = None) -> DataFrame:
    """Easy, validated instances that were not rejected, optionally only passing ones."""
    pool = instances.where(F.col("label") == "easy").join(validated, "instance_id", "left_semi").join(rejected, "instance_id", "left_anti")
    return pool if passing is None else pool.join(passing, "instance_id", "left_semi")


def canonical_changed(a: Column, b: Column) -> Column:
    """Two JSON texts differ in more than spacing and key order."""
    return canonical_json(a) != canonical_json(b)


# The order of difficulty labels that a goal asks for.
GOALS = {"medium": 1, "hard": 2, "very_hard": 3}
METRICS = ["semantic_reasoning", "answer_construction", "repository_navigation"]


def score_deltas(rows: DataFrame, metrics: list[str], goal: str = "increased", combined: str = "combined", label: str = "label", all_up: bool = False) -> DataFrame:
    """``rows`` with d_<metric> to three digits, increased, all_up and target_met.

    Columns old_<m> and new_<m> for the metrics and ``combined``, and the new ``label``.
    The goal is none, increased, or a label to be reached by an increase; with ``all_up``
    any goal but none asks for an increase of every metric besides. A row without a new
    combined score meets no goal.
    """
    if goal not in ("none", "increased", *GOALS):
        raise ValueError(f"no such goal: {goal}")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    deltas = {f"d_{m}": F.bround(number(f"new_{m}") - number(f"old_{m}"), 3) for m in [*metrics, combined]}
    out = rows.withColumns(deltas).withColumn("increased", F.col(f"d_{combined}") > 0)
    up = F.lit(True)
    for m in metrics:
        up = up & (F.col(f"d_{m}") > 0)
    rank = F.array_position(F.array(*map(F.lit, ["easy", "medium", "hard", "very_hard"])), F.col(label)) - 1
    met = F.lit(True) if goal == "none" else F.col("increased") if goal == "increased" else F.col("increased") & (F.coalesce(rank, F.lit(-1)) >= GOALS[goal])
    if all_up and goal != "none":
        met = met & up
    return out.withColumns({"all_up": up, "target_met": F.coalesce(F.col(f"new_{combined}").isNotNull() & met, F.lit(False))})


def trace_changes(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """trace_id, baseline_id, line_events, baseline_line_events, trace_ratio, new_lines, new_edges, same_path of each pair of traces.

    The ratio is that of the line events, to three digits (null without any in the
    baseline); lines and edges are counted that the baseline does not have; paths are
    compared by digest. Joins on (trace, line) and (trace, edge), so a pair costs its own rows.
    """
    seen = pairs.select("trace_id", "baseline_id").distinct()
    counts = events.groupBy("trace_id").agg(F.count_if(F.col("event") == "line").alias("n"))
    digests = path_digest(events).select("trace_id", "steps", "digest")
    lines = events.where(F.col("event") == "line").select("trace_id", "file", "line").distinct()

    def beyond(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        own = seen.join(rows, "trace_id")
        base = seen.join(rows.withColumnRenamed("trace_id", "baseline_id"), "baseline_id").select("trace_id", "baseline_id", *keys)
        return own.join(base, ["trace_id", "baseline_id", *keys], "left_anti").groupBy("trace_id", "baseline_id").agg(F.count("*").alias(name))

    base = lambda df: df.select(F.col("trace_id").alias("baseline_id"), *[F.col(c).alias(f"b_{c}") for c in df.columns if c != "trace_id"])
    both = ["trace_id", "baseline_id"]
    out = seen.join(counts, "trace_id", "left").join(base(counts), "baseline_id", "left").join(digests, "trace_id", "left").join(base(digests), "baseline_id", "left")
    out = out.join(beyond(lines, ["file", "line"], "new_lines"), both, "left").join(beyond(trace_edges(events), ["file", "func", "src", "dst"], "new_edges"), both, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        *both, zero("n").alias("line_events"), zero("b_n").alias("baseline_line_events"), F.bround(zero("n") / F.nullif(zero("b_n"), F.lit(0)), 3).alias("trace_ratio"),
        zero("new_lines").alias("new_lines"), zero("new_edges").alias("new_edges"), (F.col("steps").eqNullSafe(F.col("b_steps")) & F.col("digest").eqNullSafe(F.col("b_digest"))).alias("same_path"))


def flips(original: DataFrame, perturbed: DataFrame) -> DataFrame:
    """instance_id, flipped: the original passed and the perturbed failed; refusals give no verdict."""
    both = original.select("instance_id", F.col("passed").alias("was")).join(perturbed.select("instance_id", F.col("passed").alias("now")), "instance_id")
    return both.select("instance_id", F.when(F.col("was").isNull() | F.col("now").isNull(), None).otherwise(F.col("was") & ~F.col("now")).alias("flipped"))


def first_failing_gate(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate not passed, else kept."""
    out = None
    for name, ok in gates:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out.otherwise("kept")


def funnel(attempts: DataFrame) -> DataFrame:
    """One row: the counts of the attempts, and the upper median of the trace ratios of the harvested.

    Columns: stage (harvest, screen, complexity, flip, kept), oracle_changed, trace_changed,
    target_met, increased, flipped (null: not checked), trace_ratio (0: not harvested),
    infra_error, cost.
    """
    kept, at = F.col("stage") == "kept", lambda s: F.count_if(F.col("stage") == s)
    counts = attempts.agg(
        F.count("*").alias("attempts"), F.count_if(kept).alias("kept"), at("harvest").alias("harvest_failures"), at("screen").alias("screening_failures"), at("complexity").alias("complexity_failures"),
        F.count_if(~F.col("oracle_changed")).alias("oracle_unchanged"), F.count_if(kept & F.col("oracle_changed")).alias("oracle_changed"), F.count_if(kept & F.col("trace_changed")).alias("trace_changed"),
        F.count("target_met").alias("complexity_checked"), F.count_if("increased").alias("complexity_increased"), F.count_if("target_met").alias("complexity_target_met"),
        F.count_if(F.col("trace_ratio") > 1).alias("longer"), F.count_if((F.col("trace_ratio") > 0) & (F.col("trace_ratio") < 1)).alias("shorter"),
        F.count("flipped").alias("flip_checked"), F.count_if("flipped").alias("flipped"), F.count_if("infra_error").alias("flip_infra_errors"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("flip_cost"))
    middle = upper_median(attempts.where("trace_ratio <> 0").withColumn("_all", F.lit(1)), ["_all"], "trace_ratio").select("upper_median")
    return counts.join(middle, how="left").withColumn("median_trace_ratio", F.coalesce("upper_median", F.lit(0.0))).drop("upper_median")  # one row each


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at half of the count, in order, of each group: the upper one of two middle values."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("_n").over(Window.partitionBy(*by))
    return counted.withColumns({"_c": up_to, "_t": total}).where("_c > floor(_t / 2)").groupBy(*by).agg(F.min(value).alias("upper_median"))


def weak_sources(attempts: DataFrame) -> DataFrame:
    """source_id, attempts of sources of which no attempt met its goal."""
    return attempts.groupBy("source_id").agg(F.count("*").alias("attempts"), F.bool_or("met").alias("_m")).where(~F.col("_m")).drop("_m")

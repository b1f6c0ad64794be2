"""Corpus screening: rules over items that keep or exclude them, with reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A rule gives (passed, reason) as columns over the item's row.
Rule = Callable[[], tuple[Column, Column]]
# Signatures of a provider's refusal in a log; the first that is found names the cause.
INFRASTRUCTURE = [
    ("out of usage credits", "provider usage limit"), ("usage limit reached", "provider usage limit"), ("credit balance is too low", "provider usage limit"),
    ("session limit", "provider usage limit"), ("hit your usage limit", "provider usage limit"), ("weekly limit", "provider usage limit"),
    ("limit \u00b7 resets", "provider usage limit"), ("rate_limit_error", "provider rate limit"), ('"error": "rate_limit"', "provider rate limit"),
    ('"api_error_status": 429', "provider rate limit"), ("too many requests", "provider rate limit"), ("invalid api key", "auth failure"),
    ("authentication_error", "auth failure"), ("please run /login", "auth failure"), ("oauth token has expired", "auth failure"),
]
# What a refusal says, and what else says that no answer was given.
REFUSALS = [
    "insufficient balance", "exceeded_current_quota", "quota", "rate_limit", "ratelimiterror", "429", "too many requests", "insufficient_quota", "authentication",
    "invalid api key", "permission denied", "does not exist or you do not have access", "model_not_found", "overloaded", "service unavailable", "502", "503", "504",
]
NO_ANSWER = ["llm inference failed", "no valid json", "produced no answer"]


def oracle_valid(kind: Column, planned: Column, question: Column, answer: Column) -> Column:
    """All parts are there, the kind is the planned one, and neither question nor answer is empty."""
    filled = lambda c: c.isNotNull() & ~F.trim(c).isin("", "null", "{}", "[]", '""')
    return F.coalesce((kind == planned) & filled(question) & filled(answer), F.lit(False))


def rich_answers(leaves: DataFrame, items: DataFrame, thresholds: DataFrame) -> DataFrame:
    """answer_id, leaves, passed: at least as many leaves as the item's category asks."""
    counts = leaves.groupBy("answer_id").agg(F.count("*").alias("leaves"))
    return items.join(counts, "answer_id", "left").join(thresholds, "category", "left").select(
        "answer_id", F.coalesce("leaves", F.lit(0)).alias("leaves"), (F.coalesce("leaves", F.lit(0)) >= F.coalesce("min_leaves", F.lit(1))).alias("passed"))


def test_passed(log: Column) -> Column:
    """The last counts line names passed tests, none failed or in error, and nothing was reported as a failure."""
    counts = F.regexp_extract_all(log, F.lit(r"(?m)^.*\d+ (?:passed|failed|error).*$"), F.lit(0))
    last = F.try_element_at(counts, F.lit(-1))
    return F.coalesce(last.rlike(r"\d+ passed") & ~last.rlike(r"\d+ (failed|error)") & ~log.contains("FAILURES"), F.lit(False))


def distinctive_leaves(leaves: DataFrame, exempt_keys: list[str], least_number: float = 10, least_chars: int = 5) -> DataFrame:
    """answer_id, value: distinct numbers and strings that would give the answer away."""
    number = (F.col("vtype") == "number") & (F.abs("nval") >= least_number)
    string = (F.col("vtype") == "string") & (F.length("sval") >= least_chars)
    return leaves.where((number | string) & ~F.col("key_name").isin(exempt_keys)).select("answer_id", F.col("sval").alias("value")).distinct()


def leak_rule(values: DataFrame, documents: DataFrame, least: int = 2, share: float = 0.8) -> DataFrame:
    """answer_id, n, leaked share and passed; a value leaks if it stands in the document (answer_id, text)."""
    joined = values.join(documents, "answer_id").withColumn("found", F.col("text").contains(F.col("value")))
    found = joined.groupBy("answer_id").agg(F.count("*").alias("n"), F.avg(F.col("found").cast("double")).alias("leaked"), F.count_if("found").alias("hits"))
    return found.select("answer_id", "n", "leaked", ~((F.col("n") >= least) & (F.col("leaked") >= share)).alias("passed"))


def minimum_rule(stats: DataFrame, thresholds: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """``stats`` with ``short``: the metrics below their minimum for the category."""
    joined = stats.join(thresholds, by, "left")
    short = F.filter(F.array(*[F.when(F.coalesce(F.col(m), F.lit(0)) < F.col(f"min_{m}"), F.lit(m)) for m in metrics]), lambda x: x.isNotNull())
    return joined.withColumn("short", short).withColumn("passed", F.size("short") == 0).drop(*[f"min_{m}" for m in metrics])


def indirection(test: Column, target: Column, callers: Column) -> Column:
    """direct if the test names the target, semi_direct if it names one of its callers, else indirect."""
    called = lambda name: F.rlike(test, F.concat(F.lit(r"\b"), name, F.lit(r"\s*\(")))
    return F.when(called(target), "direct").when(F.exists(callers, called), "semi_direct").otherwise("indirect")


def test_count_rule(text: Column, many: Column) -> Column:
    n = F.regexp_count(text, F.lit(r"(?m)^\s*def test_"))
    return F.when(many, n.between(10, 15)).otherwise(n == 1)


def apply_rules(items: DataFrame, rules: dict[str, Rule], key: str) -> DataFrame:
    """key, kept, failed (rule names in order), reasons: an item is kept if it passes every rule."""
    made = [(name, *rule()) for name, rule in rules.items()]
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(ok, F.lit(False)).alias("ok"), why.alias("why")) for n, ok, why in made])
    failed = F.filter("_rules", lambda r: ~r["ok"])
    return items.withColumn("_rules", each).select(
        key, (F.size(failed) == 0).alias("kept"), F.transform(failed, lambda r: r["rule"]).alias("failed"), F.transform(failed, lambda r: r["why"]).alias("reasons"))


def rule_failures(verdicts: DataFrame) -> DataFrame:
    """rule, failures: how many items each rule excluded."""
    return verdicts.select(F.explode("failed").alias("rule")).groupBy("rule").agg(F.count("*").alias("failures"))


def infrastructure_cause(reason: Column) -> Column:
    """The cause of the first signature found in a reason, else null."""
    low = F.lower(reason)
    out = None
    for text, cause in INFRASTRUCTURE:
        out = F.when(low.contains(text), cause) if out is None else out.when(low.contains(text), cause)
    return out


def _says(text: Column, parts: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = low.contains(parts[0])
    for p in parts[1:]:
        found = found | low.contains(p)
    return found


def refused(message: Column) -> Column:
    """A provider's refusal: quota, access or availability."""
    return _says(message, REFUSALS)


def never_answered(reason: Column) -> Column:
    """No answer was obtained, for any reason: such a verdict says nothing about the instance."""
    return _says(reason, REFUSALS + NO_ANSWER)


def without_answers(files: DataFrame, path: str = "path") -> DataFrame:
    """Files that may be handed out: no oracle answers, no parsers, no reports."""
    return files.where(~F.col(path).rlike(r"(^|/)(oracle[^/]*\.json|parser\.py|answer\.json|difficulty\.json)$"))


def normal_ranges(entries: DataFrame, lengths: DataFrame) -> DataFrame:
    """Ranges (file, start_line, end_line, role, necessity) clipped to their file, with ``dropped`` naming what is wrong."""
    joined = entries.join(lengths, "file", "left")
    dropped = (
        F.when(F.col("n_lines").isNull(), "no such file").when(F.col("start_line").isNull() | (F.col("start_line") < 1), "no start")
        .when(F.col("start_line") > F.col("n_lines"), "beyond the file").when(F.coalesce("end_line", "start_line") < F.col("start_line"), "ends before it starts"))
    return joined.withColumns({
        "dropped": dropped, "end_line": F.least(F.coalesce("end_line", "start_line"), F.col("n_lines")),
        "role": F.coalesce("role", F.lit("logic")), "necessity": F.coalesce("necessity", F.lit("essential"))}).drop("n_lines")


def range_overlaps(entries: DataFrame, by: list[str], key: str) -> DataFrame:
    """Entries that begin within an earlier range of their file."""
    before = Window.partitionBy(*by).orderBy("start_line", key).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("_end", F.max("end_line").over(before)).where(F.col("start_line") <= F.col("_end")).drop("_end")


def unexecuted_runs(entries: DataFrame, executed: DataFrame, by: list[str]) -> DataFrame:
    """Per entry: lines, executed lines and the longest run of unexecuted lines (gaps and islands)."""
    lines = entries.select(*by, "range_id", "start_line", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    marked = lines.join(executed.select(*by, "line").distinct().withColumn("_ran", F.lit(1)), [*by, "line"], "left")
    idle = marked.where("_ran is null").withColumn("_g", F.col("line") - F.row_number().over(Window.partitionBy("range_id").orderBy("line")))
    runs = idle.groupBy("range_id", "_g").agg(F.count("*").alias("n")).groupBy("range_id").agg(F.max("n").alias("longest_idle"))
    counts = marked.groupBy("range_id").agg(F.count("*").alias("lines"), F.count("_ran").alias("executed"))
    return counts.join(runs, "range_id", "left").select("range_id", "lines", "executed", F.coalesce("longest_idle", F.lit(0)).alias("longest_idle"))


def range_warnings(entries: DataFrame, executed: DataFrame, most_idle: int = 15) -> DataFrame:
    """range_id, warning: overlaps an earlier entry, no line executed (but for data and configuration), a long run of lines not executed.

    ``entries``: instance_id, file, range_id (in order), start_line, end_line, role.
    """
    by = ["instance_id", "file"]
    lines = entries.select(*by, "range_id", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    again = lines.withColumn("first", F.min("range_id").over(Window.partitionBy(*by, "line"))).where(F.col("range_id") > F.col("first")).select("range_id").distinct()
    runs = unexecuted_runs(entries, executed, by).join(entries.select("range_id", "role"), "range_id")
    static = F.coalesce(F.lower("role").isin("data", "configuration"), F.lit(False))
    told = runs.withColumn("warning", F.when(F.col("executed") == 0, F.when(~static, "not executed")).when(F.col("longest_idle") >= most_idle, "long idle run"))
    return again.withColumn("warning", F.lit("overlap")).union(told.where("warning is not null").select("range_id", "warning"))


def missed_target_lines(entries: DataFrame, executed: DataFrame) -> DataFrame:
    """instance_id, missed, first_missed: executed lines of the target (instance_id, file, line, depth 0) that are in no entry."""
    covered = entries.select("instance_id", "file", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    target = executed.where("depth = 0").select("instance_id", "file", "line").distinct()
    return target.join(covered, ["instance_id", "file", "line"], "left_anti").groupBy("instance_id").agg(F.count("*").alias("missed"), F.min("line").alias("first_missed"))

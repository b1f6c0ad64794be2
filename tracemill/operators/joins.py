"""Joins of instances, verdicts, files and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def approved(verdicts: DataFrame, family: Column) -> DataFrame:
    """instance_id of instances with a passed verdict of an approved family."""
    return verdicts.where(family & F.col("passed")).select("instance_id").distinct()


def validated(instances: DataFrame, verdicts: DataFrame, family: Column) -> DataFrame:
    return instances.join(approved(verdicts, family), "instance_id", "left_semi")


def unreported(answers: DataFrame, report: DataFrame, keys: list[str]) -> DataFrame:
    """``answers`` with ``interrupted``: answered, but absent from the report."""
    listed = report.select(*keys).distinct().withColumn("_in", F.lit(True))
    return answers.join(listed, keys, "left").withColumn("interrupted", F.col("_in").isNull()).drop("_in")


def path_suffixes(path: Column) -> Column:
    """A path and its tails by whole components."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def suffix_pairs(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, file_a, file_b of files that are equal or where one ends in the other, as equi-joins on tails."""
    left, right = a.select(*by, F.col("file").alias("file_a")).distinct(), b.select(*by, F.col("file").alias("file_b")).distinct()
    one = left.withColumn("file_b", F.explode(path_suffixes(F.col("file_a")))).join(right, [*by, "file_b"])
    two = right.withColumn("file_a", F.explode(path_suffixes(F.col("file_b")))).join(left, [*by, "file_a"])
    names = [*by, "file_a", "file_b"]
    return one.select(*names).union(two.select(*names)).distinct()


def lines_in_ranges(points: DataFrame, ranges: DataFrame, by: list[str], width: int = 32) -> DataFrame:
    """Points (by, line) with the ranges that hold them: ranges are dealt over buckets of ``width`` lines."""
    dealt = ranges.withColumn("_b", F.explode(F.sequence(F.expr(f"start_line div {width}"), F.expr(f"end_line div {width}"))))
    placed = points.withColumn("_b", F.expr(f"line div {width}"))
    return placed.join(dealt, [*by, "_b"]).where(F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("_b")


def backfill(plan: DataFrame, manifest: DataFrame, targets: DataFrame, key: str, on: list[str], columns: list[str]) -> DataFrame:
    """Plan entries, missing columns taken from the targets that the manifest names."""
    named = manifest.select(key, *on).join(targets, on).select(key, *[F.col(c).alias(f"_t_{c}") for c in columns])
    both = plan.join(named, key, "full")
    return both.select(key, *[F.coalesce(c, f"_t_{c}").alias(c) for c in columns])


# Fixed value: what heads the metrics of a target in a prompt.
PROMPT_METRICS = r"Structural metrics of the target \(from static analysis\):\s*\n\s*(\{[^\n]+\})"


def plan_entries(plan: DataFrame, manifest: DataFrame, targets: DataFrame, prompts: DataFrame) -> DataFrame:
    """instance_id, category, file, qualname, metrics, origin: the plan, and what the manifest names besides.

    ``plan``: instance_id, category, file, qualname, metrics; ``manifest``: instance_id,
    category, file, qualname; ``targets``: file, qualname, metrics (JSON; one of each
    target counts); ``prompts``: instance_id, text. An instance without a target takes the
    metrics that its prompt states, {} where they are none or not JSON.
    """
    lacking = manifest.where("instance_id is not null and instance_id <> ''").join(plan.select("instance_id"), "instance_id", "left_anti").dropDuplicates(["instance_id"])
    known = targets.groupBy("file", "qualname").agg(F.max("metrics").alias("known"))
    told = prompts.groupBy("instance_id").agg(F.max("text").alias("text"))
    stated = F.regexp_extract("text", PROMPT_METRICS, 1)
    stated = F.when(F.coalesce(F.try_parse_json(stated).isNotNull(), F.lit(False)), stated).otherwise(F.lit("{}"))
    made = lacking.join(known, ["file", "qualname"], "left").join(told, "instance_id", "left").select(
        "instance_id", "category", "file", "qualname", F.coalesce("known", stated).alias("metrics"), F.when(F.col("known").isNotNull(), "target").otherwise("prompt").alias("origin"))
    return plan.select("instance_id", "category", "file", "qualname", "metrics", F.lit("plan").alias("origin")).unionByName(made)


def caller_hops(edges: DataFrame, cap: int = 6) -> DataFrame:
    """module, func, callers and callers of callers in the module, without the function itself and those seen before."""
    one = edges.where("caller <> callee").select("module", F.col("callee").alias("func"), "caller").distinct()
    up = one.select("module", F.col("func").alias("caller"), F.col("caller").alias("above"))
    two = one.join(up, ["module", "caller"]).where("above <> func").select("module", "func", F.col("above").alias("caller")).distinct()
    two = two.join(one, ["module", "func", "caller"], "left_anti")
    some = lambda d, n: d.groupBy("module", "func").agg(F.slice(F.array_sort(F.collect_set("caller")), 1, cap).alias(n))
    return some(one, "callers").join(some(two, "callers_2hop"), ["module", "func"], "left")


def price_lookup(models: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """model, priced_as, rate columns: by alias, else exactly, else by the longest prefix; candidates also without version tails.

    Prices and aliases are lists that people keep; they are what is sent to all tasks, never the models.
    """
    plain = F.lower("model")
    bare = F.regexp_replace(plain, r"(-\d{8}|-v\d+|:.*)$", "")
    asked = models.select("model").distinct().select("model", F.posexplode(F.array_distinct(F.array(plain, bare))).alias("turn", "name"))
    known = F.broadcast(prices.withColumnRenamed("name", "priced_as"))
    by_alias = asked.join(F.broadcast(aliases), "name").join(known, F.col("target") == F.col("priced_as")).withColumn("rank", F.lit(0))
    exact = asked.join(known, F.col("name") == F.col("priced_as")).withColumn("rank", F.lit(1))
    starts = F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.substring(F.col("name"), F.lit(1), k))
    prefix = asked.withColumn("priced_as", F.explode(starts)).join(known, "priced_as").withColumn("rank", F.lit(2))
    found = by_alias.drop("target").unionByName(exact).unionByName(prefix)
    order = Window.partitionBy("model").orderBy("rank", "turn", F.desc(F.length("priced_as")))
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "turn", "name", "rank")

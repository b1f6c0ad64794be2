"""Grouped reports over scored answers, rollouts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantiles

def grouped_accuracy(results: DataFrame, sets: list[list[str]], correct: Column) -> DataFrame:
    """Total, correct and accuracy over several groupings at once, absent columns null, with ``level`` naming the grouping."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = results.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping_id(*columns).alias("level"), F.count("*").alias("total"), F.count_if(correct).alias("correct"))
    return grouped.withColumn("accuracy", F.col("correct") / F.col("total"))


def score_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Answers, exact rate, mean score, mean and median of the failed, and counts at four thresholds."""
    failed = F.when(~F.col("correct"), F.col("score"))
    at = [F.count_if(F.col("score") >= t).alias(f"at_{int(100 * t)}") for t in (0.5, 0.8, 0.9, 0.95)]
    return scored.groupBy(*by).agg(
        F.count("*").alias("answers"), F.avg(F.col("correct").cast("double")).alias("exact_rate"), F.avg("score").alias("mean_score"),
        F.avg(failed).alias("failed_mean"), F.median(failed).alias("failed_median"), *at)


def label_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by, "label").agg(F.count("*").alias("n"))


def field_summary(fields: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Fields, correct fields, and means of the metrics over the failed fields."""
    failed = F.col("label") != "correct"
    return fields.groupBy(by).agg(F.count("*").alias("fields"), F.count_if(~failed).alias("correct"),
                                  *[F.avg(F.when(failed, F.col(m))).alias(f"failed_{m}") for m in metrics])


# What is averaged over the failed fields of a shape.
FIELD_METRICS = ["key_f1", "value_accuracy", "prefix_ratio", "relative_error", "median_relative_error", "precision", "recall"]


def shape_summary(fields: DataFrame) -> DataFrame:
    """shape, fields, mean_score, labels (label:count, in order), failed_mean_<metric> of the seven metrics over the fields that are not correct.

    ``fields``: shape, label, score and the metrics, null where a shape has none of them.
    """
    failed = F.col("label") != "correct"
    by_label = fields.groupBy("shape", "label").agg(
        F.count("*").alias("n"), F.sum("score").alias("score"), *[F.sum(F.when(failed, F.col(m))).alias(m) for m in FIELD_METRICS], *[F.count(F.when(failed, F.col(m))).alias(f"n_{m}") for m in FIELD_METRICS])
    return by_label.groupBy("shape").agg(
        F.sum("n").alias("fields"), (F.sum("score") / F.sum("n")).alias("mean_score"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "label", F.col("n").cast("string")))), ",").alias("labels"),
        *[(F.sum(m) / F.nullif(F.sum(f"n_{m}"), F.lit(0))).alias(f"failed_mean_{m}") for m in FIELD_METRICS])


def answer_statistics(leaves: DataFrame) -> DataFrame:
    """Per answer: leaves, top-level fields, elements of lists, longest list, depth, characters, digits."""
    path = F.col("path")
    element = r"^([^\[]*)\[(\d+)\]"
    told = leaves.select(
        "answer_id", F.when(path.contains("["), F.regexp_extract("path", element, 1)).alias("list"), F.regexp_extract("path", element, 2).alias("i"),
        F.regexp_extract("path", r"^\$\.([^.\[]+)", 1).alias("field"), F.regexp_count("path", F.lit(r"\.|\[")).alias("depth"),
        F.length("sval").alias("characters"), F.regexp_count("sval", F.lit("[0-9]")).alias("digits"))
    by_list = told.groupBy("answer_id", "list").agg(  # no list is one of them
        F.count("*").alias("leaves"), F.collect_set("field").alias("fields"), F.max("depth").alias("depth"), F.sum("characters").alias("characters"),
        F.sum("digits").alias("digits"), F.when(F.col("list").isNotNull(), F.size(F.collect_set("i"))).cast("long").alias("n"))
    return by_list.groupBy("answer_id").agg(
        F.sum("leaves").alias("leaves"), F.size(F.array_distinct(F.flatten(F.collect_list("fields")))).cast("long").alias("fields"),
        F.max("depth").cast("long").alias("depth"), F.sum("characters").alias("characters"), F.sum("digits").alias("digits"), F.count("list").alias("lists"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("elements"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_list"))


def construction_statistics(values: DataFrame) -> DataFrame:
    """Per answer, over all its levels: leaves, fields of objects, lists, their elements, the longest, depth (the whole: 1), characters of strings, digits of numbers.

    Empty containers are no leaves. The digits are all that a number is written with but minus signs.
    """
    kind = F.col("vtype")
    of = lambda k: F.when(kind == k, F.col("size"))
    total = lambda k: F.coalesce(F.sum(of(k)), F.lit(0))
    return values.groupBy("answer_id").agg(
        F.count_if(~kind.isin("object", "array")).alias("leaves"), total("object").alias("fields"), F.count_if(kind == "array").alias("lists"),
        total("array").alias("elements"), F.coalesce(F.max(of("array")), F.lit(0)).alias("longest_list"), F.max("depth").alias("depth"),
        total("string").alias("characters"), total("number").alias("digits"))


def accuracy_by_label(labelled: DataFrame, outcomes: DataFrame, labels: list[str]) -> DataFrame:
    """scope, label, total, correct, rate; labels without instances are kept with a null rate."""
    scopes = outcomes.select("scope").distinct()
    spine = scopes.select("scope", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    met = labelled.join(outcomes, "instance_id").groupBy("scope", "label").agg(F.count("*").alias("total"), F.count_if("passed").alias("correct"))
    return spine.join(met, ["scope", "label"], "left").select(
        "scope", "label", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct"),
        (F.col("correct") / F.col("total")).alias("rate"))


def label_distribution(labelled: DataFrame, by: str, labels: list[str]) -> DataFrame:
    return labelled.groupBy(by).pivot("label", labels).count().na.fill(0, labels)


def effort_summary(rollouts: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Long form: metric with mean, median, 90th percentile and total; null groups are dropped."""
    long = rollouts.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(*by, "m.*")
    for c in by:
        long = long.where(F.col(c).isNotNull())
    sums = long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.sum("v").alias("total"))
    middle = quantiles(long, [*by, "metric"], "v", {"median": 0.5, "p90": 0.9}).drop("members")
    return sums.join(middle, [*by, "metric"], "left").select(*by, "metric", "mean", "median", "p90", "total")


def activity_histogram(tools: DataFrame) -> DataFrame:
    """tool, uses, rollouts over exploded tool types."""
    return tools.groupBy("tool").agg(F.sum("n").alias("uses"), F.count_distinct("rollout_id").alias("rollouts"))


def instance_means(rollouts: DataFrame, metrics: list[str]) -> DataFrame:
    """Per instance: means over matched rollouts of all models, and rollouts by model as text."""
    by_model = rollouts.groupBy("instance_id", "model").agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in metrics])
    return by_model.groupBy("instance_id").agg(
        F.sum("n").alias("rollouts"), *[(F.sum(m) / F.sum("n")).alias(f"mean_{m}") for m in metrics],
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "model", F.col("n").cast("string")))), ",").alias("by_model"))


def rollout_fold(rollouts: DataFrame) -> DataFrame:
    """Per instance: all passed, passes, all / partial / none, and the reason of the first failure."""
    agg = rollouts.groupBy("instance_id").agg(
        F.bool_and("passed").alias("all_passed"), F.count_if("passed").alias("pass_count"), F.count("*").alias("rollouts"),
        F.min_by("reason", F.when(~F.col("passed"), F.col("rollout"))).alias("first_failure"))
    return agg.withColumn("band", F.when(F.col("pass_count") == F.col("rollouts"), "all").when(F.col("pass_count") > 0, "partial").otherwise("none"))


def run_totals(verdicts: DataFrame, by: list[str]) -> DataFrame:
    return verdicts.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def token_cost(uncached: Column, cached: Column, output: Column, input_rate: Column, cached_rate: Column, output_rate: Column) -> Column:
    """Price of a call by rates for a million tokens."""
    return (uncached * input_rate + cached * cached_rate + output * output_rate) / 1e6


def cached_split(input_tokens: Column, cached_tokens: Column) -> tuple[Column, Column]:
    """(cached, uncached): no more is cached than there is, nothing below zero."""
    cached = F.least(F.greatest(cached_tokens, F.lit(0)), input_tokens)
    return cached, F.greatest(input_tokens - cached, F.lit(0))


def cost_rollup(costs: DataFrame, levels: list[str]) -> DataFrame:
    """Sum of ``cost`` over the levels and their totals; a total with an unknown part is unknown."""
    return costs.rollup(*levels).agg(
        F.grouping_id().alias("level"), F.count("*").alias("calls"), F.count_if(F.col("cost") == 0).alias("free_calls"),
        F.when(F.bool_or(F.col("cost").isNull()), None).otherwise(F.sum("cost")).alias("cost"))


def instance_costs(costs: DataFrame, survivors: DataFrame) -> DataFrame:
    """One row: instances, survivors, total cost, and cost for each generated and each surviving instance."""
    totals = costs.groupBy("instance_id").agg(F.sum("cost").alias("cost"))
    kept = survivors.select("instance_id").distinct().withColumn("kept", F.lit(True))
    return totals.join(kept, "instance_id", "left").agg(
        F.count("*").alias("instances"), F.count("kept").alias("survivors"), F.sum("cost").alias("cost")).select(
        "*", (F.col("cost") / F.col("instances")).alias("per_instance"), (F.col("cost") / F.nullif("survivors", F.lit(0))).alias("per_survivor"))


def required_profile(entries: DataFrame, executed: DataFrame) -> DataFrame:
    """Per instance: entries, lines, share executed, essential and supporting counts. Lines are (file, line)."""
    lines = entries.select("instance_id", "file", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    ran = lines.join(executed.withColumn("ran", F.lit(True)), ["instance_id", "file", "line"], "left").groupBy("instance_id").agg(
        F.count("*").alias("lines"), F.count("ran").alias("ran"))
    counts = entries.groupBy("instance_id").agg(F.count("*").alias("entries"), F.count_if(F.col("necessity") == "essential").alias("essential"),
                                                F.count_if(F.col("necessity") == "supporting").alias("supporting"))
    return counts.join(ran, "instance_id").select("instance_id", "entries", "essential", "supporting", "lines", (F.col("ran") / F.col("lines")).alias("executed_share"))


# Roles of required code, and how it was verified.
ROLES, VERIFIED = ["target", "callee", "data", "configuration", "other"], ["executed", "trace", "read"]


def required_description(entries: DataFrame, executed: DataFrame) -> DataFrame:
    """Per instance how the required code relates to what ran: entries, files, lines, executed lines, roles, verification, reach.

    ``entries``: instance_id, file, start_line, end_line, role, necessity, verified (others
    than the known values count as other, essential and none); ``executed``: instance_id,
    file, line, depth. ``reachable_share``: of the lines executed at or below the target
    (depth of 0 or more), those that some entry requires.
    """
    role = F.when(F.col("role").isin(ROLES), F.col("role")).otherwise("other")
    own = entries.withColumns({"role": role, "essential": ~F.coalesce(F.col("necessity") == "supporting", F.lit(False))})
    counts = own.groupBy("instance_id").agg(
        F.count("*").alias("entries"), F.count_if("essential").alias("essential_entries"), F.count_distinct("file").alias("files"),
        *[F.count_if(F.col("role") == r).alias(f"role_{r}") for r in ROLES], *[F.count_if(F.col("verified") == v).alias(f"verified_{v}") for v in VERIFIED])
    lines = own.select("instance_id", "file", "essential", F.explode(F.sequence("start_line", "end_line")).alias("line")).groupBy("instance_id", "file", "line").agg(F.bool_or("essential").alias("essential"))
    ran = executed.groupBy("instance_id", "file", "line").agg(F.bool_or(F.col("depth") >= 0).alias("reachable"))
    both = lines.withColumn("_q", F.lit(1)).join(ran.withColumn("_x", F.lit(1)), ["instance_id", "file", "line"], "full")
    q, x, near = F.col("_q").isNotNull(), F.col("_x").isNotNull(), F.coalesce("reachable", F.lit(False))
    sums = both.groupBy("instance_id").agg(
        F.count_if(q).alias("lines"), F.count_if(q & F.col("essential")).alias("essential_lines"), F.count_if(q & x).alias("executed_lines"),
        (F.count_if(q & near) / F.nullif(F.count_if(near), F.lit(0))).alias("reachable_share"))
    return counts.join(sums, "instance_id")


def required_corpus(described: DataFrame) -> DataFrame:
    """One row: analysed instances, upper median of their lines, mean of the reachable share (nulls skipped)."""
    counted = described.groupBy("lines").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.orderBy("lines").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # as many rows as there are lengths
    middle = counted.withColumns({"c": up_to, "t": F.sum("n").over(Window.partitionBy())}).where("c > floor(t / 2)").agg(F.min("lines").alias("median_lines"))
    return described.agg(F.count("*").alias("analysed"), F.avg("reachable_share").alias("mean_reachable_share")).join(middle, how="left").select("analysed", "median_lines", "mean_reachable_share")


def tier_costs(costs: DataFrame) -> DataFrame:
    """tier, instances, rollouts, zero_cost_rollouts, cost, per_instance, per_rollout, and a row for all tiers (null tier); an unknown cost is none."""
    paid = costs.select("tier", "instance_id", F.coalesce("cost", F.lit(0.0)).alias("cost"))
    by_instance = paid.groupBy("tier", "instance_id").agg(F.count("*").alias("rollouts"), F.count_if(F.col("cost") == 0).alias("zero"), F.sum("cost").alias("cost"))
    rolled = by_instance.rollup("tier").agg(F.count("*").alias("instances"), F.sum("rollouts").alias("rollouts"), F.sum("zero").alias("zero_cost_rollouts"), F.sum("cost").alias("cost"))
    return rolled.withColumns({"per_instance": F.col("cost") / F.col("instances"), "per_rollout": F.col("cost") / F.col("rollouts")})


def pipeline_costs(generation: DataFrame, validation: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: generated, kept, both costs and their sum, for each generated and each surviving instance. (instance_id, cost) each."""
    g = generation.agg(F.count_distinct("instance_id").alias("generated"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("generation_cost"))
    v, k = validation.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("validation_cost")), kept.agg(F.count_distinct("instance_id").alias("kept"))
    total = F.col("generation_cost") + F.col("validation_cost")
    return g.join(v, how="left").join(k, how="left").select(  # one row each
        "*", total.alias("cost"), (total / F.nullif("generated", F.lit(0))).alias("per_generated"), (total / F.nullif("kept", F.lit(0))).alias("per_survivor"))


def verified_report(records: DataFrame, difficulties: list[str], named: Column) -> DataFrame:
    """variant, scope, name, total, answer_files, missing_answer_files, correct, incorrect, accuracy.

    ``records``: instance_id, repository, category, verified, answered, correct (null is
    wrong), and a column of labels for each of ``difficulties``. The strict variant holds verified
    instances, overall, by repository, category and label; the sensitivity variant adds
    ``named`` unverified ones without an answer as wrong, overall and by label.
    """
    right = F.coalesce(F.col("correct") & F.col("answered"), F.lit(False))
    strict, extra = F.col("verified"), ~F.col("verified") & named & ~F.col("answered")
    labels = [F.struct(F.lit(f"difficulty {d}").alias("scope"), F.coalesce(F.col(d), F.lit("unknown")).alias("name")) for d in difficulties]
    whole = F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("name"))
    scopes = F.array(whole, F.struct(F.lit("repository").alias("scope"), F.col("repository").alias("name")), F.struct(F.lit("category").alias("scope"), F.col("category").alias("name")), *labels)
    rows = records.where(strict).select(F.lit("strict").alias("variant"), F.explode(scopes).alias("s"), "answered", right.alias("ok"))
    more = records.where(strict | extra).select(F.lit("sensitivity").alias("variant"), F.explode(F.array(whole, *labels)).alias("s"), "answered", right.alias("ok"))
    agg = rows.unionByName(more).groupBy("variant", "s.scope", "s.name").agg(F.count("*").alias("total"), F.count_if("answered").alias("answer_files"), F.count_if("ok").alias("correct"))
    return agg.select("variant", "scope", "name", "total", "answer_files", (F.col("total") - F.col("answer_files")).alias("missing_answer_files"), "correct",
                      (F.col("total") - F.col("correct")).alias("incorrect"), (F.col("correct") / F.col("total")).alias("accuracy"))


def verified_with_unanswered(verified: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy over verified instances; one without an answer counts as wrong."""
    return verified.join(answers, "instance_id", "left").withColumn("ok", F.coalesce("correct", F.lit(False))).groupBy(*by).agg(
        F.count("*").alias("verified"), F.count("correct").alias("answered"), F.count_if("ok").alias("right"), F.avg(F.col("ok").cast("double")).alias("accuracy"))


def distinct_values(elements: DataFrame, cited: DataFrame) -> DataFrame:
    """Per answer, the distinct named values of its elements united with those cited in its question."""
    return elements.select("answer_id", "token").union(cited.select("answer_id", "token")).distinct().groupBy("answer_id").agg(F.count("*").alias("n_values"))


def first_by(order: list[Column], *partition: str) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))

"""Quantile labels, percentile ranks and ranked selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dealt import dealt
from ..sources.shared import written
from .prefix import row_numbers, running_total

LEVELS = ["easy", "medium", "hard", "very_hard"]


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``by``, ``members`` and a column for each of ``at``: exact quantiles with linear interpolation.

    Values are counted, and the counts summed over ranges of (by, value); of these, only
    the two neighbours of each place are kept. No group's values meet in one buffer or
    task, and all groups and quantiles take the same two passes. Null values do not
    count; a group without others has no row. Nulls in ``by`` are a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = written(running_total(counts, by, [F.asc("_v")], F.col("_n"), "_below"), "values")
    totals = placed.groupBy(*by).agg(F.sum("_n").alias("members")).select(*[F.col(c).alias(f"_by_{c}") for c in by], "members")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.lit(True))
    found = placed.join(totals, same) if by else placed.crossJoin(F.broadcast(totals))  # one row
    place = {name: (F.col("members") - 1) * F.lit(float(p)) for name, p in at.items()}
    holds = lambda i: (F.col("_below") <= i) & (i < F.col("_below") + F.col("_n"))
    ends = {f"_{k}_{name}": F.max(F.when(holds(f(h)), F.col("_v").cast("double"))) for name, h in place.items() for k, f in (("lo", F.floor), ("hi", F.ceil))}
    kept = found.where(reduce(lambda a, b: a | b, [holds(f(h)) for h in place.values() for f in (F.floor, F.ceil)]))
    picked = kept.groupBy(*by).agg(F.max("members").alias("members"), *[c.alias(n) for n, c in ends.items()])
    mixed = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (h - F.floor(h))).alias(n) for n, h in place.items()]
    return picked.select(*by, "members", *mixed)


def cutoffs(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """q25, q50, q75 (linear interpolation) and members of each stratum."""
    return quantiles(scores, by, score, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).select(*by, "q25", "q50", "q75", "members")


def level_label(score: Column, q25: Column, q50: Column, q75: Column, members: Column | None = None) -> Column:
    """Ties fall to the easier label; a single member is medium."""
    label = F.when(score <= q25, "easy").when(score <= q50, "medium").when(score >= q75, "very_hard").otherwise("hard")
    return label if members is None else F.when(members == 1, "medium").otherwise(label)


def quantile_labels(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """``scores`` with ``label``; the cutoffs are joined back, one row for each stratum."""
    cuts = cutoffs(scores, by, score)
    joined = scores.join(cuts, by) if by else scores.crossJoin(F.broadcast(cuts))  # one row
    return joined.withColumn("label", level_label(F.col(score), F.col("q25"), F.col("q50"), F.col("q75"), F.col("members"))).drop("q25", "q50", "q75", "members")


def frozen_labels(scores: DataFrame, thresholds: DataFrame, by: str, unknown: str = "medium", score: str = "score") -> DataFrame:
    """Labels under given (by, q25, q50, q75); a stratum without thresholds gets ``unknown``."""
    joined = scores.join(thresholds, by, "left")
    label = F.when(F.col("q25").isNull(), unknown).otherwise(level_label(F.col(score), F.col("q25"), F.col("q50"), F.col("q75")))
    return joined.withColumn("label", label).drop("q25", "q50", "q75")


def percentile_ranks(rows: DataFrame, by: list[str], value: str, name: str = "rank10") -> DataFrame:
    """Tie-averaged percentile rank from 0 to 10 within ``by``; 5 for a single row.

    Values are counted first: the running sum goes over distinct values only, so a
    group of any size sends no more rows than it has values.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(order), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*by))
    rank = F.when(total == 1, 5.0).otherwise(10.0 * (below + (F.col("_n") - 1) / 2) / (total - 1))
    return rows.join(counts.withColumn(name, rank).drop("_n"), [*by, value])


#: A value that as large a part of all rows has is a frequent one.
FREQUENT = 10_000


def weighted_effort(rows: DataFrame, by: str, weights: dict[str, float], key: str) -> DataFrame:
    """key, by, effort: weighted sum of the percentile ranks of the components, all to three digits.

    A row with a null component has none. Values are counted and ranked over ranges. The
    ranks of frequent values, of which a component has no more than ``FREQUENT``, are broadcast;
    only the others are joined, and none of these is so frequent that it fills a task.
    """
    names = list(weights)
    base = written(rows.where(F.col(by).isNotNull()).select(key, by, *[F.col(m).cast("double").alias(m) for m in names]), "components")
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"), F.lit(str(w)).cast("decimal(5,4)").alias("w")) for m, w in weights.items()])).alias("_m")
    counts = base.select(by, long).groupBy(by, "_m.metric", "_m.v", "_m.w").agg(F.count("*").alias("_n"))
    placed = written(running_total(counts, [by, "metric"], [F.asc("v")], F.col("_n"), "_below"), "values")
    totals = placed.groupBy(by, "metric").agg(F.sum("_n").alias("_total"))
    rank = F.when(F.col("_total") == 1, 5.0).otherwise(10.0 * (F.col("_below") + (F.col("_n") - 1) / 2) / (F.col("_total") - 1))
    exact = F.round(rank, 3).cast("decimal(9,3)") * F.col("w")  # so that halves round alike
    ranked = written(placed.join(totals, [by, "metric"]).select(by, "metric", "v", "_n", exact.cast("decimal(20,7)").alias("_part")), "ranks")
    frequent = F.col("_n") * FREQUENT >= base.count()
    told = base
    for k, m in enumerate(names):
        own = ranked.where(frequent & (F.col("metric") == m)).select(by, F.col("v").alias(m), F.col("_part").alias(f"_part_{k}"))
        told = told.join(F.broadcast(own), [by, m], "left")
    parts = [F.col(f"_part_{k}") for k in range(len(names))]
    none = F.lit(0).cast("decimal(20,7)")
    of_frequent = told.select(key, by, reduce(lambda x, y: x + y, [F.coalesce(c, none) for c in parts]).cast("decimal(20,7)").alias("_part"),
                              reduce(lambda x, y: x + y, [c.isNotNull().cast("long") for c in parts]).alias("_found"))
    left = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(c.isNull(), F.col(m)).alias("v")) for m, c in zip(names, parts)])).alias("_m")
    others = dealt(told.select(key, by, left).where("_m.v is not null").select(key, by, "_m.*"), by, "metric", "v", counted=base)
    of_others = others.join(ranked.where(~frequent), [by, "metric", "v"]).select(key, by, "_part", F.lit(1).cast("long").alias("_found"))
    summed = dealt(of_frequent.union(of_others), key, counted=base).groupBy(key, by).agg(F.sum("_part").alias("effort"), F.sum("_found").alias("_found"))
    return written(summed.where(F.col("_found") == len(names)).select(key, by, F.round("effort", 3).cast("double").alias("effort")), "efforts")


def relabel_by_outcome(rows: DataFrame, by: str, outcome: str, key: str, label: str = "label") -> DataFrame:
    """Labels by rank of the outcome (best first, then key), with as many of each label as before.

    Ranks come from ranges of (by, outcome, key), so one group of any size is dealt over all tasks.
    """
    sizes = rows.groupBy(by, label).agg(F.count("*").alias("_n")).withColumn("_l", F.array_position(F.array(*map(F.lit, LEVELS)), F.col(label)))
    up_to = Window.partitionBy(by).orderBy("_l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = sizes.withColumn("_to", F.sum("_n").over(up_to)).select(F.col(by).alias("_of"), F.col(label).alias("outcome_label"), (F.col("_to") - F.col("_n")).alias("_from"), "_to")
    ranked = row_numbers(rows, [by], [F.desc(outcome), F.asc(key)], "_r")
    found = ranked.join(spans, F.col(by).eqNullSafe(F.col("_of")) & (F.col("_r") > F.col("_from")) & (F.col("_r") <= F.col("_to")))
    return found.drop("_r", "_from", "_to", "_of")


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """scope, instance_id, passed of the last run."""
    return verdicts.groupBy("scope", "instance_id").agg(F.max_by("passed", "run_pos").alias("passed"))


def sample_first(rows: DataFrame, by: str, key: str, n: int, cap: int | None = None) -> DataFrame:
    """The first ``n`` of each group by key, and of these no more than ``cap`` in all."""
    kept = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("_r") <= n)
    return (kept if cap is None else kept.orderBy("_r", by, key).limit(cap)).drop("_r")


def capped_candidates(rows: DataFrame, caps: list[tuple[list[str], int]], score: str, key: str) -> DataFrame:
    """The best by score, with at most so many in each group; the caps apply in turn.

    Spark cuts each group to its cap within the tasks, before the shuffle, so that a
    group of any size sends a cap's rows from each task; a cap on all rows is a top-k.
    """
    for k, (columns, n) in enumerate(caps):
        if k and not columns:
            return rows.orderBy(F.desc(score), key).limit(n)
        order = Window.partitionBy(*columns).orderBy(F.desc(score), key)
        rows = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
    return rows


def quota_split(groups: DataFrame, total: int, size: str = "n", key: str = "category") -> DataFrame:
    """``quota``: an equal share each, and one more for the largest groups until ``total`` is dealt. As many rows as categories."""
    count = groups.agg(F.count("*").alias("_k"))
    ranked = groups.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(size), key)))
    return ranked.crossJoin(F.broadcast(count)).withColumn("quota", F.expr(f"{total} div _k") + F.when(F.col("_r") <= total % F.col("_k"), 1).otherwise(0)).drop("_r", "_k")


def share_slots(quotas: DataFrame, share: float, quota: str = "quota", key: str = "category") -> DataFrame:
    """``slots`` of each quota: floors of the share, and one more for the largest remainders until the share of all quotas is dealt.

    Ties go to the larger quota, then by key; no quota gets more slots than it has. As many rows as categories.
    """
    part = F.col(quota).cast("decimal(18,0)") * F.lit(str(share)).cast("decimal(9,6)")  # exact, as remainders are compared
    exact = quotas.withColumn("_x", part).withColumn("_f", F.floor("_x").cast("long"))
    left = F.bround(F.sum("_x").over(Window.partitionBy()), 0).cast("long") - F.sum("_f").over(Window.partitionBy())
    order = Window.orderBy(F.desc(F.col("_x") - F.col("_f")), F.desc(quota), key)
    return exact.withColumns({"_left": left, "_r": F.row_number().over(order)}).withColumn(
        "slots", F.least(F.col("_f") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0), F.col(quota)).cast("long")).drop("_x", "_f", "_left", "_r")


# Whether a function suits a category of questions, and how well, by its metrics.
CATEGORIES = {
    "S1_IntraProceduralCFG": ("branches >= 2", "2 * branches + boolops + returns"),
    "S2_Loops": ("loops >= 1", "2 * loops + 2 * while_loops + 3 * max_loop_nesting + breaks_continues"),
    "S3_ProgramState": ("assigns + augassigns >= 4", "assigns + 2 * augassigns + branches"),
    "S4_DataFlow": ("assigns >= 3 AND branches >= 1", "assigns + 2 * branches + loops"),
    "S5_Exceptions": ("raises + excepts >= 1", "2 * raises + 2 * excepts + 3 * finallys + branches"),
    "S6_InterProceduralCFG": ("num_local_calls >= 1", "3 * num_local_calls + branches"),
    "M1_IntraProceduralCFG": ("branches >= 4", "2 * branches + 2 * boolops + returns + body_lines / 10"),
    "M2_Loops": ("loops >= 2 OR max_loop_nesting >= 2", "2 * loops + 4 * max_loop_nesting + 2 * breaks_continues"),
    "M3_ProgramState": ("assigns + augassigns >= 6", "assigns + 2 * augassigns + 2 * branches + loops"),
    "M4_DataFlow": ("assigns >= 5 AND branches >= 2", "2 * assigns + 2 * branches + 2 * loops"),
    "M5_Exceptions": ("raises + excepts >= 2", "2 * raises + 3 * excepts + 3 * finallys + num_local_calls"),
    "M6_InterProceduralCFG": ("num_local_calls >= 2", "4 * num_local_calls + branches + excepts"),
    "M7_Invariants": ("loops >= 1 AND assigns + augassigns >= 3", "2 * loops + 3 * augassigns + assigns + 2 * max_loop_nesting"),
}


def category_rules() -> dict[str, tuple[Column, Column]]:
    return {name: (F.expr(cond), F.expr(affinity)) for name, (cond, affinity) in CATEGORIES.items()}


def eligibility(rows: DataFrame, rules: dict[str, tuple[Column, Column]], key: str) -> DataFrame:
    """key, category, affinity of every category whose condition holds."""
    each = F.array(*[F.struct(F.lit(n).alias("category"), cond.alias("ok"), aff.cast("double").alias("affinity")) for n, (cond, aff) in rules.items()])
    return rows.select(key, F.explode(each).alias("r")).where("r.ok").select(key, "r.category", "r.affinity")


#: Fixed order: what makes one attempt better than another, the first first; all descending.
ATTEMPT_ORDER = ["flipped", "target_met", "increased", "delta", "oracle_and_trace_changed", "oracle_changed", "trace_changed", "new_lines_and_edges", "new_edges"]


def best_attempts(attempts: DataFrame, source: str, key: str) -> DataFrame:
    """The best attempt of each source by the nine parts of ``ATTEMPT_ORDER``; ties by key.

    Columns: flipped, target_met, increased, oracle_changed, trace_changed (boolean, null is
    false), delta (null is 0), new_lines, new_edges. A top one of each source, cut in the tasks.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    parts = {
        "flipped": yes("flipped"), "target_met": yes("target_met"), "increased": yes("increased"), "delta": F.coalesce("delta", F.lit(0.0)),
        "oracle_and_trace_changed": yes("oracle_changed") & yes("trace_changed"), "oracle_changed": yes("oracle_changed"), "trace_changed": yes("trace_changed"),
        "new_lines_and_edges": F.col("new_lines") + F.col("new_edges"), "new_edges": F.col("new_edges"),
    }
    order = [F.desc(parts[p]) for p in ATTEMPT_ORDER]
    return attempts.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(*order, F.asc(key)))).where("_r = 1").drop("_r")

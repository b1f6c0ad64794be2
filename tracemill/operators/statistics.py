"""Agreement, correlation and the calibration of difficulty scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .ranking import LEVELS


def set_agreement(a: DataFrame, b: DataFrame, by: list[str], keys: list[str], least: float = 0.95) -> DataFrame:
    """Jaccard similarity of two sets of keys for each group, flagged below ``least``."""
    one = a.select(*by, *keys).distinct().withColumn("_a", F.lit(1))
    two = b.select(*by, *keys).distinct().withColumn("_b", F.lit(1))
    both = one.join(two, [*by, *keys], "full").groupBy(*by).agg(F.count("*").alias("union"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"))
    return both.withColumn("jaccard", F.col("common") / F.col("union")).withColumn("flagged", F.col("jaccard") < least)


def average_ranks(rows: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Tie-averaged ranks; the running sum goes over distinct values, dealt by ``by``."""
    by = by or []
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn(name, F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    return rows.join(ranked, [*by, value])


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(rows.select(*by, x, y), x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def confusion(rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _place(c: str) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), F.col(c))


def agreement(rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: n, exact, within_one, chance and quadratic-weighted kappa of two labellings."""
    cells = confusion(rows, a, b).withColumns({"i": _place("a"), "j": _place("b")})  # at most 16 rows
    total = F.sum("n").over(Window.partitionBy())
    row, col = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    d = F.col("i") - F.col("j")
    spread = cells.withColumns({"t": total, "ra": row, "cb": col})
    margin_a = spread.select("i", "ra", "t").distinct()
    margin_b = spread.select("j", "cb").distinct()
    expected = margin_a.crossJoin(margin_b).select(
        F.sum(F.when(F.col("i") == F.col("j"), F.col("ra") * F.col("cb") / F.col("t") / F.col("t")).otherwise(0)).over(Window.partitionBy()).alias("chance"),
        F.sum((F.col("i") - F.col("j")) ** 2 * F.col("ra") * F.col("cb") / F.col("t")).over(Window.partitionBy()).alias("we")).limit(1)
    seen = spread.agg(F.sum("n").alias("n"), F.sum(F.when(d == 0, F.col("n")).otherwise(0)).alias("same"),
                      F.sum(F.when(F.abs(d) <= 1, F.col("n")).otherwise(0)).alias("near"), F.sum(d ** 2 * F.col("n")).alias("wo"))
    return seen.crossJoin(expected).select("n", (F.col("same") / F.col("n")).alias("exact"), (F.col("near") / F.col("n")).alias("within_one"), "chance",
                                           (1 - F.col("wo") / F.col("we")).alias("kappa"))


def outcome_by_label(labelled: DataFrame, models: DataFrame, scores: DataFrame) -> DataFrame:
    """model, label, exact rate and mean score; unanswered instances count zero."""
    spine = labelled.crossJoin(F.broadcast(models.select("model").distinct()))  # models are few
    joined = spine.join(scores, ["instance_id", "model"], "left")
    return joined.groupBy("model", "label").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("passed").cast("double"), F.lit(0.0))).alias("exact_rate"),
                                                F.avg(F.coalesce("partial", F.lit(0.0))).alias("mean_score"))


def saturating(x: Column, scale: float) -> Column:
    """From 0 towards 10 as x grows over the scale."""
    return F.least(F.greatest(10 * (1 - F.exp(-x / scale)), F.lit(0.0)), F.lit(10.0))


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    return F.least(F.greatest(sum((c * w for c, w in parts), F.lit(0.0)), F.lit(0.0)), F.lit(10.0))


def _three_digits(x: Column) -> Column:
    """To three digits by the binary value, and exact halves to even, as Python rounds; from 0 to 10."""
    cut, high = F.floor(x * 1000), x.cast("float").cast("double")
    over = (high * 1000 - cut) + (x - high) * 1000  # exact: the products of so few bits are
    return (cut + F.when((over > 0.5) | ((over == 0.5) & (cut % 2 == 1)), 1).otherwise(0)) / 1000


def answer_score(leaves: Column, ordered: Column, depth: Column, characters: Column, digits: Column) -> Column:
    """Effort of writing an answer: mean of volume, order, structure and exact values, each of three digits, to three digits.

    Every fourth mean is a half, so they are summed without loss, in units of 2 ** -57, and rounded by the binary value.
    """
    parts = [saturating(leaves, 35.0), saturating(ordered, 30.0), saturating(F.greatest(depth - 1, F.lit(0)), 3.0), saturating(characters + digits, 180.0)]
    exact = [(to_ten(p) * 2.0 ** 57).cast("long") for p in parts]
    return _three_digits(sum(exact[1:], exact[0]).cast("double") / (2.0 ** 57 * len(parts)))


def combined_score(semantic: Column, answer: Column, navigation: Column, weights: tuple[float, float, float] = (0.40, 0.35, 0.25)) -> Column:
    return semantic * weights[0] + answer * weights[1] + navigation * weights[2]


def to_ten(x: Column) -> Column:
    """Kept between 0 and 10, to three digits."""
    return F.round(F.greatest(F.lit(0), F.least(F.lit(10), x)), 3)


def _grown(x: Column, scale: float) -> Column:
    return 10 * (1 - F.exp(-F.greatest(x, F.lit(0)) / scale))


def _mixed(*parts: tuple[float, Column]) -> Column:
    return sum((c * w for w, c in parts[1:]), parts[0][1] * parts[0][0])


def mixed_scores(*parts: tuple[float, Column]) -> Column:
    """Weighted sum of scores of three digits, summed exactly so that halves round alike everywhere."""
    exact = [c.cast("decimal(9,3)") * F.lit(str(w)).cast("decimal(5,4)") for w, c in parts]
    return to_ten(sum(exact[1:], exact[0])).cast("double")


def semantic_components() -> dict[str, Column]:
    """What makes a target hard to reason about: its text, and more so what was executed, by kind of difficulty.

    Columns are the metrics of the function and of its trace.
    """
    n = F.col
    static = {
        "control_flow": (n("branches") + n("boolops") + 2 * n("loops") + 2 * n("max_loop_nesting") + n("breaks_continues"), 12),
        "state_tracking": (n("assigns") + 2 * n("augassigns") + 2 * n("comprehensions"), 15),
        "interprocedural": (n("calls") + 2 * n("num_local_calls"), 14),
        "exception_semantics": (2 * n("excepts") + n("raises") + 2 * n("finallys"), 5),
    }
    dynamic = {
        "control_flow": [(0.55, "distinct_line_transitions", 75), (0.45, "dynamic_branch_alternatives", 8)],
        "state_tracking": [(1.0, "state_change_events", 800)],
        "interprocedural": [(0.45, "call_events", 500), (0.30, "distinct_functions", 5), (0.25, "max_call_depth", 10)],
        "exception_semantics": [(1.0, "exception_events", 20)],
        "execution_workload": [(0.45, "line_events", 3000), (0.25, "max_line_repetition", 800), (0.20, "distinct_lines", 70), (0.10, "call_events", 500)],
    }
    text_share = {"control_flow": 0.35, "state_tracking": 0.30, "interprocedural": 0.35, "exception_semantics": 0.35}
    run = {k: to_ten(_mixed(*((w, _grown(n(c), scale)) for w, c, scale in parts))) for k, parts in dynamic.items()}
    out = {k: mixed_scores((share, to_ten(_grown(*static[k]))), (round(1 - share, 2), run[k])) for k, share in text_share.items()}
    return out | {"execution_workload": run["execution_workload"]}


def semantic_score(c: dict[str, Column]) -> Column:
    return mixed_scores((0.20, c["control_flow"]), (0.20, c["state_tracking"]), (0.15, c["interprocedural"]), (0.05, c["exception_semantics"]), (0.40, c["execution_workload"]))


def navigation_score() -> Column:
    """How hard the code is to find: clues and a direct entry lower it, the executed lines raise it.

    Columns: exercise_mode, relevant_files, relevant_functions, imports, test_calls,
    source_lines, callers, distinct_lines.
    """
    n = F.col
    entry = F.when(n("exercise_mode") == "direct", 1.5).when(n("exercise_mode") == "indirect", 7.0).otherwise(4.0)
    support = mixed_scores(
        (0.35, entry), (0.20, to_ten(_grown(n("relevant_files") - 1, 2.5))), (0.20, to_ten(_grown(n("relevant_functions") - 1, 6))),
        (0.15, to_ten(_grown(n("imports") + n("test_calls") / 8 + n("source_lines") / 40, 8))), (0.10, to_ten(_grown(n("callers"), 5))))
    return mixed_scores((0.70, 10.0 - support), (0.30, to_ten(_grown(n("distinct_lines"), 75))))


def design(rows: DataFrame, features: list[str], group: str, target: str, fold: str) -> tuple[DataFrame, list[str], dict]:
    """Standardised log1p features and one-hot groups (columns d0..), with the scaling used. Groups are few."""
    logs = rows.select(fold, F.col(target).alias("y"), F.col(group).alias("_g"), *[F.log1p(F.greatest(F.col(f), F.lit(0))).alias(f) for f in features])
    stat = logs.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features], F.array_sort(F.collect_set("_g")).alias("groups")).first()
    scale = {f: (stat[f"m_{f}"], stat[f"s_{f}"] or 1.0) for f in features}
    columns = [((F.col(f) - scale[f][0]) / scale[f][1]) for f in features] + [(F.col("_g") == g).cast("double") for g in stat["groups"]]
    names = [f"d{i}" for i in range(len(columns))]
    return logs.select(fold, "y", *[c.alias(n) for c, n in zip(columns, names)]), names, {"scale": scale, "groups": list(stat["groups"])}


def gram_sums(matrix: DataFrame, names: list[str], fold: str) -> dict:
    """Per fold, the sums of products of the columns, an intercept and the target: one pass, one small row each."""
    terms = [F.lit(1.0), *map(F.col, names), F.col("y")]
    k = len(terms)
    sums = [F.sum(terms[i] * terms[j]) for i in range(k) for j in range(i, k)]
    out = {}
    for row in matrix.groupBy(fold).agg(*sums).collect():
        gram = np.zeros((k, k))
        gram[np.triu_indices(k)] = row[1:]
        out[row[0]] = gram + np.triu(gram, 1).T
    return out


def ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and weights from the sums of products; the intercept is free."""
    a, b = gram[:-1, :-1].copy(), gram[:-1, -1]
    a[np.arange(1, len(a)), np.arange(1, len(a))] += alpha
    return np.linalg.lstsq(a, b, rcond=None)[0]


def ridge_fit(rows: DataFrame, features: list[str], group: str, target: str, alpha: float) -> DataFrame:
    """term, weight of a ridge fit over all rows: intercept, features, groups."""
    matrix, names, made = design(rows.withColumn("_all", F.lit(1)), features, group, target, "_all")
    weights = ridge(sum(gram_sums(matrix, names, "_all").values()), alpha)
    terms = ["intercept", *features, *[f"{group}={g}" for g in made["groups"]]]
    return rows.sparkSession.createDataFrame(list(zip(terms, map(float, weights))), "term string, weight double")


def fold_fits(matrix: DataFrame, names: list[str], fold: str, alphas: list[float], salts: int = 64) -> DataFrame:
    """fold, alpha, w: ridge weights fitted on all rows but those of the fold.

    The sums of products of each fold are one row of a table; those of all folds (one
    row, whose size the columns bound) are joined to it, and each task subtracts and
    solves for its folds. No fold passes through the driver.
    """
    terms = [F.lit(1.0), *map(F.col, names), F.col("y")]
    k = len(terms)
    sums = F.array(*[F.sum(terms[i] * terms[j]) for i in range(k) for j in range(i, k)])
    own = written(matrix.groupBy(F.col(fold).alias("fold")).agg(sums.alias("g")), "grams")
    whole = own.agg(F.array(*[F.sum(F.get("g", i)) for i in range(k * (k + 1) // 2)]).alias("t"))
    upper = np.triu_indices(k)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, g, t in zip(pdf["fold"], pdf["g"], pdf["t"]):
                gram = np.zeros((k, k))
                gram[upper] = np.asarray(t) - np.asarray(g)
                gram += np.triu(gram, 1).T
                rows += [(f, float(a), ridge(gram, a).tolist()) for a in alphas]
            yield pd.DataFrame(rows, columns=["fold", "alpha", "w"])

    schema = T.StructType([own.schema["fold"], T.StructField("alpha", T.DoubleType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    dealt = own.repartition(salts, "fold").crossJoin(F.broadcast(whole))  # one row
    return dealt.mapInPandas(solve, schema)


def choose_alpha(rows: DataFrame, features: list[str], group: str, target: str, fold: str, alphas: list[float]) -> DataFrame:
    """alpha, rho: rank correlation of predictions for each left-out fold's rows, fitted on the others. A null fold is a fold."""
    matrix, names, _ = design(rows, features, group, target, fold)
    weights = fold_fits(matrix, names, fold, alphas)
    joined = matrix.join(weights, matrix[fold].eqNullSafe(weights["fold"]))
    predicted = joined.withColumn("p", F.get("w", 0) + sum((F.get("w", i + 1) * F.col(n) for i, n in enumerate(names)), F.lit(0.0)))
    return spearman(predicted.select("alpha", F.round("p", 9).alias("p"), "y"), "p", "y", ["alpha"])


def calibrated(features: dict[str, tuple[float, float, float]], intercept: float, offset: Column) -> Column:
    """Ten times one less the predicted success: name -> (mean, deviation, weight), offset of the group (0 if unknown)."""
    z = sum((F.lit(w) * ((F.log1p(F.col(n)) - m) / s) for n, (m, s, w) in features.items()), F.lit(intercept))
    return 10 * (1 - (z + F.coalesce(offset, F.lit(0.0))))

"""Mixing sources to target weights, DataFrame functions only.

Sources are the leaves of a domain-language-source tree. The token budget goes
down the tree by the children's weights. A child can not take more than its
documents hold in ``max_epochs`` passes; what it lacks goes to its siblings by
their weights, and only what the siblings can not take either goes to the
siblings of the parent (as the parent's capacity is the sum of its children's,
the parent never asks for more than they can take together).

Each leaf is then read in seeded epochs: in every epoch its documents have an own
order, by a digest of seed, epoch and id. The leaf's budget is a prefix of the
tokens of these epochs in turn. Whole epochs need no order; in the last one the
documents are dealt over ranges of the digest, twice in turn, and only the range in
which the budget ends is sorted.

Neither many sources under one parent nor a leaf with a third of all rows needs a
large group: siblings are taken together by their capacity for each unit of weight
first, and only the band in which the budget ends is looked at one by one.

Defined results: null domains, languages and sources are leaves of their own; a
null text has no tokens; documents without tokens come with the epochs that hold
their place; rows of equal digest follow their id and text hash; weights that are
not listed are 1, of those listed twice the largest counts, fractions count to the
sixth digit, a weight of zero gives nothing, a negative one is an error; budgets
are rounded down to whole tokens at each node, so up to one token for each child
may stay unspent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, require, text_of, written

LEVELS = ("domain", "lang", "source")
_KEY_BITS, _DIGIT_BITS, _DIGITS = 48, 12, 2
_WEIGHT_UNIT = 1_000_000
#: Bands of siblings for each doubling of their capacity for a unit of weight.
_BANDS = 64


def word_tokens(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def _null_safe(a: str, b: str, names: tuple[str, ...]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return cond


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def fill(children: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """Budgets of the children of each parent by weights under capacities.

    ``children`` has the parent's columns, ``budget`` (of the parent), ``name``,
    ``weight`` and ``capacity``. In order of capacity for each unit of weight, a
    child is full as long as its capacity is within its share of what is left; the
    others share the rest by weight, rounded down. Bands of that order are summed up
    first: all children of the bands before the one that is not wholly full are full.
    """
    ratio = F.col("capacity") / F.col("weight")
    rows = children.withColumn("_band", F.floor(F.log2(ratio.cast("double")) * _BANDS))
    bands = rows.groupBy(*parent, "_band").agg(
        F.first("budget").alias("budget"), F.sum("capacity").alias("_sum"), F.sum("weight").alias("_own"),
        F.max(F.struct(ratio.alias("r"), F.col(name).alias("n"), "capacity", "weight")).alias("_top"))
    order = Window.partitionBy(*parent).orderBy("_band")
    bands = bands.withColumns({
        "_before": F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum"),
        "_onward": F.sum("_own").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    not_full = _wide("_top.capacity") * (_wide("_onward") - _wide("_own")) > _wide("_top.weight") * (_wide("budget") - _wide("_before") - _wide("_sum"))
    border = bands.where(not_full).groupBy(*parent).agg(F.min(F.struct("_band", "_before", "_onward")).alias("b")).select(*parent, "b.*")
    # one by one within the border band
    inside = rows.alias("c").join(border.alias("b"), _null_safe("c", "b", (*parent, "_band"))).select("c.*", "b._before", "b._onward")
    by_ratio = Window.partitionBy(*parent).orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumns({
        "_left": F.col("budget") - F.col("_before") - F.coalesce(F.sum("capacity").over(by_ratio), F.lit(0)),
        "_weights": F.col("_onward") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)),
    })
    # the first child that is not full sets the level for all that follow
    level = inside.where(_wide("capacity") * _wide("_weights") > _wide("weight") * _wide("_left")).groupBy(*parent).agg(
        F.min(F.struct(ratio.alias("r"), F.col(name).alias("n"), F.col("_left").alias("left"), F.col("_weights").alias("weights"))).alias("_level"))
    shared = rows.alias("c").join(level.alias("l"), _null_safe("c", "l", parent), "left").select("c.*", "l._level")
    full = F.col("_level").isNull() | (F.struct(ratio.alias("r"), F.col(name).alias("n")) < F.struct("_level.r", "_level.n"))
    share = F.expr("(cast(weight as decimal(38,0)) * cast(_level.left as decimal(38,0))) div cast(_level.weights as decimal(38,0))")
    return shared.select(*parent, name, "capacity", F.when(full, F.col("capacity")).otherwise(share).alias("budget"))


def _listed(weights: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The listed weights in whole units; negative ones raise."""
    given = F.col("weight")
    units = F.when(given < 0, F.raise_error(F.lit("a weight is negative"))).otherwise(F.round(given.cast("decimal(28,9)") * _WEIGHT_UNIT, 0)).cast("long")
    return weights.where(given.isNotNull()).select(*keys, units.alias("weight")).groupBy(*keys).agg(F.max("weight").alias("weight"))


def _weighted(nodes: DataFrame, weights: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """``nodes`` with the listed weights of this level, 1 where none is listed."""
    if weights is None:
        return nodes.withColumn("weight", F.lit(_WEIGHT_UNIT).cast("long"))
    return nodes.alias("n").join(_listed(weights, keys).alias("w"), _null_safe("n", "w", keys), "left").select(
        "n.*", F.coalesce("w.weight", F.lit(_WEIGHT_UNIT)).alias("weight"))


def leaf_budgets(
    leaves: DataFrame, total: Column | int, max_epochs: int,
    domain_weights: DataFrame | None = None, lang_weights: DataFrame | None = None, source_weights: DataFrame | None = None,
) -> DataFrame:
    """domain, lang, source, tokens, budget. ``leaves``: the level columns and ``tokens``.

    ``total`` may be a number or an expression over ``tokens`` summed up, such as
    ``F.col("tokens") * 0.5``.
    """
    weights = (domain_weights, lang_weights, source_weights)
    capacity = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    for depth, listed in enumerate(weights):  # what weighs nothing holds nothing
        if listed is not None:
            keys = LEVELS[: depth + 1]
            capacity = capacity.alias("n").join(_listed(listed, keys).where("weight = 0").alias("w"), _null_safe("n", "w", keys), "left_anti")
    held = capacity.agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity"))
    budget = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).crossJoin(held).select(  # one row each
        F.lit(0).alias("root"), F.least(F.floor(F.lit(total) if isinstance(total, int) else total).cast("long"), F.col("capacity")).alias("budget"))
    capacity, parents, parent = written(capacity, "mix-capacity"), written(budget, "mix-budget"), ("root",)
    for depth, name in enumerate(LEVELS):
        keys = LEVELS[: depth + 1]
        nodes = capacity.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).where("capacity > 0").withColumn("root", F.lit(0))
        nodes = _weighted(nodes, weights[depth], keys)
        # each level is written: the plan stays small, and a level is computed once
        with_budget = written(nodes.alias("c").join(parents.alias("p"), _null_safe("c", "p", parent)).select("c.*", "p.budget"), "mix-nodes")
        filled = fill(with_budget, parent, name)
        parents, parent = written(filled.select(*parent, name, "budget"), "mix-level"), (*parent, name)
    return leaves.alias("l").join(parents.alias("b"), _null_safe("l", "b", LEVELS), "left").select(
        "l.*", F.coalesce("b.budget", F.lit(0)).cast("long").alias("budget"))


def epoch_key(seed: int, epoch: Column, id_col: Column) -> Column:
    """The place of a document in an epoch: 48 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, _KEY_BITS // 4), 16, 10).cast("long")


def select_tokens(
    docs: DataFrame, total: Column | int, max_epochs: int = 4, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", **weights: DataFrame | None,
) -> DataFrame:
    """One row for each document and epoch that the budgets reach.

    ``_id``, ``_text`` (hash), domain, lang, source, epoch (from 1), n_tokens and
    take_tokens: all tokens, or, for the one document of a leaf in which the budget
    ends, those within it.
    """
    require(docs, id_col, text_col, *LEVELS)
    slim = written(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), *LEVELS, word_tokens(text_col).alias("n_tokens")), "mix")
    leaves = written(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    plan = leaf_budgets(leaves, total, max_epochs, **weights).where("budget > 0").withColumns({
        "full": F.expr("budget div tokens"), "rest": F.col("budget") % F.col("tokens")})
    plan = written(plan, "mix-plan")
    placed = slim.alias("d").join(plan.alias("p"), _null_safe("d", "p", LEVELS)).select("d.*", "p.full", "p.rest")
    whole = placed.where("full > 0").select(
        "_id", "_text", *LEVELS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("full"))).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))

    names = ["_id", "_text", *LEVELS, "epoch", "n_tokens", "take_tokens"]
    part = placed.where("rest > 0").withColumn("key", epoch_key(seed, F.col("full") + 1, F.col("_id"))).withColumns({
        "epoch": F.col("full") + 1, "take_tokens": F.col("n_tokens"), "base": F.lit(0).cast("long")})
    chosen = whole.select(*names)
    for k in range(1, _DIGITS + 1):  # ranges of the key: those before the border go in, the border range goes on
        part = part.withColumn("digit", F.shiftright("key", _KEY_BITS - k * _DIGIT_BITS).bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1)))
        ends = Window.partitionBy(*LEVELS).orderBy("digit")
        ranges = part.groupBy(*LEVELS, "digit").agg(F.sum("n_tokens").alias("t"), F.first("base").alias("base")).withColumn(
            "end", F.col("base") + F.sum("t").over(ends)).withColumn("start", F.col("end") - F.col("t"))
        reached = part.alias("d").join(ranges.alias("r"), _null_safe("d", "r", (*LEVELS, "digit"))).select("d.*", "r.start", "r.end").where("start < rest")
        chosen = chosen.union(reached.where("end <= rest").select(*names))
        part = written(reached.where("end > rest").withColumn("base", F.col("start")).drop("start", "end"), "mix-border")
    order = Window.partitionBy(*LEVELS).orderBy("key", "_id", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = part.withColumn("at", F.col("base") + F.sum("n_tokens").over(order) - F.col("n_tokens")).where("at < rest").withColumn(
        "take_tokens", F.least("n_tokens", F.col("rest") - F.col("at")))
    return chosen.union(border.select(*names))


def mixed_documents(docs: DataFrame, domain: Column, total: Column | int, max_epochs: int, seed: int = 1,
                    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                    **weights: DataFrame | None) -> DataFrame:
    """The documents of the mix in their own columns, whole, once for each epoch that reaches them."""
    own = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    chosen = select_tokens(keyed.drop("row"), total, max_epochs, seed, **weights)
    # epochs are reached in turn, so the last one is their number; repeated rows share it
    times = chosen.groupBy("_id", "_text", *LEVELS).agg(F.max("epoch").alias("n"))
    rows = keyed.withColumn("_text", F.xxhash64("text"))
    joined = rows.alias("d").join(times.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c._id")) & (F.col("d._text") == F.col("c._text")) & _null_safe("d", "c", LEVELS))
    return joined.select("d.row", F.explode(F.array_repeat(F.lit(0), F.col("c.n").cast("int")))).select(*[F.col(f"row.`{c}`").alias(c) for c in own])

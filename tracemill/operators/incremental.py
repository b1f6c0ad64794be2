"""Accumulating state: reruns, escalation and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import rollout_fold
from .screening import infrastructure_cause


def superseded(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows; of equal keys the row of the later run stands. Needs ``run_pos``."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "run_pos").alias("r")).select(*keys, "r.*")


def merge_scope(old: DataFrame, new: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Assignments after a rerun of a scope: rows of the scope are replaced, the others stay."""
    return old.join(scope.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade(rollouts: DataFrame, tiers: list[str]) -> DataFrame:
    """instance_id, tier, band: the first tier that any rollout passes; none is ``rejected``.

    Only instances with no pass in a tier go on to the next.
    """
    at = F.array_position(F.array(*map(F.lit, tiers)), F.col("model")).cast("int")
    folded = rollouts.withColumn("tier_pos", at).where("tier_pos > 0").groupBy("instance_id", "tier_pos").agg(
        F.count_if("passed").alias("passes"), F.count("*").alias("n"))
    accepted = folded.where("passes > 0").groupBy("instance_id").agg(F.min(F.struct("tier_pos", "passes", "n")).alias("a"))
    everyone = rollouts.select("instance_id").distinct()
    return everyone.join(accepted, "instance_id", "left").select(
        "instance_id", F.get(F.array(*map(F.lit, tiers)), F.col("a.tier_pos") - 1).alias("tier"),
        F.when(F.col("a.tier_pos").isNull(), "rejected").when(F.col("a.passes") == F.col("a.n"), "all").otherwise("partial").alias("band"))


def recovered_bands(rollouts: DataFrame) -> DataFrame:
    """Bands from recorded rollouts; instances with failed infrastructure are reported and not scored."""
    cause = infrastructure_cause(F.col("reason"))
    broken = rollouts.where(cause.isNotNull()).groupBy("instance_id").agg(F.count("*").alias("broken"))
    return rollout_fold(rollouts).join(broken, "instance_id", "left").select(
        "instance_id", F.when(F.col("broken").isNull(), F.col("band")).alias("band"), F.coalesce("broken", F.lit(0)).alias("broken"))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no complete result yet."""
    return wanted.join(done, keys, "left_anti")

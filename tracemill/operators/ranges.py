"""The innermost of nested ranges that holds a point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges of up to 2^62 places.
LEVELS = 63


def innermost(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, take: list[str]) -> DataFrame:
    """``points`` with the columns ``take`` of the range of the same ``by`` that holds ``at`` and starts last; null where none does.

    Of ranges with one start the shortest counts, then the least in ``take``. A range
    stands on the level of its length, in the one or two buckets of that width which it
    touches, and a point looks into one bucket of each level in use: an equi-join, in
    which a point meets no range more than one and a half times its own bucket away.
    Ranges may nest and be of any length; ranges that end before they start hold nothing.
    """
    known = ranges.where(F.col(end) >= F.col(start)).select(*by, F.col(start).alias("_start"), F.col(end).alias("_end"), *take).withColumn("_level", F.ceil(F.log2((F.col("_end") - F.col("_start") + 1).cast("double"))).cast("int"))
    first, last = (F.call_function("shiftright", F.col(c).cast("long"), F.col("_level")) for c in ("_start", "_end"))
    placed = known.withColumn("_bucket", F.explode(F.sequence(first, last)))
    used = known.groupBy(*by).agg(F.collect_set("_level").alias("_levels"))  # 63 at most
    own = [c for c in points.columns if c not in by]
    numbered = points.select(*by, F.struct(*own).alias("_row"), F.col(at).cast("long").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    looking = numbered.join(used, by, "left").withColumn("_level", F.explode_outer("_levels"))
    looking = looking.withColumn("_bucket", F.call_function("shiftright", F.col("_at"), F.col("_level")))
    met = looking.join(placed, [*by, "_level", "_bucket"], "left")
    holds = (F.col("_start") <= F.col("_at")) & (F.col("_at") <= F.col("_end"))
    best = F.min(F.when(holds, F.struct((-F.col("_start")).alias("s"), "_end", *take))).alias("_best")
    kept = met.groupBy(*by, "_id").agg(F.first("_row").alias("_row"), best)
    return kept.select(*by, "_row.*", *[F.col(f"_best.{c}").alias(c) for c in take])

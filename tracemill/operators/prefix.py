"""Running totals and ranks within groups of any size, over range-partitioned rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

_RANGE = "_range"


def carried_on(ranged: DataFrame, by: list[str], at: str, value: Column, name: str) -> DataFrame:
    """``ranged`` with ``name`` raised by the sum of ``value`` over the rows of the same ``by`` in lower ranges ``at``.

    The ranges must be those of rows ordered by ``by`` first: then a range goes on with at
    most one group that began earlier, and the table of sums to add has no more rows than
    there are ranges.
    """
    sums = ranged.groupBy(*by, at).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.withColumn("_before", before).where("_before is not null").select(*[F.col(c).alias(f"_by_{k}") for k, c in enumerate(by)], F.col(at).alias("_at"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{k}")) for k, c in enumerate(by)], F.col(at) == F.col("_at"))
    raised = ranged.join(F.broadcast(carried), same, "left")  # one row for each range at most
    return raised.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*ranged.columns)


def running_total(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``by`` that come before.

    The rows are dealt to ranges of (by, order) and written; each range sums its own part
    of a group, and what stands in the ranges before is carried on. No task holds more
    than a range, however large the group. Rows alike in ``by`` and ``order`` share a
    range: end ``order`` with a key. Nulls in ``by`` are a group; a null value counts as none.
    """
    ranged = rows.withColumn("_value", F.coalesce(value, F.lit(0))).repartitionByRange(*[F.col(c) for c in by], *order)
    ranged = written(ranged.withColumn(_RANGE, F.spark_partition_id()), "ranges")
    inside = F.sum("_value").over(Window.partitionBy(*by, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn(name, F.coalesce(inside, F.lit(0)))
    return carried_on(out, by, _RANGE, F.col("_value"), name).select(*rows.columns, name)


def row_numbers(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within ``by`` in the given order."""
    return running_total(rows, by, order, F.lit(1), name).withColumn(name, (F.col(name) + 1).cast("long"))

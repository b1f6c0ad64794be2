"""Rows dealt over as many tasks as their number asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task where they are sorted and joined; small inputs get a task for each core.
ROWS_A_TASK = 400_000


def dealt(rows: DataFrame, *keys: str, counted: DataFrame | None = None, each: int = ROWS_A_TASK) -> DataFrame:
    """``rows`` over one task for every ``each`` rows, at least one a core; rows alike in ``keys`` together.

    A small file is read by one task however much work its rows make, and Spark joins
    partitions up to a size in bytes, whatever they grow to in memory; a number that is
    given stays. ``counted`` is a table with as many rows (or somewhat more) whose count is cheap.
    """
    n = (rows if counted is None else counted).count()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // each))
    return rows.repartition(tasks, *keys)

"""Helpers shared by the training-data operators: tables, texts and the word rule
that they have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written

__all__ = ["shared_dir", "written"]

#: A word is a maximal run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(F.col(c) if isinstance(c, str) else c, UPPER, LOWER)


def text_of(c: Column | str) -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_of(c: Column | str) -> Column:
    """The words of a text as an array; null and blank texts give none."""
    return F.filter(F.split(text_of(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def kept_lines(lines: Column, gone: Column) -> Column:
    """The text of ``lines`` without those at the places ``gone``, in time linear in the lines.

    Both should be columns of the frame, not expressions: they are read line by line.
    """
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

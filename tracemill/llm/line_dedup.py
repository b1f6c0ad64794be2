"""Line dedup by overlapping three-line windows, DataFrame functions only.

Lines are trimmed; blank lines belong to no window. Every three consecutive lines
of a document are a window, named by the digest of its text. Of the windows that
occur more than once in all documents, the first occurrence (least id, then text
hash, then place) stays; the lines that later occurrences cover are merged and
removed, blank lines between them too. A later window that overlaps its own first
occurrence spares the lines of that occurrence.

Defined results: null and empty texts, and texts of fewer than three lines with
text, are unchanged; a null id comes before all others; rows of equal id and text
are one document and get the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_lines, require, text_of

WINDOW = 3
_BLANK = " \t\n\x0b\x0c\r"


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text, k, from, to, window: the k-th window covers lines from .. to."""
    lines = F.filter(
        F.transform(F.split(text_of(text_col), "\n"), lambda l, i: F.struct(i.alias("pos"), F.btrim(l, F.lit(_BLANK)).alias("line"))),
        lambda s: s["line"] != "")
    at = lambda k: F.get("_lines", k)  # noqa: E731  one line of the array, not the array
    spans = F.transform(F.sequence(F.lit(0), F.size("_lines") - WINDOW), lambda k: F.struct(
        k.alias("k"), at(k)["pos"].alias("from"), at(k + WINDOW - 1)["pos"].alias("to"),
        F.unhex(F.md5(F.concat_ws("\n", *(at(k + i)["line"] for i in range(WINDOW))))).alias("window")))
    return (
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), lines.alias("_lines"))
        .select("_id", "_text", F.explode(F.when(F.size("_lines") >= WINDOW, spans)).alias("w")).select("_id", "_text", "w.*")
    )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text, removed: the line numbers that go, ascending. Other documents have no row."""
    windows = line_windows(docs, id_col, text_col)
    place = F.struct("_id", "_text", "k", "from", "to")
    repeated = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(
        ~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    own = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_text") == F.col("first._text"))
    later = windows.join(repeated, "window").where(~(own & (F.col("k") == F.col("first.k"))))
    spared = lambda p: own & p.between(F.col("first.from"), F.col("first.to"))
    gone = later.select("_id", "_text", F.filter(F.sequence("from", "to"), lambda p: ~spared(p)).alias("gone"))
    return gone.groupBy("_id", "_text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias("removed")).where(F.size("removed") > 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out, and ``removed`` (line numbers, empty if none)."""
    require(docs, id_col, text_col)
    own = [c for c in docs.columns if c != "removed"]
    gone = repeated_lines(docs, id_col, text_col)
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("d").join(
        gone.alias("g"), F.col("d.id").eqNullSafe(F.col("g._id")) & (F.col("d.h") == F.col("g._text")), "left")
    text = F.col(f"row.`{text_col}`")
    cut = joined.select("d.row", "g.removed", F.when(F.col("g.removed").isNotNull(), F.split(F.col(f"d.row.`{text_col}`"), "\n")).alias("_lines"))
    left = F.when(F.col("removed").isNull(), text).otherwise(kept_lines(F.col("_lines"), F.col("removed")))
    return cut.select(
        *[left.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in own],
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))

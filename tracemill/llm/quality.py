"""Quality rules: per-text word statistics and cross-document line frequency.

Lines are normalised (ASCII lower case, white space collapsed, trimmed) and
hashed. For each host and line hash the distinct texts are counted over all
documents. A line is boilerplate on its host if it stands in more than
``max_line_docs`` distinct texts; copies of one document are one text, so they do
not make their own lines boilerplate. Boilerplate lines are removed, and documents
that keep less than ``min_kept_share`` of their words, or fewer than
``min_kept_words``, are rejected as depleted.

Defined results: a null text has no words and no lines; a null host is a host of
its own; blank lines are never boilerplate; rows with equal id, host and text
are one document, and each of them gets the same verdict.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, kept_lines, require, text_of

MAX_LINE_DOCS = 20
MIN_KEPT_SHARE = 0.3
MIN_KEPT_WORDS = 10
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))

_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() parts at the six ASCII white-space bytes
    chars = len(b"".join(words).translate(None, _CONTINUATION))
    symbols = len(data.translate(None, _NOT_SYMBOLS))
    lines = Counter(data.split(b"\n"))
    dup_lines = sum(n - 1 for line, n in lines.items() if n > 1 and line.split())
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    repeat = 0
    if len(counts) < len(windows):
        covered_to = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeat += i + 3 - max(i, covered_to)
                covered_to = i + 3
    return len(words), chars, symbols, dup_lines, repeat


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` but the text, with the five counts of the whole text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line) and n_repeat_words (words in
    three-word windows that occur twice or more, the first ones included).
    Null and empty texts count zero everywhere.
    """
    require(docs, text_col)
    rest = [c for c in docs.columns if c != text_col and c not in _STATS]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(c, T.LongType()) for c in _STATS])

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_text_stats(t) for t in batch.column(text_col).to_pylist()]
            columns = [batch.column(c) for c in rest]
            columns += [pa.array([f[i] for f in found], pa.int64()) for i in range(len(_STATS))]
            yield pa.RecordBatch.from_arrays(columns, names=rest + _STATS)

    return docs.select(*rest, text_col).mapInArrow(stats, schema)


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), r"[\x20\x09-\x0D]+", " "))


def _doc_key(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.xxhash64(text_col).alias("_text")]


def document_lines(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per non-blank line: document key, row, pos, line_hash, words."""
    places = F.filter(F.transform("_lines", lambda l, i: F.struct(
        i.alias("pos"), F.xxhash64(l).alias("line_hash"), F.when(l == "", 0).otherwise(F.size(F.split(l, " "))).alias("words"))), lambda p: p["words"] > 0)
    return (
        docs.select(*_doc_key(docs, id_col, host_col, text_col), F.monotonically_increasing_id().alias("_row"),
                    F.transform(F.split(text_of(text_col), "\n"), _normal).alias("_lines"))
        .select("_id", "_host", "_text", "_row", F.explode(places).alias("l"))
        .select("_id", "_host", "_text", "_row", "l.*")
    )


def frequent_lines(lines: DataFrame, max_line_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """Boilerplate: host and line hash with its distinct texts.

    Texts are made distinct per (host, line) first, dealt by all three, so that one
    very common line is spread over the tasks.
    """
    return (
        lines.select("_host", "line_hash", "_text").distinct()
        .groupBy("_host", "line_hash").agg(F.count("*").alias("line_docs"))
        .where(F.col("line_docs") > max_line_docs)
    )


def removed_lines(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
    max_line_docs: int = MAX_LINE_DOCS,
) -> DataFrame:
    """Per document with boilerplate: removed_words, gone (places of lines). Other documents have no row."""
    lines = document_lines(docs, id_col, host_col, text_col)
    frequent = frequent_lines(lines, max_line_docs)
    hit = lines.alias("l").join(
        frequent.alias("f"), F.col("l._host").eqNullSafe(F.col("f._host")) & (F.col("l.line_hash") == F.col("f.line_hash"))
    ).select("l._id", "l._host", "l._text", "l._row", "l.pos", "l.words")
    by_row = hit.groupBy("_id", "_host", "_text", "_row").agg(
        F.sum("words").alias("removed_words"), F.array_sort(F.collect_set("pos")).alias("gone"))
    return by_row.groupBy("_id", "_host", "_text").agg(  # repeated rows have equal values
        F.max("removed_words").alias("removed_words"), F.max("gone").alias("gone"))


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def depleted(min_kept_share: float = MIN_KEPT_SHARE, min_kept_words: int = MIN_KEPT_WORDS) -> Column:
    left = F.col("n_words") - F.col("removed_words")
    return (F.col("removed_words") > 0) & ((left < min_kept_share * F.col("n_words")) | (left < min_kept_words))


def quality_report(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
    max_line_docs: int = MAX_LINE_DOCS,
) -> DataFrame:
    """One row per input row: id, the statistics, removed_words, base_failed, kept."""
    require(docs, id_col, host_col, text_col)
    stats = text_statistics(docs.select(*_doc_key(docs, id_col, host_col, text_col), F.col(text_col).alias("_body")), "_body")
    removed = removed_lines(docs, id_col, host_col, text_col, max_line_docs).drop("gone")
    joined = stats.alias("s").join(removed.alias("r"), _same("s", "r"), "left")
    return joined.select(
        F.col("s._id").alias(id_col), *[F.col(f"s.{c}") for c in _STATS],
        F.coalesce("r.removed_words", F.lit(0)).cast("long").alias("removed_words"),
    ).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~depleted())


def _same(a: str, b: str) -> Column:
    return (
        F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id"))
        & F.col(f"{a}._host").eqNullSafe(F.col(f"{b}._host"))
        & (F.col(f"{a}._text") == F.col(f"{b}._text"))
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
    max_line_docs: int = MAX_LINE_DOCS,
) -> DataFrame:
    """The documents that pass, in their own columns, without their boilerplate lines."""
    require(docs, id_col, host_col, text_col)
    own = docs.columns
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), *_doc_key(docs, id_col, host_col, text_col),
                       F.col(text_col).alias("_body"))
    passed = text_statistics(body, "_body").where(~base_failed())
    removed = removed_lines(docs, id_col, host_col, text_col, max_line_docs)
    joined = passed.alias("s").join(removed.alias("r"), _same("s", "r"), "left").select(
        "s.row", "s.n_words", F.coalesce("r.removed_words", F.lit(0)).alias("removed_words"), "r.gone",
        F.when(F.col("r.gone").isNotNull(), F.split(F.col(f"s.row.`{text_col}`"), "\n")).alias("_lines"))
    text = F.col(f"row.`{text_col}`")
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(kept_lines(F.col("_lines"), F.col("gone")))
    out = joined.where(~depleted()).select("row", cleaned.alias("cleaned"))
    return out.select(*[
        F.col("cleaned").alias(c) if c == text_col
        else F.length("cleaned").cast("long").alias(c) if c == "n_chars"  # follows the text it counts
        else F.col(f"row.`{c}`").alias(c) for c in own])

"""Token counts of whole texts.

Texts are encoded inside Arrow functions that return lengths only. Long texts
are split at safe boundaries (see ``pieces``), the pieces are put into batches
of about equal size, and the counts of a text's pieces are added up.

Defined results: null and empty texts count zero bytes and zero tokens; repeated
rows count each; a column named like a result is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import require

TOKEN_LIMIT = 4096
BATCH_BYTES = 1 << 20
LONG_TEXT = 1 << 15
#: A space between two characters that are neither white space nor U+2581, the
#: sentence-piece sign for a space: no piece reaches over it, it begins the next word.
_BOUNDARY = re.compile("(?<=[^\\s\u2581]) (?=[^\\s\u2581])")


def pieces(text: str, most: int = LONG_TEXT) -> list[str]:
    """A text, cut at safe boundaries into pieces of ``most`` characters or a little more.

    A stretch without a safe boundary stays whole however long it is.
    """
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        found = _BOUNDARY.search(text, start + most)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.end()
    return [*out, text[start:]]


def sentencepiece_counter(model_file: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """A loader of the function from texts to the numbers of their tokens."""

    def load() -> Callable[[list[str]], list[int]]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]

    return load


def byte_batches(owned: Iterator[tuple[int, str]], most: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Runs of (owner, piece) of about ``most`` bytes together."""
    batch, size = [], 0
    for item in owned:
        batch.append(item)
        size += len(item[1].encode("utf-8"))
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def token_counts(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[int]]], text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """Every column but the text, with n_bytes, n_tokens and over_limit.

    ``load`` runs once in a task and gives the function from parts to lengths.
    """
    require(docs, text_col)
    made = ["n_bytes", "n_tokens", "over_limit"]
    rest = [c for c in docs.columns if c not in (text_col, *made)]
    kinds = [T.LongType(), T.LongType(), T.BooleanType()]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(n, k) for n, k in zip(made, kinds)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = load()
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            sizes = [len(t.encode("utf-8")) for t in texts]
            tokens = [0] * len(texts)
            owned = ((i, piece) for i, t in enumerate(texts) for piece in pieces(t))
            for part in byte_batches(owned):
                for (i, _), n in zip(part, lengths([piece for _, piece in part])):
                    tokens[i] += n
            over = [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())],
                names=rest + made)

    return docs.select(*rest, text_col).mapInArrow(count, schema)

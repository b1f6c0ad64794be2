r"""Chat formatting on token ids.

Each turn becomes ``### <role>: <text></turn>`` and a line end, assembled from ids: role
and text are encoded by themselves, so no token reaches over a segment's end, and the
template's signs are reserved ids above the vocabulary, which no text can give. The loss
mask is a running sum over +1 at the start and -1 behind the end of each segment to learn.

Control strings inside a text are escaped, so that the written-out form can be read
back too: a backslash goes before each, and backslashes that stand directly before a
control string or at the end of a text are doubled. Special tokens of the vocabulary
inside texts are encoded as ordinary text.

Turns are dealt to ranges of (conversation, turn) and assembled as they stream by, in
pieces of whole turns that end after ``PIECE`` ids. Where a piece starts in its
conversation is a running total, carried on over ranges, so one conversation of any
length is spread over tasks and rows.

Defined results: a null text or role is empty; a null id is a conversation of its own;
turns go by number, nulls first, ties by role and then by the hash of the text; repeated
rows are turns of their own; a conversation without a learned text has an empty loss;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.prefix import carried_on
from .common import require, written
from .token_files import BYTE_SIGNS, ByteEncoder

TURN, ROLE_END, TURN_END = "### ", ": ", "</turn>"
#: What the reserved ids stand for, in the order of their numbers above the vocabulary.
RESERVED = [TURN, ROLE_END, TURN_END + "\n"]
#: Ids after which a conversation goes on in a further piece; roles whose ids a worker remembers.
PIECE = 1 << 16
MANY_ROLES = 4096


class Escape:
    """Escapes control strings by backslashes, and takes them out again."""

    def __init__(self, control: list[str]) -> None:
        self.control = control
        signs = "|".join(map(re.escape, control))
        self._any = re.compile(rf"(\\*)({signs}|\Z)")
        self._there = re.compile(rf"(?<!\\)(?:\\\\)*(?P<sign>{signs})")

    def __call__(self, text: str) -> str:
        if not text.endswith("\\") and not any(c in text for c in self.control):
            return text
        return self._any.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)

    def back(self, text: str) -> str:
        return text if "\\" not in text else self._any.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)

    def first(self, text: str, at: int) -> re.Match[str] | None:
        """The first control string of ``text`` from ``at`` that is not escaped."""
        return self._there.search(text, at)


ROLE = Escape([TURN, ROLE_END, TURN_END])
TEXT = Escape([TURN, TURN_END])


def read_text(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a conversation as written out."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn begins at {at}")
        at += len(TURN)
        role = ROLE.first(formatted[at:], 0)
        body_at = at + role.end("sign")
        body = TEXT.first(formatted[body_at:], 0)
        turns.append((ROLE.back(formatted[at : at + role.start("sign")]), TEXT.back(formatted[body_at : body_at + body.start("sign")])))
        at = body_at + body.end("sign") + 1
    return turns


class ChatTokens:
    """Encodes segments and decodes them again, exactly, by a byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str) -> None:
        self.encoder = ByteEncoder(path)
        model = self.encoder.model
        model.encode_special_tokens = True
        self.first = model.get_vocab_size()
        byte_of = {chr(c): b for b, c in enumerate(BYTE_SIGNS.tolist())}
        own = [b""] * self.first
        for token, i in model.get_vocab(with_added_tokens=False).items():
            own[i] = bytes(byte_of[c] for c in token)
        for i, token in model.get_added_tokens_decoder().items():
            own[i] = token.content.encode("utf-8")
        self.bytes = pa.array(own, pa.large_binary())
        self.heads: dict[str, np.ndarray] = {}

    def head(self, role: str) -> np.ndarray:
        """The ids before a turn's text."""
        if role not in self.heads:
            if len(self.heads) >= MANY_ROLES:
                self.heads.clear()
            ids = self.encoder.model.encode(ROLE(role), add_special_tokens=False).ids
            self.heads[role] = np.array([self.first, *ids, self.first + 1], np.int32)
        return self.heads[role]

    def bodies(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text and the sign behind it."""
        for n, ids, sizes in self.encoder(pa.array([TEXT(t) for t in texts], pa.large_string()), self.first + 2):
            yield from np.split(ids, np.cumsum(sizes)[:-1]) if n else ()

    def texts(self, ids: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
        """The texts of spans of ids; reserved ids stand in none of them."""
        flat = self.bytes.take(pa.array(np.where(ids < self.first, ids, 0)))
        ends = np.frombuffer(flat.buffers()[1], np.int64)
        data = memoryview(flat.buffers()[2] or b"")
        return [str(data[ends[lo] : ends[hi]], "utf-8") for lo, hi in spans]


@functools.cache
def chat_tokens(path: str) -> ChatTokens:
    """One for each worker and file."""
    return ChatTokens(path)


def _turn_ids(roles: list[str], texts: list[str], tokens: ChatTokens) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each turn the ids before its text, and those of the text with the sign behind it."""
    return zip(map(tokens.head, roles), tokens.bodies(texts))


def loss_mask(sizes: np.ndarray, begins: np.ndarray, ends: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """One byte for each id of turns of these sizes: 1 from begin to end of the learned ones."""
    at = np.cumsum(sizes) - sizes
    steps = np.zeros(int(sizes.sum()) + 1, np.int8)
    np.add.at(steps, (at + begins)[learned], 1)
    np.add.at(steps, (at + ends)[learned], -1)
    return np.cumsum(steps[:-1], dtype=np.int8)


class _Piece:
    """The turns of one piece, in order."""

    def __init__(self, conv: object, at: int, start: int) -> None:
        self.conv, self.at, self.start, self.n = conv, at, start, 0
        self.ids: list[np.ndarray] = []
        self.spans: list[tuple[int, int, int, bool]] = []

    def add(self, head: np.ndarray, body: np.ndarray, learned: bool) -> None:
        self.ids += [head, body]
        size = len(head) + len(body)
        self.spans.append((size, len(head), size - 1, learned))
        self.n += size

    def row(self) -> tuple:
        sizes, begins, ends, learned = (np.array(c) for c in zip(*self.spans))
        return self.conv, self.at, self.start, len(self.spans), np.concatenate(self.ids, dtype=np.int32), loss_mask(sizes, begins, ends, learned.astype(bool))


def _pieces(batches: Iterator[pa.RecordBatch], tokens: ChatTokens, learn: tuple[str, ...], most: int) -> Iterator[tuple]:
    """Pieces of the turns of one range, which come in order; one piece is held at a time."""
    now: _Piece | None = None
    for batch in batches:
        convs, ranges, roles = (batch.column(c).to_pylist() for c in ("conv_id", "range", "role"))
        for conv, at, role, (head, body) in zip(convs, ranges, roles, _turn_ids(roles, batch.column("text").to_pylist(), tokens)):
            if now is None or now.conv != conv or now.n >= most:
                if now is not None:
                    yield now.row()
                now = _Piece(conv, at, now.start + now.n if now is not None and now.conv == conv else 0)
            now.add(head, body, role in learn)
    if now is not None:
        yield now.row()


def format_chats(turns: DataFrame, tokenizer: str, learn: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """conv_id, start, n_turns, input_ids, loss_mask: the pieces of each conversation, written once in the shared folder.

    ``start`` is the place of the piece's first id in the conversation, ``loss_mask`` has
    one byte for each id. ``tokenizer`` is the file of a byte-level vocabulary.
    """
    require(turns, conv_col, turn_col, role_col, text_col)
    own = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie")]
    schema = T.StructType([T.StructField("conv_id", own.schema["conv_id"].dataType), T.StructField("range", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("n_turns", T.LongType()), T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.ByteType()))])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in _pieces(batches, chat_tokens(tokenizer), learn, piece):
            rows.append(row)
            size += len(row[4])
            if size >= PIECE:
                yield _batch(rows, schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer for small texts: encoding costs more than reading
    ranged = own.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()).sortWithinPartitions(*order)
    made = written(ranged.mapInArrow(assemble, schema), "chats")
    return carried_on(made, ["conv_id"], "range", F.size("input_ids"), "start").drop("range")


def _segments(ids: np.ndarray, mask: np.ndarray, first: int) -> list[tuple[int, int, bool]]:
    """From where to where a piece holds ordinary ids (or one reserved id) of one mask value, and that value."""
    cut = np.flatnonzero((ids[1:] >= first) | (ids[:-1] >= first) | (mask[1:] != mask[:-1])) + 1
    bounds = [0, *cut.tolist(), len(ids)]
    return [(lo, hi, bool(mask[lo])) for lo, hi in zip(bounds, bounds[1:]) if hi > lo]


def _read_piece(ids: np.ndarray, mask: np.ndarray, tokens: ChatTokens) -> tuple[list[tuple[str, str]], list[str], int]:
    """The turns (role, text) of a piece, the learned texts, and the code points of the written-out form."""
    spans = _segments(ids, mask, tokens.first)
    plain = [s for s in spans if ids[s[0]] < tokens.first]
    words = dict(zip(plain, tokens.texts(ids, [s[:2] for s in plain])))
    turns, learned, chars, parts, role = [], [], 0, [], ""
    for span in spans:
        if span in words:
            chars += len(words[span])
            parts.append(words[span])
            if span[2]:
                learned.append(TEXT.back(words[span]))
            continue
        sign = RESERVED[ids[span[0]] - tokens.first]
        chars += len(sign)
        if sign == TURN:
            parts = []
        elif sign == ROLE_END:
            role, parts = ROLE.back("".join(parts)), []
        else:
            turns.append((role, TEXT.back("".join(parts))))
    return turns, learned, chars


def read_chats(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, start, n_turns, said (role, line end, text, line end of each turn), learned (the texts under the mask), formatted_chars."""
    conv = pieces.schema["conv_id"]
    schema = T.StructType([conv, T.StructField("start", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("said", T.StringType()),
                           T.StructField("learned", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chat_tokens(tokenizer)
        for batch in batches:
            rows = []
            for ids, mask in zip(batch.column("input_ids"), batch.column("loss_mask")):
                turns, learned, chars = _read_piece(ids.values.to_numpy(), mask.values.to_numpy(), tokens)
                rows.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(learned), chars))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("start"), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64())))],
                names=schema.names)

    return pieces.select("conv_id", "start", "input_ids", "loss_mask").mapInArrow(read, schema)


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row for each conversation, from its pieces in order; only one piece is held."""
    now: list | None = None
    said = learned = None
    for conv, n, text, loss, chars in rows:
        if now is None or now[0] != conv:
            if now is not None:
                yield (now[0], now[1], said.hexdigest(), now[2], learned.hexdigest(), now[3])
            now, said, learned = [conv, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
        now[1] += n
        now[2] += len(loss)
        now[3] += chars
        said.update(text.encode("utf-8"))
        learned.update(loss.encode("utf-8"))
    if now is not None:
        yield (now[0], now[1], said.hexdigest(), now[2], learned.hexdigest(), now[3])


def chat_digests(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the ids and masks.

    Pieces are decoded where they stand; only the digests, which go over a conversation
    in order, need its pieces sorted, and they hold one at a time.
    """
    conv = pieces.schema["conv_id"]
    schema = T.StructType([conv, T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "said", "learned", "formatted_chars")))

        out: list[tuple] = []
        for row in _digests(rows()):
            out.append(row)
            if len(out) == 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return read_chats(pieces, tokenizer).repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(fold, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), kinds)], names=schema.names)

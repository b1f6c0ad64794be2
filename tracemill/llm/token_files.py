"""Token ids as Arrow stream files of equal-length sequences.

Documents are range-partitioned by id and sorted, so that the shards, taken in
order, hold them in ascending id order. Each shard is one Arrow stream file whose
batches have two columns of one width, ``input_ids`` (fixed-size lists) and ``mask`` (a
bit for each id in fixed-size binaries, 0 on the padding of a shard's last sequence),
and a second stream file with the id, start and length of its documents. All batches of a shard but the last have one size, so
sequence ``i`` is found by its number alone: the manifest says in which shard, a
product where its batch begins, and the file is mapped and viewed there. A shard is written under a
fresh name and counts only once its row stands in the written manifest, so tasks
that are lost or run twice leave no trace in the result.

Defined results: a null text is an empty one (one end id); null ids come first;
rows of equal id follow the hash of their text; repeated rows are written as
often as they come; an empty table gives no shard and no row.
"""

from __future__ import annotations

import bisect
import functools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import require, shared_dir, text_of, written

SEQUENCE = 2048
END_ID = 0
BATCH_SEQUENCES = 64
MEMO_ENTRIES = 1_000_000
LONG_PART = 24
GROUP_BYTES = 8 << 20
#: A space between two other characters: no pre-token of the byte-level vocabularies reaches over it.
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: Texts with other white space than single spaces, line ends and blank lines between
#: characters, or with the sign that begins added tokens, are cut by ``_BOUNDARY`` alone.
_ODD = (r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
        r"|  | \n|\n |\n\n\n|\n\n$|^ | $|^\n|<\|")
#: What a part begins with: the text (no space), a line end (no space), the end of the document, else a space.
_HEAD, _LINE, _END = "\r", "\n", "\n\n"
#: Words of letters that are letters to every version of the character tables, with one mark behind them or none.
_MARKS = ".,;:!?"
_WORD = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+[.,;:!?]?$"
_RUN_PARTS = 4096
#: Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
BYTE_SIGNS = np.array([b if b in _PRINTED else 0x100 + _OTHERS.index(b) for b in range(256)], "<u4")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start .. start + size of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class ByteEncoder:
    """Ids of texts by the tokenizers library.

    Texts are cut in Arrow before single spaces and line ends, where pre-tokens end
    in any case, and their parts dictionary-encoded; only distinct parts are looked
    up, and the ids of all parts are gathered at once. Known parts are kept, in
    bounded number. Unknown ones are encoded many at once and told apart by the
    bytes that each id stands for; words of letters need no pattern for that.
    """

    def __init__(self, path: str, entries: int = MEMO_ENTRIES) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.model = Tokenizer.from_file(path)
        # the same model for words of letters after a space or a line end
        self.words, self.lines = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.pre_tokenizer = Split(chr(BYTE_SIGNS[ord(" ")]), "merged_with_next")
        self.lines.pre_tokenizer = Split(chr(BYTE_SIGNS[ord(_LINE)]), "isolated")
        size = self.model.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.entries = entries
        # each character of a byte-level token stands for one byte; added tokens stand for themselves
        self.bytes_of = np.zeros(size, np.int64)
        for token, i in self.model.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)
        for i, token in self.model.get_added_tokens_decoder().items():
            self.bytes_of[i] = len(token.content.encode("utf-8"))
        self.marks = self._single([*_MARKS, ""])
        self.line_bytes = self.kind.itemsize * len(self.model.encode(_LINE, add_special_tokens=False).ids)
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _binary(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * self.kind.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, self.kind))])

    def _single(self, texts: list[str]) -> pa.Array:
        found = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return self._binary(np.array([i for ids in found for i in ids], self.kind), np.array([len(ids) for ids in found], np.int64))

    def __call__(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For groups of texts in turn: their number, all ids, each with ``end_id`` behind it, and the lengths."""
        texts = texts.cast(pa.large_string())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        group = np.cumsum(sizes) // GROUP_BYTES
        lo = 0
        for hi in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]:
            if hi > lo:
                yield hi - lo, *self._group(texts.slice(lo, hi - lo), end_id)
            lo = hi

    def _group(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        lines = pc.replace_substring(texts, "\n", " \n")
        whole = pc.binary_join_element_wise(*(pa.scalar(x, lines.type) if isinstance(x, str) else x for x in (_HEAD, lines, " " + _END, "")))
        lists = pc.split_pattern(whole, " ")
        parts, ends = lists.flatten(), lists.offsets.to_numpy()
        counts, firsts = np.diff(ends), ends[:-1] - ends[0]
        if odd.any():
            own = [self._cut(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            n = np.array([len(o) for o in own], np.int64)
            counts, firsts = counts.copy(), firsts.copy()
            firsts[odd] = len(parts) + np.cumsum(n) - n
            counts[odd] = n
            parts = pa.concat_arrays([parts, pa.array([p for o in own for p in o], parts.type)])
            parts = parts.take(pa.array(_ranges(firsts, counts)))
        coded = pc.dictionary_encode(parts)
        found = self._found(coded.dictionary, end_id).take(coded.indices)
        _, offsets, data = found.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(found) + 1][np.concatenate([[0], np.cumsum(counts)])] // self.kind.itemsize
        return np.frombuffer(data, self.kind)[: ends[-1]], np.diff(ends)

    @staticmethod
    def _cut(text: str) -> list[str]:
        first, *rest = _BOUNDARY.split(text)
        return [_HEAD + first, *rest, _END]

    def _found(self, parts: pa.Array, end_id: int) -> pa.Array:
        """The ids of distinct parts. Long parts and beginnings of texts are not kept."""
        at = pc.index_in(parts, value_set=self.known)
        gaps = at.is_null()
        missing = parts.filter(gaps)
        own = self._own(missing, end_id)
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[gaps.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(missing))
        out = pa.concat_arrays([self.ids, own]).take(pa.array(place))
        keep = pc.and_(pc.less(pc.binary_length(missing), LONG_PART), pc.invert(pc.match_substring_regex(missing, "^\r|^\n\n")))
        if len(self.known) + len(missing) > self.entries:
            self.known, self.ids = self.known.slice(0, 0), self.ids.slice(0, 0)
        self.known = pa.concat_arrays([self.known, missing.filter(keep)])
        self.ids = pa.concat_arrays([self.ids, own.filter(keep)])
        return out

    def _own(self, missing: pa.Array, end_id: int) -> pa.Array:
        """Ids of the missing parts, kind by kind, put back into their order."""
        bare = pc.match_substring_regex(missing, "^[\r\n]")
        head = pc.starts_with(missing, _HEAD)
        plain = pc.match_substring_regex(missing, r"^[\r\n]?" + _WORD)
        spaced = pc.invert(bare)
        single = pc.and_(pc.and_(bare, pc.invert(plain)), pc.match_substring_regex(missing, r"^[\r\n][^\x21-\x7f]|[^\x21-\x7f]$|<\|"))
        joined = pc.and_(bare, pc.invert(pc.or_(single, plain)))
        body = pc.if_else(bare, pc.utf8_slice_codeunits(missing, 1), missing)
        order, found = [], []
        for mask, run in (
            (pc.and_(spaced, plain), lambda p: self._words(self.words, " ", p)),
            (pc.and_(bare, plain), lambda p: self._words(self.lines, _LINE, p)),
            (pc.and_(spaced, pc.invert(plain)), lambda p: self._run(self.model, " ", p)),
            (joined, lambda p: self._run(self.model, _LINE, p)),
        ):
            if pc.any(mask).as_py():
                ids = run(body.filter(mask))
                heads = head.filter(mask)
                if pc.any(heads).as_py():  # no line end stands before the beginning of a text
                    ids = pc.if_else(heads, pc.binary_replace_slice(ids, 0, self.line_bytes, b""), ids)
                order.append(np.flatnonzero(mask))
                found.append(ids)
        rest = np.flatnonzero(single)
        if len(rest):
            texts = missing.take(pa.array(rest)).to_pylist()
            ids = self._single([t.removeprefix(_HEAD) if t != _END else "" for t in texts])
            end = np.array([end_id], self.kind).tobytes()
            order.append(rest)
            found.append(pc.if_else(pa.array([t == _END for t in texts]), pa.scalar(end, pa.large_binary()), ids))
        if not found:
            return pa.array([], pa.large_binary())
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))

    def _words(self, model, before: str, parts: pa.Array) -> pa.Array:
        stem = pc.utf8_rtrim(parts, characters=_MARKS)
        last = pc.utf8_slice_codeunits(parts, -1)
        mark = self.marks.take(pc.fill_null(pc.index_in(last, value_set=pa.array(list(_MARKS), last.type)), len(_MARKS)))
        return pc.binary_join_element_wise(self._run(model, before, stem, signs=True), mark, pa.scalar(b"", pa.large_binary()))

    def _run(self, model, before: str, parts: pa.Array, signs: bool = False) -> pa.Array:
        """Encode many parts at once, each after the sign ``before``."""
        lengths = pc.binary_length(parts).to_numpy() + 1
        flats, sizes = [], []
        for i in range(0, len(parts), _RUN_PARTS):
            text = before + before.join(parts.slice(i, _RUN_PARTS).to_pylist())
            if signs:
                text = BYTE_SIGNS[np.frombuffer(text.encode("utf-8"), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(lengths[i : i + _RUN_PARTS])) + 1
            flats.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return self._binary(np.concatenate(flats), np.concatenate(sizes))


@functools.cache
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def byte_encoder(path: str) -> Callable[[], ByteEncoder]:
    """A loader that keeps one encoder, and what it knows, in each Python worker from task to task."""
    return functools.partial(_encoder, path)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Shard:
    """Writes one shard; ids are flushed batch by batch."""

    def __init__(self, uri: str, kind: np.dtype, length: int, id_type: pa.DataType) -> None:
        self.place, base = _place(uri)
        self.place.create_dir(base, recursive=True)
        self.stem = f"{uri}/{uuid.uuid4().hex}"
        self.kind, self.length, self.n, self.docs = kind, length, 0, 0
        self.pending, self.size = [], 0
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("input_ids", pa.list_(item, length)), ("mask", pa.binary(-(-length // 8)))])
        self.tokens = self._open("tokens", self.schema)
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index = self._open("docs", self.index_schema)

    def _open(self, name: str, schema: pa.Schema) -> tuple:
        out = self.place.open_output_stream(_place(f"{self.stem}.{name}.arrow")[1])
        return out, ipc.new_stream(out, schema)

    def add(self, ids: pa.Array, tokens: np.ndarray, lengths: np.ndarray) -> None:
        starts = self.n + np.cumsum(lengths) - lengths
        self.index[1].write_batch(pa.record_batch([ids, pa.array(starts), pa.array(lengths)], schema=self.index_schema))
        self.n, self.docs = self.n + len(tokens), self.docs + len(ids)
        self.pending.append(tokens)
        self.size += len(tokens)
        if self.size >= self.length * BATCH_SEQUENCES:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate([np.zeros(0, self.kind), *self.pending])
        step = self.length * BATCH_SEQUENCES
        whole = len(flat) // step * step
        for lo in range(0, whole, step):
            self._batch(flat[lo : lo + step], step)
        rest = flat[whole:]
        if last and len(rest):
            self._batch(rest, -(-len(rest) // self.length) * self.length)
            rest = rest[:0]
        self.pending, self.size = [rest.copy()], len(rest)

    def _batch(self, ids: np.ndarray, size: int) -> None:
        mask = np.zeros((size // self.length, self.length), np.uint8)
        mask.reshape(-1)[: len(ids)] = 1
        bits = np.packbits(mask, axis=1, bitorder="little")
        values = np.zeros(size, self.kind)
        values[: len(ids)] = ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(values), self.length),
                   pa.Array.from_buffers(self.schema.field("mask").type, len(bits), [None, pa.py_buffer(bits)])]
        self.tokens[1].write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        for out, writer in (self.tokens, self.index):
            writer.close()
            out.close()


#: Text of one shard, about, where there is more than the session has shuffle partitions.
SHARD_BYTES = 256 << 20
MANIFEST = "shard long, stem string, n_tokens long, n_docs long, n_sequences long"
_SHARD_BLOCK = 1024


def write_tokens(
    docs: DataFrame, load: Callable[[], ByteEncoder], uri: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = SEQUENCE, shards: int | None = None,
) -> DataFrame:
    """Write all documents and give the manifest: shard, stem, n_tokens, n_docs, n_sequences, start, first_sequence.

    ``start`` and ``first_sequence`` are the numbers of ids and sequences in all shards
    before. One row a shard. If ``shards`` is not given there is one for each
    ``SHARD_BYTES`` of text, and one for each shuffle partition of the session at least.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    where = uri or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if not shards:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"), F.xxhash64(text_col).alias("h"))
    # the number is given, so that few rows are not drawn together into one task
    sorted_rows = rows.repartitionByRange(shards, "id", "h").sortWithinPartitions("id", "h").select("id", "body")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if encode is None:
                encode = load()
                shard = _Shard(where, encode.kind, length, batch.column(0).type)
            lo = 0
            for n, tokens, lengths in encode(batch.column(1), end_id):
                shard.add(batch.column(0).slice(lo, n), tokens, lengths)
                lo += n
                pa.default_memory_pool().release_unused()
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pydict({
                "shard": [TaskContext.get().partitionId()], "stem": [shard.stem], "n_tokens": [shard.n], "n_docs": [shard.docs], "n_sequences": [-(-shard.n // length)]})

    manifest = written(sorted_rows.mapInArrow(write, MANIFEST), "manifest").withColumn("block", F.expr(f"shard div {_SHARD_BLOCK}"))
    # running sums over blocks of shards, then within each block
    sums = {"n_tokens": "start", "n_sequences": "first_sequence"}
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = manifest.groupBy("block").agg(*[F.sum(c).alias(c) for c in sums]).select("block", *[before(c, Window.orderBy("block")).alias(f"base_{c}") for c in sums])
    inner = manifest.withColumns({f"inner_{c}": before(c, Window.partitionBy("block").orderBy("shard")) for c in sums})
    return inner.join(blocks, "block").select(
        "shard", "stem", "n_tokens", "n_docs", "n_sequences", *[(F.col(f"base_{c}") + F.col(f"inner_{c}")).alias(name) for c, name in sums.items()])


def _batches(uri: str) -> Iterator[pa.RecordBatch]:
    place, path = _place(uri)
    if isinstance(place, fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            yield from ipc.open_stream(source)
    else:
        with place.open_input_stream(path) as source:
            yield from ipc.open_stream(source)


class TokenFiles:
    """Random access to the sequences of a manifest by number; keeps the manifest's few numbers of each shard."""

    def __init__(self, manifest: DataFrame) -> None:
        rows = sorted(manifest.select("first_sequence", "stem", "n_sequences").collect())  # one a shard
        self.firsts, self.stems = [r[0] for r in rows], [r[1] for r in rows]
        self.n = sum(r[2] for r in rows)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask bits of sequence ``i``: views of the mapped file, or of the one batch that is read."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        shard = bisect.bisect_right(self.firsts, i) - 1
        batch, row = divmod(i - self.firsts[shard], BATCH_SEQUENCES)
        place, path = _place(f"{self.stems[shard]}.tokens.arrow")
        with pa.memory_map(path) if isinstance(place, fs.LocalFileSystem) else place.open_input_file(path) as source:
            schema = ipc.read_schema(source)
            first = source.tell()
            if batch:  # all batches but the last are as long as the first
                ipc.read_message(source)
                source.seek(first + batch * (source.tell() - first))
            found = ipc.read_record_batch(ipc.read_message(source), schema)
        length, width = schema.field("input_ids").type.list_size, schema.field("mask").type.byte_width
        ids = found.column(0).flatten().to_numpy(zero_copy_only=True)[row * length : (row + 1) * length]
        return ids, np.frombuffer(found.column(1).buffers()[1], np.uint8, width, row * width)


def mask_of(bits: np.ndarray, length: int) -> np.ndarray:
    """A byte for each of ``length`` ids from the bits of their mask."""
    return np.unpackbits(bits, count=length, bitorder="little")


def _documents(stem: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[int]]]:
    """Batches of ids, starts, lengths and crcs of the documents of a shard, read side by side with its ids."""
    flats = (b.column(0).flatten().to_numpy(zero_copy_only=True) for b in _batches(f"{stem}.tokens.arrow"))
    flat, at = np.zeros(0, np.uint16), 0
    for batch in _batches(f"{stem}.docs.arrow"):
        lengths = batch.column(2).to_numpy()
        crcs = []
        for n in lengths.tolist():
            crc, left = 0, n
            while left:
                if at == len(flat):
                    flat, at = next(flats), 0
                part = flat[at : at + left]
                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                at, left = at + len(part), left - len(part)
            crcs.append(crc)
        yield batch.column(0), batch.column(1).to_numpy(), lengths, crcs


def read_documents(manifest: DataFrame, id_type: str | T.DataType = "long") -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. One task a shard."""
    schema = T.StructType([T.StructField("doc_id", T.DataType.fromDDL(id_type) if isinstance(id_type, str) else id_type),
                           *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, base in zip(batch.column("stem").to_pylist(), batch.column("start").to_pylist()):
                for ids, starts, lengths, crcs in _documents(stem):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(base + starts), pa.array(lengths), pa.array(crcs, pa.int64())], names=schema.names)

    shards = manifest.select("shard", "stem", "start")
    last = shards.agg(F.max("shard")).first()[0]
    return shards.repartitionByRange(max(1, (last or 0) + 1), "shard").select("stem", "start").mapInArrow(read, schema)

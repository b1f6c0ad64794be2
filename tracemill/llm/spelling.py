"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word is a point of 64 coordinates: how often each letter (its code modulo 32)
stands in the word, and how often in its first half. One edit moves the first 32
by an L1 distance of two at most (of one if it inserts), the last 32 by two at most.
For each pair of lengths (equal, or one apart) a range search with these radii
prunes boxes of a k-d tree, and the words of the leaves that it reaches are compared
letter by letter: two words one edit apart have the first or the last half in common,
which a sorted lookup in the leaf finds, and the rest is verified.

A k-d tree over a bounded sample of the words (one in ``LEAST_STEP`` or more, and
about ``SAMPLE`` at most) deals all words to cells. Each word is a point of one cell
and a query of each cell within the radii, so no cell holds more than its share, and a
second tree in the cell's task does the search. Forms are followed to their roots by
pointer doubling; a form is ``RATIO`` times as frequent, so chains are short.

Defined results: null and blank texts have no words; a null id counts as an empty one;
repeated rows count as often as they come; an empty table gives no rows; other columns
are not read. Words of any length are compared whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, written

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
#: Words of the sample that shapes the cells: at most about so many, and at most one word of so many.
SAMPLE, LEAST_STEP = 1 << 16, 16
CELL = 4096
LEAF = 256
HALF = 32
_WIDE = 2 * HALF
_RUNS = 1 << 19
_VECTOR_WORD = 64
_PAIR_BYTES = 1 << 24

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # U+00C0 to U+00FF are two bytes, of which the first is 0xC3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The crc32 of each run ``data[start : start + size]``, going on from ``base``."""
    order = np.argsort(-sizes, kind="stable")
    first, state = starts[order], ~base[order]
    by_size = -sizes[order]
    longest = int(sizes.max(initial=0))
    for j in range(min(longest, _VECTOR_WORD)):
        k = int(np.searchsorted(by_size, -j))  # those longer than j come first
        state[:k] = _CRC[(state[:k] ^ data[first[:k] + j]) & 0xFF] ^ (state[:k] >> 8)
    out = np.empty(len(sizes), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(sizes > _VECTOR_WORD):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes(), int(base[i]))
    return out


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, and of each letter run the start, the end and the number of its text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends_of = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends_of[0] : ends_of[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = ends_of - ends_of[0]
    letter = _LETTER[raw]
    letter[1:] |= raw[:-1] == 0xC3
    fresh = np.zeros(len(raw) + 1, bool)  # a text begins here, or ended before
    fresh[bounds] = True
    before = np.concatenate([[False], letter[:-1]]) & ~fresh[:-1]
    after = np.concatenate([letter[1:], [False]]) & ~fresh[1:]
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    return _LOWER[raw], starts, ends, np.searchsorted(bounds, starts, "right") - 1


def _counted(ids: list, texts: pa.Array, least: int, drop_every: int | None) -> Iterator[pa.RecordBatch]:
    data, starts, ends, of = _runs(texts)
    wide = np.flatnonzero(data == 0xC3)
    letters = ends - starts - (np.searchsorted(wide, ends) - np.searchsorted(wide, starts))
    long = letters >= least
    starts, ends, of, letters = starts[long], ends[long], of[long], letters[long]
    base = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    for lo in range(0, len(starts), _RUNS):
        own = slice(lo, lo + _RUNS)
        first, size = starts[own], ends[own] - starts[own]
        changed: Counter[str] = Counter()
        if drop_every:
            h = _crcs(data, first, size, base[of[own]])
            hit = h % np.uint32(drop_every) == 0
            for s, n, x in zip(first[hit].tolist(), size[hit].tolist(), h[hit].tolist()):
                word = data[s : s + n].tobytes().decode("utf-8")
                gone = x % len(word)
                changed[word[:gone] + word[gone + 1 :]] += 1
            first, size = first[~hit], size[~hit]
        ends_at = np.cumsum(size)
        places = np.repeat(first - (ends_at - size), size) + np.arange(ends_at[-1] if len(size) else 0)
        offsets = np.concatenate([[0], ends_at]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[places])))
        found = pc.value_counts(words)
        short = [(w, n) for w, n in changed.items() if len(w) >= least]
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([found.field("values").cast(pa.string()), pa.array([w for w, _ in short], pa.string())]),
             pa.concat_arrays([found.field("counts"), pa.array([n for _, n in short], pa.int64())])], names=["word", "n"])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, drop_every: int | None = None) -> DataFrame:
    """word, n of all letter runs of at least so many letters, A-Z lower-cased.

    With ``drop_every``, a run whose crc32 of ``<id>:<run>`` it divides loses one letter first.
    """
    require(docs, id_col, text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _counted(batch.column(0).to_pylist(), batch.column(1), least_letters, drop_every)

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return own.mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Letters:
    """The letters of words (code points below 256), their vectors and the hashes of their halves."""

    def __init__(self, words: list[str]) -> None:
        coded = [w.encode("latin-1") for w in words]
        self.sizes = np.array([len(c) for c in coded], np.int64)
        self.flat = np.frombuffer(b"".join(coded), np.uint8)
        self.ends = np.cumsum(self.sizes)

    def vectors(self) -> np.ndarray:
        """A row of 64 counts for each word."""
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.arange(len(self.flat)) - np.repeat(self.ends - self.sizes, self.sizes)
        code = of * _WIDE + self.flat % HALF
        first = at < np.repeat(self.sizes // 2, self.sizes)
        n = len(self.sizes) * _WIDE
        counts = np.bincount(code, minlength=n) + np.bincount(code[first] + HALF, minlength=n)
        return counts.reshape(-1, _WIDE).astype(np.int32)

    def matrix(self, which: np.ndarray) -> np.ndarray:
        """The letters of words of one length, a row for each."""
        size = int(self.sizes[which[0]]) if len(which) else 0
        return self.flat[(self.ends[which] - size)[:, None] + np.arange(size)]


def _hashes(letters: np.ndarray) -> np.ndarray:
    h = np.full(len(letters), 7, np.uint64)
    for column in letters.T:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + column
    return h


def grow(points: np.ndarray, most: int) -> tuple[list, list[np.ndarray]]:
    """A k-d tree: nodes (dimension, last value of the left side, left, right) or (leaf number,), the root first, and the points of each leaf.

    A leaf holds more than ``most`` points only where all are alike.
    """
    nodes: list = [None]
    leaves: list[np.ndarray] = []
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if len(own) > most:
            here = points[own]
            middle = np.partition(here, len(own) // 2, axis=0)[len(own) // 2]
            low, under = (here <= middle).sum(0), (here < middle).sum(0)
            shares = np.stack([np.minimum(low, len(own) - low), np.minimum(under, len(own) - under)])
            side, dim = np.unravel_index(shares.argmax(), shares.shape)
            if shares[side, dim]:
                cut = int(middle[dim]) - int(side)
                left = here[:, dim] <= cut
                nodes[at] = (int(dim), cut, len(nodes), len(nodes) + 1)
                todo += [(len(nodes), own[left]), (len(nodes) + 1, own[~left])]
                nodes += [None, None]
                continue
        nodes[at] = (len(leaves),)
        leaves.append(own)
    return nodes, leaves


def search(nodes: list, queries: np.ndarray, whole: int, half: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The leaves whose boxes lie within the two L1 radii of queries: leaf, the queries, whether the box holds them."""
    columns = np.ascontiguousarray(queries.T)
    n = len(queries)
    everything = np.iinfo(np.int32)
    todo = [(0, np.arange(n), {}, np.zeros(n, np.int32), np.zeros(n, np.int32))]
    while todo:
        at, own, box, far, far_half = todo.pop()
        if not len(own):
            continue
        if len(nodes[at]) == 1:
            yield nodes[at][0], own, (far == 0) & (far_half == 0)
            continue
        dim, cut, left, right = nodes[at]
        low, high = box.get(dim, (everything.min, everything.max))
        value = columns[dim][own].astype(np.int64)
        was = np.maximum(low - value, 0) + np.maximum(value - high, 0)
        for child, lo, hi in ((left, low, min(high, cut)), (right, max(low, cut + 1), high)):
            more = (np.maximum(lo - value, 0) + np.maximum(value - hi, 0) - was).astype(np.int32)
            a, b = (far + more, far_half) if dim < HALF else (far, far_half + more)
            near = (a <= whole) & (b <= half)
            todo.append((child, own[near], box | {dim: (lo, hi)}, a[near], b[near]))


#: Radii (whole word, first half) of the search among words of the same length, and among words one letter longer.
SAME, LONGER = (2, 2), (1, 2)


def _joined(keys: np.ndarray, at: np.ndarray, order: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a of at, b of to) with ``keys[0][a] == order-sorted keys[1][b]``."""
    lo, hi = np.searchsorted(order, keys, "left"), np.searchsorted(order, keys, "right")
    n = hi - lo
    ends = np.cumsum(n)
    return np.repeat(at, n), to[np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _one_edit(letters: Letters, a: np.ndarray, b: np.ndarray, longer: bool) -> np.ndarray:
    """Whether b is a with one letter replaced, or (longer) with one letter more."""
    out = np.zeros(len(a), bool)
    size = int(letters.sizes[a[0]]) if len(a) else 0
    step = max(1, _PAIR_BYTES // (size + 1))
    for lo in range(0, len(a), step):
        x, y = letters.matrix(a[lo : lo + step]), letters.matrix(b[lo : lo + step])
        if longer:
            front, back = x != y[:, :-1], x != y[:, 1:]
            first = np.where(front.any(1), front.argmax(1), size)
            last = np.where(back.any(1), size - 1 - back[:, ::-1].argmax(1), -1)
            out[lo : lo + step] = last < first
        else:
            out[lo : lo + step] = (x != y).sum(1) == 1
    return out


def near_pairs(words: list[str], points: np.ndarray, same: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of words one edit apart: a from ``same`` (the length of the points) or ``shorter`` (one less), b from ``points``."""
    if not len(points) or not len(same) + len(shorter):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = Letters(words)
    vectors = letters.vectors()
    nodes, leaves = grow(vectors[points], LEAF)
    size = int(letters.sizes[points[0]])
    own = letters.matrix(points)
    found = []
    for asked, (whole, half), longer in ((same, SAME, False), (shorter, LONGER, True)):
        if not len(asked):
            continue
        at = (size - longer) // 2
        mine = letters.matrix(asked)
        ours = [_hashes(mine[:, :at]), _hashes(mine[:, at:])]
        theirs = [_hashes(own[:, :at]), _hashes(own[:, at + longer :])]
        for leaf, who, _ in search(nodes, vectors[asked], whole, half):
            there = leaves[leaf]
            pairs = []
            for k in range(2):
                order = np.argsort(theirs[k][there], kind="stable")
                a, b = _joined(ours[k][who], who, theirs[k][there][order], there[order])
                if k:  # found by the first half already
                    fresh = ours[0][a] != theirs[0][b]
                    a, b = a[fresh], b[fresh]
                pairs.append((a, b))
            a, b = (np.concatenate(x) for x in zip(*pairs))
            right = _one_edit(letters, asked[a], points[b], longer)
            found.append((asked[a[right]], points[b[right]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    return a, b


_POINT, _SAME, _SHORTER = 0, 1, 2


def _cell_result(table: pa.Table) -> pa.Table:
    """Of each word with near words in the cell: their number and the most frequent of them."""
    words, n, kind = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("kind").to_numpy()
    a, b = near_pairs(words, np.flatnonzero(kind == _POINT), np.flatnonzero(kind != _SHORTER), np.flatnonzero(kind == _SHORTER))
    mixed = kind[a] == _SHORTER  # the longer word is no query for the shorter one
    a, b = np.concatenate([a, b[mixed]]), np.concatenate([b, a[mixed]])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(a)))
    return pa.table({"word": pa.array([words[i] for i in a[first]], pa.string()), "n_near": pa.array(sizes, pa.int64()),
                     "near": pa.array([words[i] for i in b[first]], pa.string()), "near_n": pa.array(n[b[first]], pa.int64())})


def _cells(spark: SparkSession, vocabulary: DataFrame) -> dict[int, list]:
    """A k-d tree for each length of the sampled words; other lengths are one cell."""
    step = max(LEAST_STEP, math.ceil(vocabulary.count() / SAMPLE))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters(batch.column(0).to_pylist())
            rows = letters.vectors()
            yield pa.RecordBatch.from_arrays([pa.array(letters.sizes), pa.array([r.tobytes() for r in rows], pa.binary())], names=["size", "counts"])

    taken = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(step)) == 0).select("word")
    sample = taken.mapInArrow(of, "size long, counts binary").toArrow()
    sizes, counts = sample.column("size").to_numpy(), sample.column("counts").to_pylist()
    points = np.frombuffer(b"".join(counts), np.int32).reshape(-1, _WIDE)
    most = max(4, CELL // step)
    return {int(s): grow(points[sizes == s], most)[0] for s in np.unique(sizes)}


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, near, near_n: how many words of ``vocabulary`` (word, n) are one edit away, and the most frequent
    (ties: the least) of them. Words without any have no row. Words should be distinct, of code points below 256."""
    spark = vocabulary.sparkSession
    trees = spark.sparkContext.broadcast(_cells(spark, vocabulary))
    alone = [(0,)]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters(batch.column("word").to_pylist())
            vectors = letters.vectors()
            for size in np.unique(letters.sizes).tolist():
                own = np.flatnonzero(letters.sizes == size)
                for target, (whole, half) in ((size, SAME), (size + 1, LONGER)):
                    for cell, who, inside in search(trees.value.get(target, alone), vectors[own], whole, half):
                        kind = np.where(inside, _POINT, _SAME) if target == size else np.full(len(who), _SHORTER)
                        rows = batch.take(pa.array(own[who]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(who), target), pa.int64()), pa.array(np.full(len(who), cell), pa.int64()),
                             pa.array(kind, pa.int32()), rows.column("word"), rows.column("n")], names=["size", "cell", "kind", "word", "n"])

    rows = vocabulary.select("word", "n").mapInArrow(dealt, "size long, cell long, kind int, word string, n long")
    found = rows.groupBy("size", "cell").applyInArrow(_cell_result, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """word and the last of its forms, of the rows (word, form); chains have at most log(most) steps."""
    at = forms.select("word", F.col("form").alias("root"))
    steps = max(1, int(math.log(max(most, 1), RATIO)) + 1)
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, drop_every: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of at least ``LEAST_LETTERS`` letters that occur ``least_count`` times."""
    words = written(count_words(docs, id_col, text_col, LEAST_LETTERS, drop_every).where(F.col("n") >= least_count), "vocabulary")
    frequent = F.col("near_n") >= RATIO * F.col("n")
    named = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n"))
    named = written(named, "forms")
    most = named.agg(F.max("n")).first()[0] or 1
    roots = _roots(named.where("form is not null"), most)
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

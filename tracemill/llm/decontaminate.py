"""Benchmark decontamination by random-walk embedding and bit sampling.

Texts and items are sequences of words. The embedding of a sequence walks over it
with random bits: step j writes the word under the cursor, and the cursor moves on
if the random bit of (j, word) is set. Sequences at small edit distance fall into
step again after an edit, so their embeddings stay close in Hamming distance. A
repetition samples a few steps of one walk; windows of a document that agree with
an item on all of them are candidates. Items are dealt into classes of about equal
length, so that steps are sampled over item-sized windows. The number of
repetitions of each class is raised until its items, with the most edits allowed put
anywhere and put all at the front, are found with the recall asked for. Each candidate is verified by exact word edit distance against every window
of the text around it. A class that would need more than ``MOST_REPEATS`` repetitions,
and items of fewer than ``MIN_ITEM_WORDS`` words, are searched exactly instead: of one
more piece than there are edits, one stands in the text as it is.

Two bounds that lose nothing come first: a window within k edits of an item has at
least that item's words but k, so windows with too few words of the whole
benchmark start no walk. Words that no item has are one symbol.

Defined results: null and empty texts have no hits; null items and items without words
are passed over; ``without_items`` passes over items of fewer than ``MIN_ITEM_WORDS``
words too, as clean texts hold such phrases; ids keep their types; repeated rows are
judged each; equal items hit each under its own id. The items are taken to the tasks in
blocks of ``BLOCK_WORDS`` words, one pass over the documents for each, so that what is
sent stays bounded however many items there are.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import require

MAX_EDIT_SHARE = 0.2
RECALL = 0.98
MIN_ITEM_WORDS = 5
BLOCK_WORDS = 200_000
SAMPLED = 3
MOST_REPEATS = 96
CLASS_RATIO = 1.35
STEPS_PER_WORD = 1.5
CHUNK_CHARS = 4 << 20
_MARKS = b".,;:!?\"'()[]{}*#"


def words_of(text: str | None) -> list[bytes]:
    """Words in ASCII lower case without punctuation."""
    return (text or "").encode("utf-8").lower().translate(None, _MARKS).split()


def best_window(item: list, text: list) -> tuple[int, int]:
    """Least edit distance between the item and any window of the text, and where that window ends."""
    n = len(item)
    bits: dict = {}
    for i, w in enumerate(item):
        bits[w] = bits.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for at, w in enumerate(text, 1):
        eq = bits.get(w, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | ~(horizontal | up) & full
        minus = up & horizontal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
        if score < best:
            best, end = score, at
    return best, end


class _Class:
    """Items of about one length: their sampled steps and keys by repetition."""

    def __init__(self, members: list[int], lengths: list[int], share: float) -> None:
        self.members = members
        self.least, self.most = min(lengths), max(lengths)
        k = int(share * self.most)
        self.span, self.need = self.most + k, self.least - int(share * self.least)
        self.head = self.least - int(share * self.least)
        self.head_need = self.head - k
        self.repeats: list[tuple] = []
        self.reached = 0.0
        #: Length of the pieces of the exact search, of which an item has one more than edits; 0: not searched so.
        self.piece, self.pieces = 0, k + 1


class Screen:
    """Finds the items of one block in texts. Built on the driver, sent to the tasks."""

    def __init__(self, items: list[tuple[int, str]], share: float = MAX_EDIT_SHARE, recall: float = RECALL, seed: int = 7, min_words: int = 1) -> None:
        self.share, self.seed = share, seed
        split = [(i, words_of(t)) for i, t in items]
        split = [(i, w) for i, w in split if len(w) >= max(1, min_words)]
        self.item_ids, self.items = [i for i, _ in split], [w for _, w in split]
        self.vocabulary: dict[bytes, int] = {}
        for w in self.items:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.coded = [np.array([self.vocabulary[x] for x in w], np.int64) for w in self.items]
        self.base = len(self.vocabulary) + 1
        self.classes: list[_Class] = []
        self._deal()
        if self.items:
            self._reach(recall)

    def _deal(self) -> None:
        order = sorted(range(len(self.items)), key=lambda i: len(self.items[i]))
        while order:
            least = len(self.items[order[0]])
            most = MIN_ITEM_WORDS - 1 if least < MIN_ITEM_WORDS else CLASS_RATIO * least
            members = [i for i in order if len(self.items[i]) <= most]
            self.classes.append(_Class(members, [len(self.items[i]) for i in members], self.share))
            order = order[len(members):]

    def _walk_bits(self, repeat: int) -> np.ndarray:
        """Random bits by (step word, symbol): 64 steps in each row."""
        most = int(STEPS_PER_WORD * max(c.least for c in self.classes)) + SAMPLED
        rng = np.random.default_rng((self.seed, repeat))
        return rng.integers(0, 1 << 64, (most // 64 + 1, self.base), dtype=np.uint64)

    def _add_repeat(self, c: _Class) -> None:
        repeat = len(c.repeats)
        if repeat == len(self.bits):
            self.bits.append(self._walk_bits(repeat))
        bits = self.bits[repeat]
        rng = random.Random(self.seed * 1_000_003 + repeat)
        steps = sorted(rng.sample(range(max(SAMPLED, int(STEPS_PER_WORD * c.least))), SAMPLED))
        keys, owners = [], []
        for m in c.members:
            word, at, code = self.coded[m], 0, []
            for j in range(steps[-1] + 1):
                if at == len(word):
                    break
                if j in steps:
                    code.append(int(word[at]))
                at += int(bits[j // 64, word[at]] >> np.uint64(j % 64)) & 1
            if len(code) == SAMPLED:
                keys.append(code)
                owners.append(m)
        firsts = np.zeros(self.base, bool)
        firsts[[k[0] for k in keys]] = True
        pairs = np.unique(np.array([k[0] * self.base + k[1] for k in keys], np.int64))
        whole = np.array([(k[0] * self.base + k[1]) * self.base + k[2] for k in keys], np.int64)
        order = np.argsort(whole, kind="stable")
        c.repeats.append((steps, firsts, pairs, whole[order], np.array(owners, np.int64)[order]))

    def _edited(self, word: np.ndarray, rng: random.Random, front: bool) -> list[int]:
        """An item with the most edits allowed, anywhere or all at its front."""
        word = list(word)
        edits = int(self.share * len(word))
        other = lambda: rng.randrange(self.base)  # noqa: E731  a word of the benchmark, or (0) of none
        for at in range(edits):
            kind, p = rng.randrange(3), min(at, len(word) - 1) if front else rng.randrange(len(word))
            if kind == 0:
                word[p] = other()
            elif kind == 1:
                word.insert(p, other())
            else:
                del word[p]
        return word

    def _reach(self, recall: float) -> None:
        """Add repetitions, class by class, until edited items are found often enough."""
        self.bits: list[np.ndarray] = []
        for c in self.classes:
            rng = random.Random(self.seed)
            chosen = c.members if len(c.members) <= 200 else rng.sample(c.members, 200)
            trials = [(m, self._edited(self.coded[m], rng, front)) for m in chosen for front in (False, True) for _ in range(-(-200 // len(chosen)))]
            gap = [0] * 20
            at = np.cumsum([0, *(len(w) + 20 for _, w in trials)])[:-1]
            ids = np.array([x for _, w in trials for x in (*gap, *w)] + gap, np.int64)
            found: set[int] = set()
            while c.least >= MIN_ITEM_WORDS and len(found) < recall * len(trials) and len(c.repeats) < MOST_REPEATS:
                self._add_repeat(c)
                for start, m in self._walks(c, ids, [len(c.repeats) - 1]):
                    place = int(np.searchsorted(at, start, side="right")) - 1
                    if place >= 0 and trials[place][0] == m:
                        found.add(place)
            c.reached = len(found) / len(trials)
            if c.reached < recall:
                c.repeats, c.reached = [], 1.0
                c.piece = 1 if c.least < MIN_ITEM_WORDS else max(1, c.least // c.pieces)
                self._add_pieces(c)

    def _add_pieces(self, c: _Class) -> None:
        keys, owners, offsets = [], [], []
        for m in c.members:
            word = self.coded[m]
            for k in range(c.pieces):
                keys.append(self._piece_keys(word[k * c.piece : (k + 1) * c.piece], c.piece)[0])
                owners.append(m)
                offsets.append(k * c.piece)
        keys = np.array(keys, np.uint64)
        order = np.argsort(keys, kind="stable")
        c.table = keys[order], np.array(owners, np.int64)[order], np.array(offsets, np.int64)[order]

    @staticmethod
    def _piece_keys(ids: np.ndarray, length: int) -> np.ndarray:
        """A hash of each run of ``length`` words."""
        n = max(0, len(ids) - length + 1)
        out = np.zeros(n, np.uint64)
        for i in range(length):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64)
        return out

    def _pieces(self, c: _Class, ids: np.ndarray, borders: np.ndarray) -> set[tuple[int, int]]:
        """Where a window of each item met would begin, within its text."""
        table, owners, offsets = c.table
        keys = self._piece_keys(ids, c.piece)
        lo, hi = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
        out = set()
        for p in np.flatnonzero((hi > lo) & (ids[: len(keys)] > 0)).tolist():
            begin = int(borders[np.searchsorted(borders, p, side="right") - 1])
            out.update((max(begin, p - int(offsets[k])), int(owners[k])) for k in range(lo[p], hi[p]))
        return out

    def _starts(self, c: _Class, known: np.ndarray, n: int) -> np.ndarray:
        """Places where a window may begin; ``known`` is the running count of benchmark words."""
        ends = np.minimum(np.arange(n) + c.span, n)
        heads = np.minimum(np.arange(n) + c.head, n)
        return np.flatnonzero((known[ends] - known[:n] >= c.need) & (known[heads] - known[:n] >= c.head_need))

    def _walks(self, c: _Class, ids: np.ndarray, repeats: list[int]) -> set[tuple[int, int]]:
        n = len(ids)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        starts = self._starts(c, known, n)
        out: set[tuple[int, int]] = set()
        if len(starts):
            ids = np.concatenate([ids, np.zeros(int(STEPS_PER_WORD * c.most) + SAMPLED + 1, np.int64)])
            for r in repeats:
                out |= self._met(ids, starts, self.bits[r], *c.repeats[r])
        return out

    def _candidates(self, ids: np.ndarray, borders: np.ndarray) -> set[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        for c in self.classes:
            out |= self._pieces(c, ids, borders) if c.piece else self._walks(c, ids, list(range(len(c.repeats))))
        return out

    def _met(self, ids, starts, bits, steps, firsts, pairs, whole, owners) -> set[tuple[int, int]]:
        at, key, sampled = starts, None, 0
        origin = starts
        for j in range(steps[-1] + 1):
            word = ids[at]
            if j == steps[sampled]:
                if sampled == 0:
                    keep, key = firsts[word], word
                else:
                    key = key * self.base + word
                    table = pairs if sampled == 1 else whole
                    keep = table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key if len(table) else np.zeros(len(key), bool)
                at, word, key, origin = at[keep], word[keep], key[keep], origin[keep]
                sampled += 1
                if not len(at):
                    return set()
            if sampled < SAMPLED:
                at = at + ((bits[j // 64][word] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        lo, hi = np.searchsorted(whole, key, "left"), np.searchsorted(whole, key, "right")
        return {(int(s), int(m)) for s, a, b in zip(origin, lo, hi) for m in owners[a:b]}

    def _spans(self, candidates: set[tuple[int, int]], borders: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """text, item, and the words from .. to to be verified; spans that meet are one."""
        now: list[int] = []
        for m, start in sorted((m, start) for start, m in candidates):
            d = int(np.searchsorted(borders, start, side="right")) - 1
            k = int(self.share * len(self.coded[m]))
            begin, end = max(int(borders[d]), start - k), min(int(borders[d + 1]), start + len(self.coded[m]) + 2 * k)
            if now and now[0] == d and now[1] == m and begin <= now[3]:
                now[3] = end
                continue
            if now:
                yield tuple(now)
            now = [d, m, begin, end]
        if now:
            yield tuple(now)

    def hits(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """For each text: item index -> (edits, word at which its window ends)."""
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if not self.items:
            return out
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < CHUNK_CHARS):
                size += len(texts[hi] or "")
                hi += 1
            code = self.vocabulary.get
            coded = [[code(w, 0) for w in words_of(t)] for t in texts[lo:hi]]
            borders = np.cumsum([0, *map(len, coded)])
            flat = np.fromiter((x for c in coded for x in c), np.int64, int(borders[-1]))
            for d, m, begin, end in self._spans(self._candidates(flat, borders), borders):
                item = self.coded[m]
                edits, at = best_window(item.tolist(), flat[begin:end].tolist())
                old = out[lo + d].get(m)
                if edits <= int(self.share * len(item)) and (not old or edits < old[0]):
                    out[lo + d][m] = (edits, begin - int(borders[d]) + at)
            lo = hi
        return out


def screens(items: DataFrame, item_id: str = "item_id", text_col: str = "text", **params) -> Iterator[Screen]:
    """The screens of the blocks of items; one block is on the driver at a time."""
    block: list[tuple[int, str]] = []
    words = 0
    for row in items.select(F.col(item_id), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        words += len(row[1].split())
        if words >= BLOCK_WORDS:
            yield Screen(block, **params)
            block, words = [], 0
    if block:
        yield Screen(block, **params)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", **params) -> DataFrame:
    """id, item_id, edits, item_words, end_word: one row for each document and item found in it."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("item_id", items.schema[item_id].dataType),
                           *(T.StructField(c, T.LongType()) for c in ("edits", "item_words", "end_word"))])
    found = None
    for screen in screens(items, item_id, **params):
        sent = docs.sparkSession.sparkContext.broadcast(screen)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            screen = sent.value
            for batch in batches:
                rows = [(at, screen.item_ids[m], e, len(screen.items[m]), end)
                        for at, h in enumerate(screen.hits(batch.column(1).to_pylist())) for m, (e, end) in h.items()]
                if rows:
                    at, *rest = zip(*rows)
                    kinds = (None, pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(rest, kinds))], names=schema.names)

        part = rows.mapInArrow(find, schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("doc_id", id_col)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", min_words: int = MIN_ITEM_WORDS, **params) -> DataFrame:
    """The documents in which no item is found, in their own columns. No shuffle."""
    require(docs, text_col)
    for screen in screens(items, min_words=min_words, **params):
        sent = docs.sparkSession.sparkContext.broadcast(screen)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            screen = sent.value
            for batch in batches:
                keep = [not h for h in screen.hits(batch.column(text_col).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs

"""Hard negatives by a secondary sort.

Every row whose id the step divides is an anchor. Anchors and rows are dealt to blocks by
the hash of their id, and each pair of blocks is scored by one matrix product. A first
pass keeps what can be among an anchor's first positives; their scores give the windows
of scores in which its negatives lie. A second pass keeps, of each pair of blocks, the
positives and the first negatives of each window: all that can be in the result, and no
more rows for a hot vector or label than for any other. Each kept pair becomes a key of
(anchor, descending score, id); ``repartitionAndSortWithinPartitions`` brings the keys of
an anchor together in this order, and one pass over them opens a window at each positive
and hands out negatives until it is full. Neither an anchor's rows nor its windows are
gathered: a pass holds the few negatives of the present score and the windows still open.

Defined results: rows with a null id, label or vector, or a null or non-finite component,
take no part; of rows with one id the least (label, vector) counts; missing components of
a shorter vector are zero; an anchor without positives, and a positive without
negatives, has no row; an empty table gives no rows; other columns are not read. Scores
are exact; one beyond a long raises an error.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, written

#: Anchors and rows of a block, about: a pair of blocks is scored in one task at a time.
ANCHORS, ROWS = 4096, 2048
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between so many hundredths of the positive's score and the score itself.
LEAST_PERCENT = 80
_STEP = 256
_KEY = struct.Struct(">QQQB")
_SIGN = 1 << 63
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null where the vector, or a component, is null or not finite."""
    wide = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return F.when(F.coalesce(fine, F.lit(False)), wide)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(a: np.ndarray, b: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, as longs; those marked as of a row with itself are not needed."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in m.tolist()] for m in (a, b))
    exact = [[0 if same else sum(x * y for x, y in zip(p, q)) for q, same in zip(right, marks)] for p, marks in zip(left, itself.tolist())]
    if any(not -_SIGN <= s < _SIGN for row in exact for s in row):
        raise ValueError("an inner product is beyond a long")
    return np.array(exact, np.int64).reshape(len(a), len(b))


def _width(column: pa.ChunkedArray) -> int:
    lists = column.combine_chunks()
    return int(np.diff(lists.offsets.to_numpy()).max(initial=0))


class Block:
    """The scores of a block of anchors with a block of rows, anchor by anchor, rows by descending score and id."""

    def __init__(self, anchors: pa.Table, rows: pa.Table) -> None:
        width = max(_width(anchors.column("anchor_q")), _width(rows.column("q")))
        self.anchors, self.ids = anchors.column("anchor_id").to_numpy(), rows.column("vec_id").to_numpy()
        self.anchor_labels, self.labels = anchors.column("anchor_label").to_numpy(), rows.column("label").to_numpy()
        order = np.argsort(self.ids, kind="stable")  # so that a stable sort by score leaves ties by id
        self.ids, self.labels = self.ids[order], self.labels[order]
        self.a, self.b = _matrix(anchors.column("anchor_q"), width), _matrix(rows.column("q"), width)[order]

    def each(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place of the anchor, its scores with all rows, and whether a row is a positive (1), a negative (0) or itself (-1)."""
        for lo in range(0, len(self.anchors), _STEP):
            itself = self.anchors[lo : lo + _STEP, None] == self.ids
            for i, score in enumerate(_scores(self.a[lo : lo + _STEP], self.b, itself), lo):
                kind = (self.labels == self.anchor_labels[i]).astype(np.int8)
                kind[itself[i - lo]] = -1
                yield i, score, kind


def _first(score: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The places, of those in ``among``, of the n highest scores; ties by place. In this order."""
    if len(among) > n:
        own = score[among]
        least = np.partition(own, len(own) - n)[len(own) - n]
        above, level = among[own > least], among[own == least]
        among = np.concatenate([above, level[: n - len(above)]])
    return among[np.argsort(-score[among], kind="stable")]


def pair_key(anchor: int, score: int, other: int, positive: bool) -> bytes:
    """Sorts by anchor, descending score and id."""
    return _KEY.pack(anchor + _SIGN, _SIGN - 1 - score, other + _SIGN, positive)


def read_key(key: bytes) -> tuple[int, int, int, bool]:
    anchor, score, other, positive = _KEY.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, other - _SIGN, bool(positive)


def _keys_of(block: Block, first: dict[int, list[int]], negatives: int, least: int) -> Iterator[bytes]:
    """Keys of the pairs of a block that can matter, given the scores of each anchor's positives."""
    for i, score, kind in block.each():
        anchor = int(block.anchors[i])
        asked = first.get(anchor)
        if not asked:
            continue
        mine = np.flatnonzero((kind == 1) & (score >= min(asked)))
        wanted = {(int(k), True) for k in _first(score, mine, len(asked))}
        others = kind == 0
        for s in set(asked):
            if s >= 0:
                inside = np.flatnonzero(others & (score <= s) & (score >= -(-least * s // 100)))
                wanted |= {(int(k), False) for k in _first(score, inside, negatives)}
        for k, positive in wanted:
            yield pair_key(anchor, int(score[k]), int(block.ids[k]), positive)


def windows(keys: Iterator[bytes], positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT) -> Iterator[tuple[int, int, int, int, int, int]]:
    """One pass over sorted keys: a window opens at each of an anchor's first positives and takes the negatives that follow.

    Negatives of the positive's own score belong to its window wherever they stand, so
    the first few of the present score are kept until the score changes.
    """
    anchor = level = None
    opened: list[list] = []  # positive, its score, negatives taken so far
    tied: list[int] = []  # negatives of the present score, the first few
    n = 0
    for key in keys:
        own, score, other, positive = read_key(key)
        if own != anchor:
            anchor, level, opened, n = own, None, [], 0
        if score != level:
            level, tied = score, []
        if positive:
            if n < positives:
                n += 1
                if score >= 0:
                    window = [other, score, 0]
                    for neg in tied:
                        window[2] += 1
                        yield anchor, other, window[2], neg, score, score
                    opened.append(window)
            continue
        if len(tied) < negatives:
            tied.append(other)
        opened = [w for w in opened if w[2] < negatives and 100 * score >= least * w[1]]
        for w in opened:
            w[2] += 1
            yield anchor, w[0], w[2], other, w[1], score


def mine(vectors: DataFrame, anchor_every: int, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
         positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor's first positives."""
    require(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                         quantised(F.col(vector_col), scale).alias("q")).where("vec_id is not null and label is not null and q is not null")
    rows = written(own.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v")).select("vec_id", "v.label", "v.q"), "vectors")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("q").alias("anchor_q"))
    n, n_anchors = rows.count(), anchors.count()
    groups, blocks = max(1, math.ceil(n / ROWS)), max(1, math.ceil(n_anchors / ANCHORS))
    by_row = rows.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("a", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block = Block(left, right)
            for i, score, kind in block.each():
                top = _first(score, np.flatnonzero(kind == 1), positives)
                found += [(int(block.anchors[i]), int(score[k]), int(block.ids[k])) for k in top]
        columns = list(zip(*found)) or [[], [], []]
        return pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip(("anchor_id", "score", "id"), columns)})

    near = dealt(anchors).groupBy("a", "g").cogroup(by_row.groupBy("a", "g")).applyInArrow(best, "anchor_id long, score long, id long")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= positives)
    chosen = written(ranked.groupBy("anchor_id").agg(F.collect_list("score").alias("first")), "first-positives")

    def keys(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[bytes] = []
        if left.num_rows and right.num_rows:
            block = Block(left, right)
            first = dict(zip(left.column("anchor_id").to_pylist(), left.column("first").to_pylist()))
            found = list(_keys_of(block, first, negatives, least))
        return pa.table({"key": pa.array(found, pa.binary())})

    asked = anchors.join(chosen, "anchor_id")
    packed = dealt(asked).groupBy("a", "g").cogroup(by_row.groupBy("a", "g")).applyInArrow(keys, "key binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = packed.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(parts, lambda k: zlib.crc32(k[:8]))
    mined = ordered.mapPartitions(lambda it: windows((k for k, _ in it), positives, negatives, least))
    return spark.createDataFrame(mined, _OUT, verifySchema=False)

"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into 32 segments of two bits; its embedding is the vector
of the segments' bit counts. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints, so fingerprints within
``max_bits`` stay within ``max_bits`` in the embedding too. Grid: the segments
are dealt over ``max_bits + 3`` blocks; two embeddings at distance ``max_bits``
agree in at least three blocks, so each triple of blocks is one grid, and pairs
that share a cell of a grid are candidates. They are filtered by the Manhattan
distance (the lower bound) and then verified exactly. Equal fingerprints are one
point from the start. A cell with more than ``hot_cell`` points is cut by the same
rule over the segments outside its grid: these are dealt over blocks again, and again
three of them agree. Cells that are full even then hold near copies in such numbers
that they can not be paired: they are linked through shared neighbours (see
``_hub_links``), a form whose rows grow with the points and not with their square.

Defined results: null and blank texts have fingerprint zero and link like any
other; a null id is a document that can not be a component's name unless all ids
of the component are null; repeated rows come out as often as they came in.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import require, written

MAX_BITS = 3
SHINGLE = 3
SEED = 42
HOT_CELL = 512
SEGMENTS = 32
_CHUNK = 1 << 16


def _bit_sums(hashes: list[int]) -> np.ndarray:
    h = np.array(hashes, dtype=np.uint64)
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else iter([words])
    hash_of, sums, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    while part := [hash_of(b" ".join(g), SEED) for g in itertools.islice(grams, _CHUNK)]:
        sums += _bit_sums(part)
        n += len(part)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """The columns of ``docs`` but the text, and the fingerprint as a signed long."""
    require(docs, text_col)
    rest = [c for c in docs.columns if c not in (text_col, name)]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(name, T.LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_fingerprint(t, shingle) for t in batch.column(text_col).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found.view(np.int64))], names=[*rest, name])

    return docs.select(*rest, text_col).mapInArrow(of, schema)


def _popcounts(fp: Column) -> Column:
    """The embedding, two bits a segment: each holds its count 0, 1 or 2."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _manhattan(a: Column, b: Column) -> Column:
    """Between packed counts: 0 and 2 differ in the high bit, neighbours in the low bit.

    With x = a xor b a segment is 10 for |0-2|, 01 for |0-1| and 11 for |1-2|:
    low bit set counts one, high bit alone counts two.
    """
    x = a.bitwiseXOR(b)
    low = x.bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x5555555555555555))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _triples(segments: list[int], max_bits: int) -> list[int]:
    """Masks of the triples of blocks, the segments dealt over ``max_bits + 3`` blocks."""
    blocks = max_bits + 3
    own = [sum(3 << (2 * s) for s in segments[b * len(segments) // blocks : (b + 1) * len(segments) // blocks]) for b in range(blocks)]
    return [sum(c) for c in itertools.combinations(own, 3)]


def _grids(max_bits: int) -> list[int]:
    return _triples(list(range(SEGMENTS)), max_bits)


def _finer(spark: SparkSession, max_bits: int) -> DataFrame:
    """mask, finer: each grid and those that cut its cells further; 400 rows for three bits."""
    rows = []
    for mask in _grids(max_bits):
        outside = [s for s in range(SEGMENTS) if not mask >> (2 * s) & 3]
        rows += [(_signed(mask), _signed(mask | m)) for m in _triples(outside, max_bits)]
    return spark.createDataFrame(rows, "mask long, finer long")


def _sized(cells: DataFrame, name: str) -> DataFrame:
    """fp, v, mask with the number of points of the cell; cells of one point go."""
    cells = cells.withColumn("cell", F.col("v").bitwiseAND(F.col("mask")))
    size = cells.groupBy("mask", "cell").agg(F.count("*").alias("n")).where("n > 1")
    return written(cells.join(size, ["mask", "cell"]), name)


def _near(cells: DataFrame, max_bits: int) -> DataFrame:
    """Pairs a < b of one cell within ``max_bits``."""
    a, b = cells.alias("a"), cells.alias("b")
    near = a.join(b, (F.col("a.mask") == F.col("b.mask")) & (F.col("a.cell") == F.col("b.cell"))
                  & (F.col("a.fp") < F.col("b.fp"))
                  & (_manhattan(F.col("a.v"), F.col("b.v")) <= max_bits)
                  & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits))
    return near.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _hub_links(points: DataFrame, max_bits: int) -> DataFrame:
    """Links among ``points`` through hubs, for cells too full to pair.

    Two fingerprints within ``max_bits`` have a value within half of the bits of the
    one and the other half of the other. Each point sends itself to all values within
    the first half (as owner) and the second (as guest). All guests of a value that
    has an owner are within ``max_bits`` of that owner, so the value may stand for it
    in the graph. Rows: a constant number for each point.
    """
    within = lambda bits: [sum(1 << i for i in c) for k in range(bits + 1) for c in itertools.combinations(range(64), k)]
    one, two = within(max_bits // 2), within(max_bits - max_bits // 2)
    ball = lambda masks: F.explode(F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))).alias("hub")
    owners = points.select("fp", ball(one))
    wanted = owners.groupBy("hub").agg(F.min("fp").alias("owner"))
    guests = points.select("fp", ball(two)).join(wanted, "hub")
    return guests.where(F.col("fp") != F.col("owner")).select(
        F.least("fp", "owner").alias("a"), F.greatest("fp", "owner").alias("b")).distinct()


def links(points: DataFrame, max_bits: int = MAX_BITS, hot_cell: int = HOT_CELL) -> DataFrame:
    """Pairs a < b of distinct fingerprints, enough to connect all within ``max_bits``.

    Every pair that shares a cell, or a finer one of a full cell, of at most ``hot_cell``
    points is there itself; points of fuller cells are joined by a chain of verified links.
    """
    masks = F.explode(F.array(*[F.lit(_signed(m)) for m in _grids(max_bits)])).alias("mask")
    coarse = _sized(points.select("fp", _popcounts(F.col("fp")).alias("v"), masks), "cells")
    full = coarse.where(F.col("n") > hot_cell).select("fp", "v", "mask").join(F.broadcast(_finer(points.sparkSession, max_bits)), "mask")
    fine = _sized(full.select("fp", "v", F.col("finer").alias("mask")), "fine-cells")
    pairs = [_near(c.where(F.col("n") <= hot_cell), max_bits) for c in (coarse, fine)]
    hot = fine.where(F.col("n") > hot_cell).select("fp").distinct()
    return pairs[0].union(pairs[1]).union(_hub_links(hot, max_bits)).distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); root is the least node reached.

    Large-star and small-star rounds in turn until a round changes nothing; each
    round is written to the shared folder.
    """
    state = written(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "stars")
    mark = None
    for _ in range(max_rounds):
        both = state.union(state.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("u != v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u"))
        state = written(small.where("u != v").distinct(), "stars")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("v").alias("node"), F.col("u").alias("root")).union(state.select("u", "u").distinct())


def components(prints: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", max_bits: int = MAX_BITS, hot_cell: int = HOT_CELL) -> DataFrame:
    """``prints`` with component_id: the least id among all reachable by links."""
    points = written(prints.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least_id")), "points")
    roots = connected(links(points.select("fp"), max_bits, hot_cell))
    named = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = named.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(by_print, prints[fp_col] == by_print["_fp"]).drop("_fp")


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("body"))
    return written(fingerprints(own, "body"), "prints")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """id, fp and component_id of every row."""
    require(docs, id_col, text_col)
    named = components(_prints(docs, id_col, text_col), "id", max_bits=max_bits)
    return named.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each near-duplicate group, in the columns of ``docs``.

    The least id of the group stays (a null id only where there is no other; of
    different texts under one id the one with the least hash), and one row of it.
    """
    require(docs, id_col, text_col)
    own = docs.columns
    named = components(_prints(docs, id_col, text_col), "id", max_bits=max_bits)
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("k"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    kept = rows.alias("d").join(chosen.select(F.col("k.id").alias("id"), F.col("k.text_hash").alias("text_hash")).alias("c"),
                                F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.text_hash") == F.col("c.text_hash")), "left_semi")
    return kept.dropDuplicates(["id", "text_hash"]).select(*[F.col(f"row.`{c}`").alias(c) for c in own])

"""Near-duplicates by five-word shingles and Jaccard similarity.

A text is the set of its five-word shingles (lower case, one shingle for a shorter
text). Texts with equal sets are one point. Each point has ``BANDS`` keys of ``ROWS``
minimum hashes; points that share a key are candidates, and a link is a candidate
pair whose sets have a Jaccard similarity of ``SIMILARITY`` or more. At 0.8 a pair
shares a key with a chance of 1 - (1 - 0.8**6)**24 = 0.9993. Keys held by more than
``FULL`` points pair none: their points get ``FINER_BANDS`` longer keys of
``FINER_ROWS`` minimum hashes, which find a pair at 0.8 with a chance of
1 - (1 - 0.8**12)**100 = 0.9992.

Points of longer keys that are full as well belong to a family (pages of one template,
near copies). Each is compared with its key's least point and with its next neighbours;
all other pairs of a family are searched exactly, by what sets them apart from the
family. The shingles of half of ``SAMPLE`` members are the common set C; the difference
of a point, x ^ C, decides its distances, as |x ^ y| = |(x ^ C) ^ (y ^ C)|. With r =
(1 - s) / (1 + s) a pair is similar if |x ^ y| <= r (|x| + |y|), so with the excess
e = |x ^ C| - r |x|:

* points with e_x + e_y <= 0 are similar, and so are both to the point of least excess:
  each point is compared with that one;
* all others must share (e_x + e_y) / 2 or more of their differences. In an order that
  puts the rare ones first, some shared one is among the first |x ^ C| - t + 1 of each,
  which an equi-join finds, by classes of excess. Differences that one point alone has
  are in no pair and go.

So a family of texts that differ from their template each in their own way gives no
candidates at all, and rows grow with the points. What still costs a product are points
of a family that are close to the limit and share the same rare differences.

``keep_one`` can link by SimHash fingerprints as well (``max_bits``): then a group is what
is connected by links of either kind.

Defined results: null and blank texts are equal; of each group the least id stays, as
in ``simhash.keep_one``. Sets are compared by 32-bit hashes of the shingles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import require, written
from . import simhash
from .simhash import SEED, connected

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
FINER_BANDS, FINER_ROWS = 100, 12
FULL = 32
NEXT = 2
#: Members of a family whose shingles show what it has in common.
SAMPLE = 64
_CHUNK = 2048


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes in order; a blank text has the one of no words."""
    words = (text or "").encode("utf-8").lower().split()
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else iter([words])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64))


@functools.cache
def _mixers(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    factors, terms = np.random.default_rng(SEED).integers(0, 1 << 64, (2, bands * rows), dtype=np.uint64)
    return factors | np.uint64(1), terms


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key a band, of its number and its minimum hashes."""
    factors, terms = _mixers(bands, rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), _CHUNK):
        mixed = hashes[i : i + _CHUNK, None] * factors + terms
        least = np.minimum(least, mixed.min(axis=0))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(least.reshape(bands, rows))], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _prints(docs: DataFrame, id_col: str, text_col: str, fingerprint: bool = False) -> DataFrame:
    """id, text_hash, point, keys and the set of every row; its SimHash fingerprint if asked for, else null."""
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("body"))
    schema = T.StructType([*own.schema.fields[:2], T.StructField("point", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("grams", T.BinaryType()), T.StructField("fp", T.LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, keys, grams, prints = [], [], [], []
            for text in batch.column("body").to_pylist():
                h = shingle_hashes(text)
                points.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                keys.append(band_keys(h))
                grams.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes())
                prints.append(simhash.text_fingerprint(text) if fingerprint else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(points, np.uint64).view(np.int64)),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(grams, pa.binary()),
                 pa.array([simhash._signed(p) if fingerprint else None for p in prints], pa.int64())], names=schema.names)

    return written(own.mapInArrow(of, schema), "prints")


def _cells(points: DataFrame, name: str) -> DataFrame:
    """point, size, key, the number of points that hold the key and the least of them (point, size); keys of one point go."""
    cells = points.select("point", "size", F.explode("keys").alias("key"))
    held = cells.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("point", "size")).alias("least")).where("n > 1")
    return written(cells.join(held, "key"), name)


def _fit(a: str, b: str, similarity: float) -> Column:
    """Sets of these sizes can be as similar as asked."""
    return F.least(F.col(a), F.col(b)) >= similarity * F.greatest(F.col(a), F.col(b))


def _pairs(cells: DataFrame, families: DataFrame, similarity: float) -> DataFrame:
    """All pairs of a key but those of one family, which are searched by their differences."""
    own = cells.join(families, "point", "left")
    apart = F.expr("x.point < y.point and (x.family is null or y.family is null or x.family <> y.family)")
    both = own.alias("x").join(own.alias("y"), "key").where(apart & _fit("x.size", "y.size", similarity))
    return both.select(F.col("x.point").alias("a"), F.col("y.point").alias("b"))


def _finer_keys(sets: DataFrame) -> DataFrame:
    """point and its longer keys, of the hashes in ``grams``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = (np.frombuffer(g.as_py(), np.uint32).astype(np.uint64) for g in batch.column("grams"))
            keys = [band_keys(h * np.uint64(0x9E3779B97F4A7C15), FINER_BANDS, FINER_ROWS) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("size"), pa.array(keys, pa.list_(pa.int64()))], names=["point", "size", "keys"])

    return sets.mapInArrow(of, "point long, size long, keys array<long>")


def _neighbours(full: DataFrame, similarity: float) -> DataFrame:
    """Pairs a < b of each point of a key with the key's least and next points."""
    # neighbours within one of many ranges of the cell, so that no cell is sorted in one task
    part = F.xxhash64("point", "key", F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF)) % F.ceil(F.col("n") / 256)
    order = Window.partitionBy("key", "part").orderBy(F.xxhash64("point", "key"))
    following = [F.lead(F.struct("point", "size"), k).over(order) for k in range(1, NEXT + 1)]
    near = full.withColumn("part", part).withColumns({f"next_{k}": c for k, c in enumerate(following)})
    near = near.select("point", "size", F.explode(F.array("least", *[f"next_{k}" for k in range(NEXT)])).alias("other")).where(
        F.expr("other is not null and other.point <> point") & _fit("size", "other.size", similarity))
    return near.select(F.least("point", "other.point").alias("a"), F.greatest("point", "other.point").alias("b"))


def _common(members: DataFrame) -> DataFrame:
    """family and the shingles that half of a sample of its members have."""
    some = members.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("point"), "point"))).where(F.col("r") <= SAMPLE)

    def of(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(g, np.uint32) for g in table.column("grams").to_pylist()]
        grams, n = np.unique(np.concatenate(sets), return_counts=True)
        return pa.table({"family": table.column("family").slice(0, 1), "common": pa.array([grams[2 * n >= len(sets)].tobytes()], pa.binary())})

    return some.select("family", "grams").groupBy("family").applyInArrow(of, "family long, common binary")


def _differences(members: DataFrame, common: DataFrame, ratio: float) -> DataFrame:
    """family, point, d (differences from the common set), excess and the differences of every member."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart, excess = [], []
            for x, c in zip(batch.column("grams"), batch.column("common")):
                own = np.frombuffer(x.as_py(), np.uint32)
                apart.append(np.setxor1d(own, np.frombuffer(c.as_py(), np.uint32), assume_unique=True).astype(np.int64))
                excess.append(len(apart[-1]) - ratio * len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("family"), batch.column("point"), pa.array([len(x) for x in apart], pa.int64()), pa.array(excess, pa.float64()),
                 pa.array(apart, pa.list_(pa.int64()))], names=["family", "point", "d", "excess", "tokens"])

    return members.join(common, "family").mapInArrow(of, "family long, point long, d long, excess double, tokens array<long>")


def _level(excess: Column) -> Column:
    """Classes of excess that double in width: none, below 8, below 24, ..."""
    return F.when(excess <= 0, 0).otherwise(1 + F.floor(F.log2(1 + excess / 8))).cast("int")


def _family_pairs(families: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a < b of points of one family, not yet linked, that can be similar: none that is similar is left out."""
    ratio = (1 - similarity) / (1 + similarity)
    members = written(families.join(sets, "point"), "families")
    apart = written(_differences(members, _common(members), ratio), "differences").withColumn("level", _level(F.col("excess")))
    centres = apart.groupBy("family").agg(F.min(F.struct("excess", "point")).alias("centre"), F.collect_set("level").alias("levels"))
    placed = apart.join(centres, "family").join(roots.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
    placed = placed.select("family", "point", "root", "d", "excess", "level", "levels", F.col("centre.point").alias("centre"), F.col("centre.excess").alias("least"), "tokens")
    placed = written(placed, "placed")
    near = placed.where("point <> centre").select(F.least("point", "centre").alias("a"), F.greatest("point", "centre").alias("b"))
    tokens = placed.drop("tokens", "centre").join(placed.select("point", F.explode("tokens").alias("token")), "point")
    several = tokens.groupBy("family", "token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(several, ["family", "token"])
    own = Window.partitionBy("family", "point")
    at = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token"))  # those of no other point come first
    ordered = shared.withColumn("at", at)

    def fits(other: Column) -> Column:
        lowest = F.when(other == 0, F.col("least")).otherwise(8 * (F.pow(F.lit(2.0), other - 1) - 1))
        need = F.greatest(F.lit(1.0), F.ceil((F.col("excess") + lowest) / 2 - 1e-6))
        return ((F.col("level") > 0) | (other > 0)) & (F.col("at") <= F.col("d") - need + 1)

    met = written(ordered.select("family", "token", "point", "root", "level", F.explode(F.filter("levels", fits)).alias("other")), "met")
    low = met.where("level <= other").select("family", "token", "level", "other", F.col("point").alias("x"), F.col("root").alias("x_root"))
    high = met.where("level >= other").select("family", "token", F.col("other").alias("level"), F.col("level").alias("other"), F.col("point").alias("y"), F.col("root").alias("y_root"))
    both = low.join(high, ["family", "token", "level", "other"]).where("x_root <> y_root and (level <> other or x < y)")
    return near.union(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs whose sets are as similar as asked."""
    both = pairs.distinct().join(sets.select(F.col("point").alias("a"), F.col("grams").alias("of_a")), "a").join(
        sets.select(F.col("point").alias("b"), F.col("grams").alias("of_b")), "b").select("a", "b", "of_a", "of_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [jaccard(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)) >= similarity
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    return written(both.mapInArrow(check, "a long, b long"), "links")


def links(prints: DataFrame, similarity: float = SIMILARITY, full: int = FULL) -> DataFrame:
    """Pairs a < b whose sets are as similar as asked, enough to connect all that share a key."""
    size = F.length("grams").cast("long").alias("size")
    cells = _cells(prints.groupBy("point").agg(F.first("keys").alias("keys"), F.first(size).alias("size")), "cells")
    sets = written(prints.join(cells.select("point").distinct(), "point", "left_semi").groupBy("point").agg(F.first("grams").alias("grams")).select("point", "grams", size), "sets")
    crowded = cells.where(F.col("n") > full).select("point").distinct()
    finer = _cells(_finer_keys(sets.join(crowded, "point", "left_semi")), "finer-cells")
    hot = finer.where(F.col("n") > full)
    families = connected(hot.select(F.col("point").alias("a"), F.col("least.point").alias("b"))).select(F.col("node").alias("point"), F.col("root").alias("family"))
    some = [_pairs(c.where(F.col("n") <= full), families, similarity) for c in (cells, finer)]
    near = _similar(some[0].union(some[1]).union(_neighbours(hot, similarity)), sets, similarity)
    roots = connected(near.join(families.select(F.col("point").alias("a")), "a", "left_semi"))
    return near.union(_similar(_family_pairs(families, roots, sets, similarity), sets, similarity))


def fingerprint_links(prints: DataFrame, max_bits: int = simhash.MAX_BITS) -> DataFrame:
    """Pairs a < b of points, enough to connect all whose fingerprints are linked at ``max_bits``."""
    held = written(prints.select("point", "fp").distinct(), "fingerprints")
    roots = connected(simhash.links(written(held.select("fp").distinct(), "points"), max_bits))
    named = held.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("point", F.coalesce("root", "fp").alias("root"))
    several = named.groupBy("root").agg(F.min("point").alias("a"), F.max("point").alias("last")).where("a <> last").select("root", "a")
    return written(named.join(several, "root").where("point <> a").select("a", F.col("point").alias("b")), "links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, max_bits: int | None = None) -> DataFrame:
    """One document of each group of linked texts, in the columns of ``docs``.

    With ``max_bits``, texts whose SimHash fingerprints differ in no more bits are linked too.
    """
    require(docs, id_col, text_col)
    own = docs.columns
    prints = _prints(docs, id_col, text_col, max_bits is not None)
    found = links(prints, similarity)
    roots = connected(found if max_bits is None else found.union(fingerprint_links(prints, max_bits)))
    named = prints.select("id", "text_hash", "point").join(roots.withColumnRenamed("node", "point"), "point", "left")
    chosen = named.groupBy(F.coalesce("root", "point").alias("root")).agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("k"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    kept = rows.alias("d").join(chosen.select(F.col("k.id").alias("id"), F.col("k.text_hash").alias("text_hash")).alias("c"),
                                F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.text_hash") == F.col("c.text_hash")), "left_semi")
    return kept.dropDuplicates(["id", "text_hash"]).select(*[F.col(f"row.`{c}`").alias(c) for c in own])

"""Token counts, token files, language-model scores and mixing."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracemill.llm import context_tree as ct
from tracemill.llm import mixing as mx
from tracemill.llm import token_counts as tc
from tracemill.llm import token_files as tf

P = pytest.importorskip("public_tokenizers")
PIECES = [" ", "  ", "a", "B", "\n", "\t", "▁", "é", ".", "<s>", "'s", "\u00a0", "\u3000", "12", "<|endoftext|>", " foo", " foo.", " été", " Über,", "\x00", "中", "word", "²", ",", "\r\n"]


def _texts(r, n):
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(14))) for _ in range(n)]


def _plain(r, n):
    """Lines of words, with blank lines here and there."""
    words = ["a", "river", "Été", "it's", "12", "x.", "(so)", "<b>", "…", "don't,", "naïve"]
    return ["".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "\n\n"]) for _ in range(r.randrange(12))) + r.choice(["", "end"]) for _ in range(n)]


def test_counts_equal_the_library(spark, make_docs, odd_docs, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    r = random.Random(1)
    for most in (1, 5):
        for t in _texts(r, 800):
            parts = tc.pieces(t, most)
            assert " ".join(parts) == t and sum(len(model.encode(p)) for p in parts) == len(model.encode(t))
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate([*_texts(r, 30), "word " * 30_000, None, ""])])
    for x in tc.token_counts(docs.select("doc_id", "text", "lang"), tc.sentencepiece_counter(P.path("piece_bpe_32k.model"))).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert (x.n_bytes, x.n_tokens) == (len((x.text or "").encode()), len(model.encode(x.text or "")))
        assert x.over_limit == (x.n_tokens > 4096)
    assert tc.token_counts(odd_docs, tc.sentencepiece_counter(P.path("piece_bpe_32k.model"))).count() == odd_docs.count()
    assert tc.token_counts(odd_docs.limit(0), tc.sentencepiece_counter(P.path("piece_bpe_32k.model"))).count() == 0


def _ids(encode, texts):
    out = []
    for n, ids, lengths in encode(pa.array(texts), 50_000):
        cuts = np.cumsum(lengths)
        assert len(lengths) == n and cuts[-1] == len(ids) and (ids[cuts - 1] == 50_000).all()
        out += [x[:-1].tolist() for x in np.split(ids, cuts[:-1])]
    return out


def test_ids_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model, r = Tokenizer.from_file(path), random.Random(2)
    for entries in (20, 100_000):  # a small memo turns over all the time
        encode = tf.ByteEncoder(path, entries)
        for _ in range(60):
            texts = [*_texts(r, 20), *_plain(r, 20)]
            assert _ids(encode, texts) == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tf, "GROUP_BYTES", 64)
    texts = [*_texts(r, 200), *_plain(r, 200)]
    assert _ids(encode, texts) == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, make_docs, odd_docs):
    from tokenizers import Tokenizer

    model, r = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(3)
    texts = {i: "".join(_texts(r, r.randrange(12))) for i in r.sample(range(1000), 80)}
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()]).repartition(3)
    manifest = tf.write_tokens(docs, tf.byte_encoder(P.path("byte_bpe_50k.json")), length=16).cache()
    got = {x.doc_id: x for x in tf.read_documents(manifest).collect()}
    start, stream = 0, []
    for i in sorted(texts):
        ids = [*model.encode(texts[i], add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start, stream = start + len(ids), stream + ids
    files, read = tf.TokenFiles(manifest), []
    for k in range(len(files)):
        ids, bits = files[k]
        assert len(ids) == 16 and len(bits) == 2 and not ids.flags.owndata and not bits.flags.owndata  # views
        read += ids[tf.mask_of(bits, 16) == 1].tolist()
    assert read == stream
    one = tf.TokenFiles(tf.write_tokens(make_docs([(1, " ".join(texts.values()) * 20, "en", "s")]), tf.byte_encoder(P.path("byte_bpe_50k.json")), length=8))
    ids = [*model.encode(" ".join(texts.values()) * 20, add_special_tokens=False).ids, 0]
    assert len(one) > 3 * tf.BATCH_SEQUENCES  # several batches of one shard, in any order
    for k in r.sample(range(len(one)), 60):
        part = ids[8 * k : 8 * k + 8]
        assert one[k][0].tolist() == part + [0] * (8 - len(part)) and tf.mask_of(one[k][1], 8).sum() == len(part)
    with pytest.raises(IndexError):
        one[len(one)]
    load = tf.byte_encoder(P.path("byte_bpe_50k.json"))
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    whole = tf.read_documents(tf.write_tokens(named, load, shards=60), "string")
    assert whole.rdd.getNumPartitions() >= 50  # a task for each shard
    by_name = sorted(whole.collect(), key=lambda x: x.start)
    assert [x.doc_id for x in by_name] == sorted(f"d{i}" for i in texts)
    assert [x.start for x in by_name] == [0, *np.cumsum([x.n_tokens for x in by_name])[:-1].tolist()]
    assert tf.read_documents(tf.write_tokens(odd_docs, load)).count() == odd_docs.count()
    assert tf.read_documents(tf.write_tokens(odd_docs.limit(0), load)).count() == 0


def _kt(zeros, ones):
    p = 1.0
    for i in range(zeros):
        p *= (i + 0.5) / (i + 1)
    for i in range(ones):
        p *= (i + 0.5) / (zeros + i + 1)
    return p


class _SlowTree:
    """Context-tree weighting of one bit decision, straight from the definition."""

    def __init__(self, seen, depth):  # seen: (context, bit), most recent byte first
        self.seen, self.depth = seen, depth

    def counts(self, context):
        bits = [b for c, b in self.seen if c[: len(context)] == context]
        return bits.count(0), bits.count(1)

    def weighted(self, context):
        own = _kt(*self.counts(context))
        if len(context) == self.depth:
            return own
        children = {c[: len(context) + 1] for c, _ in self.seen if c[: len(context)] == context}
        product = math.prod(self.weighted(c) for c in children)
        return 0.5 * own + 0.5 * product

    def chance(self, context, bit, at=0):
        here = context[:at]
        zeros, ones = self.counts(here)
        kt = ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
        if at == self.depth:
            return kt
        own = _kt(zeros, ones)
        children = {c[: at + 1] for c, _ in self.seen if c[:at] == here}
        product = math.prod(self.weighted(c) for c in children)
        w = own / (own + product)
        return w * kt + (1 - w) * self.chance(context, bit, at + 1)


def test_scores_by_definition(spark, make_docs):
    texts = {1: "abab", 2: "Abba", 3: "", 4: None, 5: "ba", 6: "cab"}
    depth, held = 2, {5, 6}
    seen = {}
    pad = bytes([255])

    def steps(text):
        data = pad * depth + (text or "").lower().encode() + pad
        for i in range(depth, len(data)):
            context = tuple(data[i - 1 - d] for d in range(depth))
            for b in range(8):
                yield context, (1 << b) | (data[i] >> (8 - b)), (data[i] >> (7 - b)) & 1

    for i, t in texts.items():
        if i not in held:
            for context, node, bit in steps(t):
                seen.setdefault(node, []).append((context, bit))
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()])
    for x in ct.score_texts(docs, F.col("doc_id").isin(list(held)), depth=depth).collect():
        want = sum(math.log10(_SlowTree(seen.get(node, []), depth).chance(context, bit)) for context, node, bit in steps(texts[x.doc_id]))
        assert x.score == pytest.approx(want, rel=1e-5)
        assert x.bits_per_byte == pytest.approx(-want / math.log10(2) / (len(texts[x.doc_id] or "") + 1), rel=1e-5)
        words = (texts[x.doc_id] or "").lower().split()
        known = {"abab": 1, "abba": 1}
        n, v = 6, 3  # two words and four ends
        assert (x.n_tokens, x.train_tokens, x.n_known) == (len(words) + 1, n, 1 + sum(w in known for w in words))
        assert x.base_score == pytest.approx(sum(math.log10((known.get(w, 0) + 1) / (n + v + 1)) for w in words) + math.log10(5 / (n + v + 1)))


def test_scores_do_not_hang_on_buckets(spark, make_docs, prose):
    r = random.Random(4)
    docs = make_docs([(i, prose(r.randrange(80), r), "en", "s") for i in range(60)]).repartition(4).cache()
    held = ct.held_out(F.col("doc_id"))
    one = {x.doc_id: (x.score, x.base_score, x.n_known) for x in ct.score_texts(docs, held).collect()}
    many = {x.doc_id: (x.score, x.base_score, x.n_known) for x in ct.score_texts(docs, held, bucket_bytes=2000).collect()}
    assert one.keys() == many.keys()
    for i in one:
        assert one[i] == pytest.approx(many[i], rel=1e-6)


def test_recall_by_definition(monkeypatch):
    monkeypatch.setattr(ct, "_RECALLED_AT_ONCE", 40)
    monkeypatch.setattr(ct, "RECALL_BYTES", 30)
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(n)).encode() for n in (25, 0, 1, 29, 30, 100)]
    logs = np.log10([r.uniform(0.1, 0.9) for t in texts for _ in range(len(t) + 1)])
    recall = {1: 5.0, 3: 2.0}
    want = []
    for t in texts:
        data = b"\xff" * 3 + t + b"\xff"
        for i in range(len(t) + 1):
            p = 10 ** logs[len(want)]
            for k, weight in recall.items():
                before = [data[j + 3] for j in range(i // 30 * 30, i) if data[j + 3 - k : j + 3] == data[i + 3 - k : i + 3]]
                p = (before.count(data[i + 3]) + weight * p) / (len(before) + weight)
            want.append(math.log10(p))
    assert ct._recalled(texts, logs, recall) == pytest.approx(want, rel=1e-9)
    assert ct._recalled(texts, logs, {}) is logs and len(ct._recalled([], logs[:0], recall)) == 0


@pytest.mark.parametrize("recall", [ct.RECALL, {2: 3.0, 9: 1.0, 17: 4.0}, {8: 2.0}])
def test_recall_of_windows_that_begin_alike(monkeypatch, recall):
    monkeypatch.setattr(ct, "_RECALLED_AT_ONCE", 70)
    monkeypatch.setattr(ct, "RECALL_BYTES", 30)
    r = random.Random(9)
    deepest = max(recall)
    texts = [b"", b"abcdefghijklmnopqrstu" * 7, *(bytes(r.choice(s) for _ in range(90)) for s in (b"a", b"ab", b"abcdef"))]
    logs = np.log10([r.uniform(0.1, 0.9) for t in texts for _ in range(len(t) + 1)])
    want = []
    for t in texts:
        data = b"\xff" * deepest + t + b"\xff"
        for i in range(deepest, len(data)):
            p = 10 ** logs[len(want)]
            for k in sorted(recall):
                before = [data[j] for j in range((i - deepest) // 30 * 30 + deepest, i) if data[j - k : j] == data[i - k : i]]
                p = (before.count(data[i]) + recall[k] * p) / (len(before) + recall[k])
            want.append(math.log10(p))
    assert ct._recalled(texts, logs, recall) == pytest.approx(want, rel=1e-9)


def test_recall_looks_at_repeated_places_only(monkeypatch, prose):
    r = random.Random(10)
    texts = [prose(400, r).encode() for _ in range(20)]
    n, sorted_, sort = sum(len(t) + 1 for t in texts), [], np.sort
    monkeypatch.setattr(np, "sort", lambda a, *args, **more: sorted_.append(len(a)) or sort(a, *args, **more))
    unlike = bytes(range(128)) + bytes(range(127, -1, -1))  # no three bytes stand in it twice
    ct._recalled([unlike], np.full(257, -1.0), ct.RECALL)
    assert sum(sorted_) == 2 * 257  # 6 * 257 when each order looked at all places
    sorted_.clear()
    ct._recalled(texts, np.full(n, -1.0), ct.RECALL)
    assert 0 < sum(sorted_) < 5 * n


def test_words_of_a_block():
    texts = [b"", b" \t\n", b" a\x0bb\x0cc\r\n\ta  e ", b"a", "\x1cx\x1d é\x85z\xa0q a".encode(), b"\x00 \x00\x00"]
    keys, real, which, starts = ct._words(pa.array(texts, pa.large_binary()))
    got = [[int(keys[w]) for w in x if real[w]] for x in np.split(which, starts[1:])]
    assert got == [[int(np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64)) for w in t.split()] for t in texts]
    assert len(set(keys.tolist())) == len(keys)


def test_values_of_grams():
    r = np.random.default_rng(11)
    for depth in (2, 5, 6):
        known = np.unique(r.integers(0, 1 << 8 * (depth + 1), 3000))
        values, at = r.random(len(known)), r.integers(0, len(known), 150_000)
        assert (ct._told(known[at], known, values, depth) == values[at]).all()
        with pytest.raises(RuntimeError, match="not counted"):
            ct._told(np.append(known[at], known[-1] + 1), known, values, depth)
        assert len(ct._told(known[:0], known, values, depth)) == 0


def test_held_out_scores_are_not_far_below_the_words(spark):
    from tracemill.llm import queries

    held = queries.op4_context_tree_score(spark, "/root/testdata/sf0.001").where("held_out").toPandas()
    assert np.isfinite(held.score).all() and (held.score < 0).all()
    assert held.score.sum() > 1.03 * held.base_score.sum()  # 1.12 times without what texts say themselves


def test_scores_of_odd_rows(odd_docs):
    assert ct.score_texts(odd_docs, ct.held_out(F.col("doc_id"))).count() == odd_docs.count()
    assert ct.score_texts(odd_docs.limit(0), ct.held_out(F.col("doc_id"))).count() == 0


def _slow_fill(budget, children):
    """Shares of (name, weight, capacity) children, rounded down."""
    out, left = {}, budget
    todo = sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while todo:
        name, weight, capacity = todo[0]
        total = sum(c[1] for c in todo)
        if capacity * total <= weight * left:
            out[name], left = capacity, left - capacity
            todo = todo[1:]
        else:
            out.update({n: w * left // total for n, w, _ in todo})
            break
    return out


def test_fill_by_hand(spark):
    r = random.Random(5)
    rows, want = [], {}
    for p in range(40):
        kids = [(f"c{k}", r.randint(1, 5), r.choice([1, 10, 100, 1000])) for k in range(r.randint(1, 5))]
        budget = r.randint(0, sum(c[2] for c in kids))
        rows += [(p, budget, *k) for k in kids]
        want.update({(p, n): b for n, b in _slow_fill(budget, kids).items()})
    d = spark.createDataFrame(rows, "p long, budget long, name string, weight long, capacity long")
    assert {(x.p, x.name): x.budget for x in mx.fill(d, ("p",), "name").collect()} == want


def test_weights_of_any_kind(spark):
    leaves = spark.createDataFrame([(d, "en", f"s{k}", 1000) for d in "abc" for k in range(3)], "domain string, lang string, source string, tokens long")
    budgets = lambda weights, **more: {(x.domain, x.source): x.budget for x in mx.leaf_budgets(leaves, 1000, 1, spark.createDataFrame(weights, "domain string, weight double"), **more).collect()}
    got = budgets([("a", 0.7), ("b", 0.3), ("c", 0.0)])
    assert [sum(v for (d, _), v in got.items() if d == x) for x in "abc"] == [3 * 233, 300, 0]
    assert budgets([("a", 1.5), ("b", 0.5), ("c", 0.0)])["a", "s0"] == 250
    none = spark.createDataFrame([("a", "en", 0)], "domain string, lang string, weight long")  # what can not be read passes its share on
    assert [sum(v for (d, _), v in budgets([("a", 8.0)], lang_weights=none).items() if d == x) for x in "abc"] == [0, 3 * 166, 3 * 166]
    with pytest.raises(Exception, match="a weight is negative"):
        budgets([("a", -1.0)])


def test_fill_of_many_children(spark):
    r = random.Random(8)
    kids = [(f"c{k:04}", r.choice([1, 3]), r.choice([5, 50, 77, 5000])) for k in range(2000)]
    want = _slow_fill(60_000, kids)
    d = spark.createDataFrame([(0, 60_000, *k) for k in kids], "p long, budget long, name string, weight long, capacity long")
    assert {x.name: x.budget for x in mx.fill(d, ("p",), "name").collect()} == want


def test_mix_takes_prefixes(spark, make_docs, prose, monkeypatch):
    r = random.Random(6)
    docs = make_docs([(i, prose(r.randint(1, 40), r), r.choice(["en", "de"]), r.choice(["s0", "s0", "s0", "s1", "s2"])) for i in range(300)]).withColumn("domain", F.when(F.col("source") == "s2", "b").otherwise("a"))
    weights = {"domain_weights": spark.createDataFrame([("b", 3)], "domain string, weight long")}
    small = {(x["_id"], x.epoch): x.take_tokens for x in mx.select_tokens(docs, F.col("tokens") * 0.9, 3, 1, **weights).collect()}
    monkeypatch.setattr(mx, "_DIGIT_BITS", 2)
    large = {(x["_id"], x.epoch): x.take_tokens for x in mx.select_tokens(docs, F.col("tokens") * 0.9, 3, 1, **weights).collect()}
    assert small == large  # the ranges do not matter
    rows = docs.select("doc_id", "domain", "lang", "source", mx.word_tokens("text").alias("n")).collect()
    total = sum(x.n for x in rows)
    assert int(0.9 * total) - 10 <= sum(small.values()) <= int(0.9 * total)
    leaves = {}
    for x in rows:
        leaves.setdefault((x.domain, x.lang, x.source), []).append(x)
    for leaf in leaves.values():
        for epoch in (1, 2, 3):
            order = sorted(leaf, key=lambda x: (int(__import__("hashlib").md5(f"1:{epoch}:{x.doc_id}".encode()).hexdigest()[:12], 16), x.doc_id))
            taken = [small.get((x.doc_id, epoch)) for x in order]
            cut = next((i for i, t in enumerate(taken) if t is None or t < order[i].n), len(taken))
            assert all(t is None for t in taken[cut + 1 :])


def test_mix_of_odd_rows(spark, odd_docs):
    odd = odd_docs.withColumn("domain", F.lit(None).cast("string"))
    picked = mx.mixed_documents(odd, F.lit(None).cast("string"), F.col("tokens"), 2)
    assert picked.columns == odd.columns and picked.where("doc_id = 1").count() in (2, 3)
    assert mx.mixed_documents(odd.limit(0), F.lit("d"), F.col("tokens"), 2).count() == 0
    assert mx.select_tokens(odd, 0, 2).count() == 0


def test_scores_see_five_bytes_back(spark, make_docs):
    r = random.Random(6)
    text = lambda: "".join(r.choice(["axxxxa.", "bxxxxb."]) for _ in range(400))
    docs = make_docs([(i, text(), "en", "s1") for i in range(4)])
    held = ct.score_texts(docs, F.col("doc_id") == 0).where("held_out").first()
    assert held.bits_per_byte < 0.22  # one free bit in seven bytes; two with four bytes of context

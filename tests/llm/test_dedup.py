"""SimHash near-duplicates and line dedup."""

import random

import numpy as np
import xxhash

from tracemill.llm import line_dedup as ld
from tracemill.llm import minhash as mh
from tracemill.llm import simhash as sh


def _slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_hand(prose):
    r = random.Random(4)
    for n in (0, 1, 2, 3, 4, 50, 300):
        text = prose(n, r)
        assert sh.text_fingerprint(text) == _slow_fingerprint(text)


def _groups(prints):
    """Least id reachable, by all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin((prints[i][1] ^ prints[j][1]) & (1 << 64) - 1).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        least.setdefault(root(i), []).append(d)
    return {d: min(least[root(i)]) for i, (d, _) in enumerate(prints)}


def _near_prints(r, n, centres, spread):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    heart = [r.getrandbits(64) for _ in range(centres)]
    out = []
    for i in range(n):
        x = r.choice(heart)
        for _ in range(r.randrange(spread)):
            x ^= 1 << r.randrange(64)
        out.append((i, signed(x)))
    return out


def test_components_by_all_pairs(spark):
    r = random.Random(6)
    for spread, hot in ((6, 512), (4, 3), (7, 5), (6, 1)):  # low limits send cells through the finer grids and the hubs
        prints = _near_prints(r, 160, 12, spread)
        got = {x.id: x.component_id for x in sh.components(spark.createDataFrame(prints, "id long, fp long"), "id", hot_cell=hot).collect()}
        assert got == _groups(prints)


def test_embedding_bounds_hamming(spark):
    from pyspark.sql import functions as F

    r = random.Random(7)
    rows = [(a, b) for (_, a), (_, b) in zip(_near_prints(r, 300, 5, 9), _near_prints(r, 300, 5, 9))]
    d = spark.createDataFrame(rows, "a long, b long")
    worst = d.select((sh._manhattan(sh._popcounts(F.col("a")), sh._popcounts(F.col("b"))) - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).alias("d")).agg(F.max("d")).first()[0]
    assert worst <= 0


def test_keep_one(spark, make_docs, prose, odd_docs):
    r = random.Random(8)
    a, b = prose(120, r), prose(90, r)
    docs = make_docs([(5, a, "en", "s"), (3, a.upper(), "en", "t"), (9, b, "en", "s"), (9, b, "en", "s"), (1, prose(100, r), "en", "s")])
    assert sorted(x.doc_id for x in sh.keep_one(docs).collect()) == [1, 3, 9]
    kept = sh.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    named = sh.near_duplicates(odd_docs)
    assert named.count() == odd_docs.count()
    # blank texts are one group, the two spellings of the long text another
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["1", "1", "2", "5", "None"]
    assert sh.keep_one(odd_docs.limit(0)).count() == 0 and sh.near_duplicates(odd_docs.limit(0)).count() == 0


def _slow_dedup(rows):
    """Lines removed from (id, text) documents with distinct ids."""
    first, removed = {}, {}
    windows = []
    for d, text in sorted(rows):
        lines = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((text or "").split("\n"))]
        lines = [(i, x) for i, x in lines if x]
        for k in range(len(lines) - 2):
            w = tuple(x for _, x in lines[k : k + 3])
            windows.append((w, d, lines[k][0], lines[k + 2][0]))
    for w, d, lo, hi in windows:
        if w not in first:
            first[w] = (d, lo, hi)
            continue
        fd, flo, fhi = first[w]
        removed.setdefault(d, set()).update(p for p in range(lo, hi + 1) if not (fd == d and flo <= p <= fhi))
    return {d: sorted(v) for d, v in removed.items() if v}


def test_lines_by_hand(spark, make_docs):
    r = random.Random(9)
    rows = [(i, "\n".join(r.choice(["a", "b", "c ", "", "d"]) for _ in range(r.randrange(12)))) for i in range(60)]
    rows += [(100, "x\nx\nx\nx"), (101, None), (102, ""), (103, "p\nq\nr"), (104, "p\n\nq\nr\ns")]
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    got = {x.doc_id: x for x in ld.dedup_lines(docs).collect()}
    want = _slow_dedup(rows)
    for i, t in rows:
        assert got[i].removed == want.get(i, [])
        assert got[i].text == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, [])))
    assert got[100].text == "x\nx\nx" and got[104].text == "s"


def test_lines_of_long_texts(spark, make_docs):
    lines = [f"line {i}" for i in range(100_000)]
    docs = make_docs([(1, "\n".join(lines), "en", "s"), (2, "\n".join(["first", *lines, "last"]), "en", "s")])
    got = {x.doc_id: x for x in ld.dedup_lines(docs).collect()}
    assert got[1].removed == [] and got[2].text == "first\nlast" and len(got[2].removed) == len(lines)


def test_lines_of_odd_rows(odd_docs):
    out = ld.dedup_lines(odd_docs)
    assert out.count() == odd_docs.count() and out.columns == [*odd_docs.columns, "removed"]
    assert ld.dedup_lines(odd_docs.limit(0)).count() == 0


def test_hubs_of_any_radius(spark):
    for bits in (1, 2, 4):
        r = random.Random(bits)
        base = [r.getrandbits(64) for _ in range(4)]
        values = {x ^ sum(1 << i for i in r.sample(range(64), r.randrange(bits + 1))) for x in base for _ in range(8)}
        signed = [v - (1 << 64) if v >> 63 else v for v in values]
        found = {(x.a, x.b) for x in sh.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, hot_cell=1).collect()}
        root = {v: v for v in signed}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in found:
            assert bin((a ^ b) & (2**64 - 1)).count("1") <= bits
            root[top(a)] = top(b)
        assert all(top(a) == top(b) for a in signed for b in signed if bin((a ^ b) & (2**64 - 1)).count("1") <= bits)


def test_near_copies_at_five_words(spark, make_docs, odd_docs):
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, groups = [], 40
    for g in range(groups):  # one word changed: 5 of 96 shingles, similarity 0.9; four others: 0.66 at most
        text = words(100)
        near, far = list(text), list(text)
        near[50] = "changed"
        for at in (20, 35, 65, 80):
            far[at] = "changed"
        rows += [(10 * g + k, " ".join(t), "en", "s1") for k, t in enumerate((text, near, far))]
    text = words(100)
    rows += [(1000 + i, " ".join(text[:i] + ["changed"] + text[i + 1:]), "en", "s1") for i in range(2, 98)]  # a full cell
    kept = {x.doc_id for x in mh.keep_one(make_docs(rows)).collect()}
    assert kept == {10 * g + k for g in range(groups) for k in (0, 2)} | {1002}
    out = mh.keep_one(odd_docs)
    assert out.columns == odd_docs.columns and out.where("text = 'one'").count() == 1
    assert mh.keep_one(odd_docs.limit(0)).count() == 0


def test_crowded_keys_by_all_pairs(spark, make_docs, prose):
    """Copies of two texts with up to a fifth of changed words, one run of changes each: keys are full and hold many components."""
    r = random.Random(17)
    rows = []
    for base in (prose(150, r).split(), prose(110, r).split()):
        for _ in range(70):
            copy, at, n = list(base), r.randrange(80), r.choice([0, 1, 2, 9, 12, 14, 16, 20, 24])
            copy[at : at + n] = [f"new{r.randrange(10**6)}" for _ in range(n)]
            rows.append((len(rows), " ".join(copy), "en", "s"))
    prints = mh._prints(make_docs(rows), "doc_id", "text")
    sets = {x.point: set(np.frombuffer(x.grams, np.uint32).tolist()) for x in prints.collect()}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    for full in (32, 3):  # a low limit sends keys through the longer ones and their components
        found = mh.links(prints, full=full)
        assert {(x.a, x.b) for x in found.collect()} <= near
        roots = {x.node: x.root for x in sh.connected(found).collect()}
        missed = [p for p in near if roots.get(p[0], p[0]) != roots.get(p[1], p[1])]
        assert len(near) > 300 and not missed, full


def test_candidates_of_templates_grow_with_the_texts(spark, make_docs, monkeypatch):
    """Pages of one template, each with a part of its own of the same length: similar at 0.66 and 0.78, none linked."""
    counted, similar = [], mh._similar

    def counting(pairs, sets, similarity):
        counted.append(pairs.distinct().count())
        return similar(pairs, sets, similarity)

    monkeypatch.setattr(mh, "_similar", counting)
    for own in (28, 50):
        rates = []
        for n in (150, 600):
            r = random.Random(n)
            page = [f"t{r.randrange(10**9)}" for _ in range(245 - own)]
            rows = [(i, " ".join(page + [f"u{r.randrange(10**9)}" for _ in range(own)]), "en", "s") for i in range(n)]
            counted.clear()
            assert mh.links(mh._prints(make_docs(rows), "doc_id", "text")).count() == 0
            rates.append([c / n for c in counted])
        assert rates[1][1] <= 1.2 and rates[0][1] <= 1.2  # within a family
        assert rates[1][0] <= 64  # keys of at most 32 texts

"""Spelling variants, chat formatting and hard negatives against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import SF
from tracemill.llm import chat, queries
from tracemill.llm import hard_negatives as hn
from tracemill.llm import spelling as sp

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ spelling


def _slow_counts(rows, drop_every=199, least=6):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % drop_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return counts


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _slow_groups(counts, least=5):
    words = {w: n for w, n in counts.items() if n >= least}
    out = {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) <= 1 and v != w and _near(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best is not None and words[best] >= 5 * n else None, len(near))
    rows = {}
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, words[w], n_near, words[form] if form else None)
    return rows


def _edited(word, r):
    at = r.randrange(len(word))
    return r.choice([word[:at] + word[at + 1 :], word[:at] + r.choice("abcé") + word[at:], word[:at] + r.choice("xyzß") + word[at + 1 :]])


def _corpus(r, n=120):
    base = ["".join(r.choice("abcdeé") for _ in range(r.randrange(6, 11))) for _ in range(25)]
    common = base[0]
    chain = [common, _edited(common, r), common[::-1]]
    rows = []
    for i in range(n):
        words = [r.choice(base) for _ in range(30)] + [_edited(r.choice(base), r) for _ in range(15)] + [common] * 20 + [r.choice(chain)] * 2
        rows.append((i, r.choice([" ", "\n", "7", "-"]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in words)))
    return rows


def test_spelling_groups_against_all_pairs(spark):
    rows = _corpus(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in sp.spelling_groups(docs, drop_every=7).collect()}
    want = _slow_groups(_slow_counts(rows, 7))
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 5


def test_spelling_of_many_cells(spark, monkeypatch):
    """Small cells and leaves, so that words are queries of several cells."""
    r = random.Random(9)
    words = {"".join(r.choice("abcd") for _ in range(r.randrange(6, 9))) for _ in range(900)}
    words |= {_edited(w, r) for w in list(words)[:300]} | {"abcabcabcabc", "abcabcabcabd", "é" * 300, "é" * 301}
    vocabulary = spark.createDataFrame([(w, r.randrange(5, 500)) for w in sorted(words)], "word string, n long")
    monkeypatch.setattr(sp, "LEAST_STEP", 2)
    monkeypatch.setattr(sp, "CELL", 60)
    n = dict(vocabulary.collect())
    want = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) <= 1 and v != w and _near(v, w)]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = (len(near), best, n[best])
    assert {x.word: (x.n_near, x.near, x.near_n) for x in sp.near_words(vocabulary).collect()} == want


def test_spelling_of_one_leaf_of_anagrams():
    r = random.Random(4)
    words = sorted({"".join(r.sample("aaabbbcccd", 10)) for _ in range(1500)})
    words += [w[:-1] + "z" for w in words[:50]] + [w[:-1] for w in words[50:90]]
    size = np.array([len(w) for w in words])
    a, b = sp.near_pairs(words, np.flatnonzero(size == 10), np.flatnonzero(size == 10), np.flatnonzero(size == 9))
    got = sorted((words[i], words[j]) for i, j in zip(a, b))
    want = sorted((v, w) for v in words for w in words if len(w) == 10 and v != w and len(v) >= len(w) - 1 and _near(v, w))
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abXYÀß×é Ă1\n", max_size=40)), max_size=6), st.integers(1, 9))
def test_runs_and_checksums(texts, every):
    import pyarrow as pa

    got = Counter()
    for batch in sp._counted(list(range(len(texts))), pa.array(texts, pa.string()), 3, every):
        for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got[w] += n
    assert got == _slow_counts(list(enumerate(texts)), every, 3)


def test_spelling_of_odd_rows(spark, odd_docs):
    rows = [(x.doc_id, x.text) for x in odd_docs.select("doc_id", "text").collect()]
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in sp.spelling_groups(odd_docs, drop_every=199).collect()}
    assert got == _slow_groups(_slow_counts(rows))
    assert sp.spelling_groups(odd_docs.limit(0)).count() == 0


def test_spelling_of_long_texts(spark):
    rows = [(1, "letters " * 200_000), (2, ("x" * 100_000 + " ") * 6), (3, None), (4, "lettérs " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.word: (x.n, x.n_near) for x in sp.spelling_groups(docs).collect()}
    assert got == {"letters": (200_000, 1), "x" * 100_000: (6, 0), "lettérs": (30, 1)}


def test_op11_query(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in queries.QUERIES["op11_spelling_groups"](spark, SF).collect()}
    assert got == _slow_groups(_slow_counts(rows))


# ------------------------------------------------------------------ chat

_SIGNS = ["### ", "</turn>", ": ", "\\", "#", "###", "</turn", "a", " ", "\n", "é", "<|endoftext|>"]
_TEXTS = st.lists(st.sampled_from(_SIGNS), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(_TEXTS, _TEXTS), max_size=4))
def test_escapes_are_read_back(turns):
    written = "".join(chat.TURN + chat.ROLE(r) + chat.ROLE_END + chat.TEXT(t) + chat.TURN_END + "\n" for r, t in turns)
    assert chat.read_text(written) == turns
    for _, t in turns:
        assert chat.TEXT.back(chat.TEXT(t)) == t and chat.TEXT.first(chat.TEXT(t), 0) is None


def _slow_digests(rows):
    """rows: (conv, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        full = "".join(chat.TURN + chat.ROLE(r) + chat.ROLE_END + chat.TEXT(t) + chat.TURN_END + "\n" for r, t in turns)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        out[conv] = (len(turns), digest[0], len(loss), digest[1], len(full))
    return out


def _chat_rows(r):
    words = ["stone", "river", "### ", "</turn>", "\\", "é", "\n", "<|endoftext|>", "### user: "]
    rows = []
    for conv in [*range(12), None]:
        for turn in range(r.randrange(1, 6)):
            rows.append((conv, turn if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "", "a: b", None]),
                         "".join(r.choice(words) for _ in range(r.randrange(9))) if r.random() < 0.9 else None))
    rows += [(5, 1, "assistant", "twice")] * 2
    rows += [(99, k, "assistant" if k % 2 else "user", f"turn {k} " * (k % 7)) for k in range(400)]  # one conversation of most rows
    r.shuffle(rows)
    return rows


def test_chats_are_read_back(spark):
    rows = _chat_rows(random.Random(8))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("range", F.lit(1)).withColumn("start", F.lit("x"))
    pieces = chat.format_chats(turns, TOKENIZER, piece=300)
    got = {x.conv_id: tuple(x)[1:] for x in chat.chat_digests(pieces, TOKENIZER).collect()}
    want = _slow_digests(rows)
    assert {k: v for k, v in got.items() if k not in (None, 5)} == {k: v for k, v in want.items() if k not in (None, 5)}
    for k in (None, 5):  # turns alike in number and role follow a hash
        assert (got[k][0], got[k][2], got[k][4]) == (want[k][0], want[k][2], want[k][4])
    kept = pieces.orderBy("conv_id", "start").collect()
    assert sum(x.conv_id == 99 for x in kept) > 3  # the long conversation is in pieces, each where the one before ended
    ends = {}
    for x in kept:
        assert x.start == ends.get(x.conv_id, 0) and len(x.input_ids) == len(x.loss_mask) and len(x.input_ids) < 300 + 200 + 100
        ends[x.conv_id] = x.start + len(x.input_ids)


def test_learned_roles_and_reserved_ids(spark):
    turns = spark.createDataFrame([(1, 0, "user", "### user: hi</turn>"), (1, 1, "tool", "42"), (1, 2, "assistant", "ok <|endoftext|>")], "conv_id long, turn long, role string, text string")
    rows = chat.format_chats(turns, TOKENIZER, learn=("tool", "assistant")).orderBy("start").collect()
    tokens = chat.chat_tokens(TOKENIZER)
    ids, mask = (np.array([x for r in rows for x in r[c]]) for c in ("input_ids", "loss_mask"))
    assert (ids >= tokens.first).sum() == 9 and not mask[ids >= tokens.first].any()
    assert 50256 not in ids  # a special token's text is ordinary text
    assert tokens.texts(ids, [(lo, hi) for lo, hi, on in chat._segments(ids, mask, tokens.first) if on]) == ["42", "ok <|endoftext|>"]


def test_loss_mask_by_hand():
    mask = chat.loss_mask(np.array([5, 4, 3]), np.array([2, 1, 1]), np.array([4, 3, 1]), np.array([True, False, True]))
    assert mask.tolist() == [0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0]


def test_chats_of_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digests(chat.format_chats(empty, TOKENIZER), TOKENIZER).count() == 0
    long = "a long answer, " * 60_000
    one = spark.createDataFrame([("c", 0, "user", None), ("c", 1, "assistant", long)], "conv_id string, turn long, role string, text string")
    got = chat.chat_digests(chat.format_chats(one, TOKENIZER), TOKENIZER).first()
    assert tuple(got)[1:] == _slow_digests([("c", 0, "user", None), ("c", 1, "assistant", long)])["c"]


# ------------------------------------------------------------------ hard negatives


def _slow_negatives(rows, every, positives=5, negatives=5, least=80):
    rows = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, y, v in rows:
        first[i] = min(first.get(i, (y, v)), (y, v))
    out = []
    for a, (label, v) in first.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, y == label) for i, (y, w) in first.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [x for x in scored if not x[2] and least * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit)]
    return sorted(out)


_VECTORS = "vec_id long, embedding array<float>, label int"


def _mined(vectors, every, **options):
    return sorted(tuple(x) for x in hn.mine(vectors, every, **options).collect())


@pytest.mark.parametrize("blocks", [(4096, 2048), (7, 23)])
def test_negatives_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(hn, "ANCHORS", blocks[0])
    monkeypatch.setattr(hn, "ROWS", blocks[1])
    r = random.Random(6)
    values = [-1.5, -0.5, 0.0, 0.25, 0.5, 1.0]
    hot = [0.5, 0.5, 0.5, 0.25]
    rows = [(i, hot if i % 3 == 0 else [r.choice(values) for _ in range(4)], r.randrange(3)) for i in range(-20, 200)]
    rows += [(300, None, 1), (310, [None, 1.0, 1.0, 1.0], 1), (320, [math.nan, 1.0, 1.0, 1.0], 2), (330, [math.inf, 0.0, 0.0, 0.0], 0),
             (340, hot, None), (None, hot, 1), (350, [], 1), (360, [1.0], 1), (370, hot, 0), (370, hot, 0), (370, hot, 1)]
    r.shuffle(rows)
    vectors = spark.createDataFrame(rows, _VECTORS).withColumns({c: F.lit(c) for c in ("a", "g", "q", "score", "key")})
    got = _mined(vectors, 10)
    assert got == _slow_negatives([(i, y, v) for i, v, y in rows], 10) and len(got) > 100


def test_negatives_of_negative_and_equal_scores():
    keys = sorted([hn.pair_key(7, s, i, p) for s, i, p in [(5, 3, False), (5, 4, True), (5, 9, False), (4, 1, False), (3, 2, False), (0, 8, True), (0, 6, False), (-1, 5, True), (-1, 11, False)]])
    assert list(hn.windows(iter(keys))) == [(7, 4, 1, 3, 5, 5), (7, 4, 2, 9, 5, 5), (7, 4, 3, 1, 5, 4), (7, 8, 1, 6, 0, 0)]
    assert [hn.read_key(k) for k in keys][0] == (7, 5, 3, False)


def test_negatives_of_large_numbers(spark):
    rows = [(0, [3e9, 1.0], 0), (1, [3e3, 2.0], 0), (2, [2.5e3, 77.0], 1), (3, [2.9e3, -5.0], 1), (4, [0.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, _VECTORS)
    assert _mined(vectors, 10) == _slow_negatives([(i, y, np.float32(v).astype(float).tolist()) for i, v, y in rows], 10)


def test_negatives_of_empty_tables(spark):
    vectors = spark.createDataFrame([], _VECTORS)
    assert hn.mine(vectors, 10).count() == 0
    assert hn.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], _VECTORS), 10).count() == 0

"""The pipeline's stages on one small corpus, and queries of the operators."""

import corpus_pipeline
from tracemill.llm import queries


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= 2 * n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).orderBy("start").collect()
    assert len(last) == docs.count()
    at = 0
    for x in last:
        assert x.start == at
        at += x.n_tokens


def _shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def test_near_duplicates_against_all_pairs(spark):
    """What the second stage keeps of the first one's documents: the least id of each group linked at 0.8."""
    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).cache()
    rows = {x.doc_id: x for x in docs.collect()}
    sets, root = {i: _shingles(x.text) for i, x in rows.items()}, {i: i for i in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    kept = {x.doc_id: x for x in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()}
    assert set(kept) == {i for i in rows if root[i] == i} and len(kept) < len(rows)
    assert all(kept[i] == rows[i] for i in kept)


def test_near_duplicates_by_fingerprints(spark, make_docs, prose):
    """A fingerprint counts every shingle, a set each once: one passage over and over with another end is linked by the former alone."""
    from tracemill.llm import minhash, simhash

    passage = " ".join(prose(61).split()) + " "  # an odd number of shingles: no bit is a tie
    docs = make_docs([(1, passage * 99 + prose(40), "en", "s"), (2, passage * 99 + prose(40), "en", "s"), (3, prose(60), "en", "s"), (4, "", "en", "s")])
    near = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {x.doc_id for x in minhash.keep_one(docs).collect()} == {1, 2, 3, 4}
    assert {x.doc_id for x in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == {1, 3, 4}


def test_stages_on_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_oracles(spark):
    from tests.compare import SF, connection, rows

    duck = connection()
    for name, sql in queries.ORACLE_SQL.items():
        assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(sql).df()), name

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta omega river stone light water cloud house green quiet seven eight nine north south letter paper".split()


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def prose(rng):
    """Makes texts of so many words in lines of about ten words."""

    def make(n, r=rng):
        words = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + 10]) for i in range(0, n, 10))

    return make


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows], DOC)

    return make


@pytest.fixture
def odd_docs(make_docs, prose):
    """Nulls in any column, empty and blank texts, repeated rows, ties of id, extra columns with names the operators use inside."""
    from pyspark.sql import functions as F

    long = prose(80)
    rows = [(1, long, "en", "s1"), (1, long, "en", "s1"), (1, prose(60), "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (None, prose(70), "de", None),
            (4, " \n\t ", "fr", "s2"), (None, None, None, None), (5, "one", "en", "s2"), (6, long.upper(), "en", "s2")]
    docs = make_docs(rows)
    extra = ["row", "id", "_id", "_text", "h", "fp", "budget", "weight", "capacity", "n", "l", "block", "bucket"]
    return docs.withColumns({c: F.lit(c) for c in extra})

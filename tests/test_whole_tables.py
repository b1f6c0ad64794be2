"""Queries over whole tables against brute force."""

from pyspark.sql import functions as F

from tests.compare import SF
from tracemill.operators import evidence as ev
from tracemill.plans import all_queries
from tracemill.plans import source_queries as sq
from tracemill.sources.fixtures import call_edges


def _slow_depths(edges):
    calls = {}
    for m, a, b in edges:
        calls.setdefault((m, a), set()).add(b)
    found = set()
    for m, root in calls:
        depth, frontier = {root: 0}, [root]
        while frontier:
            a = frontier.pop(0)
            for b in calls.get((m, a), ()):
                if b not in depth:
                    depth[b] = depth[a] + 1
                    frontier.append(b)
        found |= {(m, root, f, n) for f, n in depth.items()}
    return found


def test_depths_of_all_modules_and_roots(spark):
    got = {tuple(x) for x in all_queries()["ev2_depths_from_roots"][0](spark, SF).collect()}
    assert got == _slow_depths([tuple(x) for x in call_edges(spark, SF).collect()])
    chain = spark.createDataFrame([(1, f"f{i}", f"f{i + 1}") for i in range(7)], "module long, caller string, callee string")
    deep = ev.depths_from_roots(chain, spark.createDataFrame([(1, "f0")], "module long, root string"))
    assert deep.agg(F.max("depth")).first()[0] == 7


def test_reports_grow_in_number(spark):
    docs = sq._reports(spark, SF).select("run_dir", "block").collect()
    assert len(docs) == len(set(docs)) and len(docs) > 20

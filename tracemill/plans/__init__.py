"""The registered queries: name -> (query over (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from . import answer_queries, corpus_queries, more_queries, report_queries, scoring_queries, source_queries, trace_queries

MODULES = [trace_queries, scoring_queries, answer_queries, report_queries, corpus_queries, source_queries, more_queries]


def all_queries() -> dict:
    return {name: pair for module in MODULES for name, pair in module.QUERIES.items()}

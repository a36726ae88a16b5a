"""Queries and SQL of this subpackage."""

from hodograph.llm import components, ivfpq, leaks, lookalike, markov, packing, runs, setjoin, topn

MODULES = [topn, markov, setjoin, ivfpq, components, runs, packing, leaks, lookalike]


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}

"""Registered queries: each runs an operator over whole tables, most with an equivalent SQL text."""

from tetrarank.workloads import evaluation, preference, retrieval, texts

MODULES = [retrieval, preference, evaluation, texts]


def all_queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

"""All registered queries and, where SQL can say the same, the statement that checks them."""

from __future__ import annotations

from docsieve.plans.registry import employment, hidden, models, reports, runs, sources, texts
from docsieve.plans.registry import classify as classify_queries

SECTIONS = (sources, texts, hidden, classify_queries, employment, models, reports, runs)


def all_queries() -> dict:
    return {name: query for section in SECTIONS for name, query in section.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for section in SECTIONS for name, sql in section.ORACLE.items()}

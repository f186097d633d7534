"""Lexicon tables (``kind, category, term, weight, ord``) and their two physical forms.

A small lexicon becomes a literal inside the row expressions and needs no shuffle. The size is checked; beyond the
bound the callers join instead.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.session import small_table

MAX_LITERAL_TERMS = 2000


class LexiconTooLarge(ValueError):
    """The lexicon exceeds what fits into a row expression."""


@dataclass(frozen=True)
class Entry:
    category: str
    term: str
    weight: float
    ord: int


def entries(lexicon: DataFrame, limit: int = MAX_LITERAL_TERMS) -> list[Entry]:
    """The entries in lexicon order, read only up to the bound."""
    rows = lexicon.select("category", "term", F.coalesce("weight", F.lit(1.0)).alias("weight"), "ord").limit(limit + 1).collect()
    if len(rows) > limit:
        raise LexiconTooLarge(f"more than {limit} terms: use the join form")
    return sorted((Entry(r.category, r.term, r.weight, r.ord) for r in rows), key=lambda e: e.ord)


def fits(lexicon: DataFrame, limit: int = MAX_LITERAL_TERMS) -> bool:
    return lexicon.select("term").limit(limit + 1).count() <= limit


def nested(entries_: list[Entry]) -> Column:
    """array<struct<category, ord, terms array<struct<term, weight>>>> as one constant."""
    grouped: dict[str, dict] = {}
    for e in entries_:
        c = grouped.setdefault(e.category, {"category": e.category, "ord": len(grouped), "terms": []})
        c["terms"].append({"term": e.term, "weight": e.weight})
    schema = "array<struct<category:string,ord:int,terms:array<struct<term:string,weight:double>>>>"
    return F.from_json(F.lit(json.dumps(list(grouped.values()))), schema)


def union_terms(lexicon: DataFrame, categories: dict[str, list[str]] | None = None, extra: list[str] | None = None) -> DataFrame:
    """``term``: distinct lower-cased terms of the chosen categories per kind, and extra ones."""
    chosen = lexicon
    if categories is not None:
        wanted = F.lit(False)
        for kind, names in categories.items():
            wanted = wanted | ((F.col("kind") == kind) & F.col("category").isin(names))
        chosen = lexicon.filter(wanted)
    terms = chosen.select(F.lower("term").alias("term"))
    if extra:
        more = small_table(lexicon.sparkSession, [(t.lower(),) for t in extra], "term string")
        terms = terms.unionByName(more)
    return terms.distinct()

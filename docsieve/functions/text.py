"""Column functions for cleaning, tokenising and measuring text.

``(?U)`` makes Java's ``\\w``, ``\\s``, ``\\d`` and ``\\b`` Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What cleaning removes, in this order.
EMAIL_TOKEN = r"(?U)(?<!\S)\S*@\S*\s?"
URL_TAIL = r"(?U)http\S+"
PHONE = r"(?U)\b(?:\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# A whitespace-delimited token that is alphanumeric once outer symbols are stripped.
PLAIN_TOKEN = r"(?U)(?<!\S)[^\p{L}\p{N}\s]*+([\p{L}\p{N}]++)[^\p{L}\p{N}\s]*+(?!\S)"
WORD = r"(?U)\w+"
LONG_WORD = r"(?U)\b\w\w+\b"
WORD_OR_SYMBOL = r"(?U)\w+|[^\w\s]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of whitespace on both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+\z", "")


def clean_text(c: Column | str) -> Column:
    t = F.lower(_col(c))
    for pattern in (EMAIL_TOKEN, URL_TAIL, PHONE):
        t = F.regexp_replace(t, pattern, "")
    return F.regexp_replace(F.translate(t, PUNCTUATION, ""), r"(?U)\d+", "")


def words(c: Column | str) -> Column:
    """Whitespace-separated tokens."""
    return F.regexp_extract_all(_col(c), F.lit(r"(?U)\S+"), F.lit(0))  # a split would compile its pattern for every text


def without(tokens: Column, stop_words: Iterable[str]) -> Column:
    stop = sorted(set(stop_words))
    if not stop:
        return tokens
    return F.filter(tokens, lambda x: ~x.isin(stop))


def tokens(c: Column | str, stop_words: Iterable[str] = ()) -> Column:
    """Split, drop stop words, join with one space."""
    return F.array_join(without(words(c), stop_words), " ")


def match_tokens(c: Column | str, stop_words: Iterable[str] = ()) -> Column:
    lowered = F.lower(F.coalesce(_col(c), F.lit("")))
    return without(F.regexp_extract_all(lowered, F.lit(PLAIN_TOKEN), F.lit(1)), stop_words)


def match_form(c: Column | str, stop_words: Iterable[str] = ()) -> Column:
    """Comparable form: lower case, alphanumeric non-stop tokens, single spaces."""
    return F.array_join(match_tokens(c, stop_words), " ")


def contiguous(tokens_: Column, n: int, starts: Column | None = None) -> Column:
    """All runs of ``n`` adjacent tokens, joined by a space; only the first ``starts`` tokens begin one.

    Each run extends the run of ``n - 1`` tokens at the same place, so the work is linear in the tokens.
    """
    if n == 1:
        return tokens_ if starts is None else F.slice(tokens_, F.lit(1), F.least(F.size(tokens_), starts))
    return _extended(contiguous(tokens_, n - 1, starts), tokens_, n, starts)


def _extended(shorter: Column, tokens_: Column, n: int, starts: Column | None) -> Column:
    """The runs of ``n`` tokens from those of ``n - 1``."""
    length = F.greatest(F.size(tokens_) - (n - 1), F.lit(0))
    length = length if starts is None else F.least(length, starts)
    return F.zip_with(F.slice(shorter, F.lit(1), length), F.slice(tokens_, F.lit(n), length), lambda a, b: F.concat(a, F.lit(" "), b))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: an explode has no common subexpressions.

    ``element_at`` knows its type; an index would derive it from all that is inside, for every row.
    """
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


def ngrams(tokens_: Column, lo: int = 1, hi: int = 3, starts: Column | None = None) -> Column:
    """All contiguous runs of ``lo`` to ``hi`` tokens, shorter runs first. Tokens and runs of each length are computed once."""

    def upwards(tokens: Column, runs: Column, n: int, kept: list[Column]) -> Column:
        kept = [*kept, runs] if n >= lo else kept
        if n >= hi:
            return F.flatten(F.array(*kept))
        return once(_extended(runs, tokens, n + 1, starts), lambda longer: upwards(tokens, longer, n + 1, kept))

    return once(tokens_, lambda t: once(contiguous(t, 1, starts), lambda runs: upwards(t, runs, 1, [])))


def long_words(c: Column | str) -> Column:
    """Tokens of at least two word characters."""
    return F.regexp_extract_all(_col(c), F.lit(LONG_WORD), F.lit(0))


def word_runs(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))


def phrase_tokens(c: Column | str) -> Column:
    """Words and single symbols, the unit of phrase matching."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_OR_SYMBOL), F.lit(0))


def token_features(c: Column | str) -> dict[str, Column]:
    t = words(c)
    n = F.size(t)
    letters = F.aggregate(t, F.lit(0), lambda acc, x: acc + F.length(x))
    return {
        "word_count": n,
        "avg_word_length": F.when(n > 0, letters / n).otherwise(F.lit(0.0)),
        "bigrams": contiguous(t, 2),
    }


def basic_features(c: Column | str) -> dict[str, Column]:
    return {"word_count": F.size(words(c)), "char_count": F.length(_col(c))}


def vocabulary_stats(c: Column | str, influential: Column | None = None) -> dict[str, Column]:
    t = words(c)
    stats = {
        "text_length": F.length(_col(c)),
        "vocabulary_diversity": F.size(F.array_distinct(t)) / F.greatest(F.lit(1), F.size(t)),
    }
    if influential is not None:
        stats["keyword_relevance"] = F.least(F.lit(1.0), F.lit(0.15) * influential)
    return stats


def clip(c: Column | str, n: int) -> Column:
    """The display form of a long text: its first ``n`` characters and an ellipsis."""
    t = _col(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two numeric arrays; NULL if either has no length."""
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)

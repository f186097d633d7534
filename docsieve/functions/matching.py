"""Regular-expression matches with offsets and context, without leaving the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import _col, once, strip

# Degree words, by family (full words, possessives, dotted abbreviations).
DEGREES = (
    r"(?U)\b(?:Bachelor|Master|PhD|Doctorate|BSc|MSc|BA|MA|MD|JD|MBA)\b",
    r"(?U)\b(?:Bachelor's|Master's|Doctoral|Graduate|Undergraduate)\b",
    r"(?U)\b(?:B\.\s?S\.|M\.\s?S\.|B\.\s?A\.|M\.\s?A\.|Ph\.\s?D\.)\b",
)
# Section headers of work experience.
EXPERIENCE_HEADERS = (
    "experience",
    "work experience",
    "employment",
    "work history",
    "professional experience",
    "career history",
)

# How a date range is written.
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_YEAR = r"(?:19|20)\d{2}"
_DASH = r"\s*[-–—]\s*"
_NOW = r"(?:Present|Current|Now)"
EMPLOYMENT_RANGE = (
    rf"(?U)\b{_YEAR}{_DASH}(?:{_YEAR}|{_NOW})\b"
    rf"|\b{_MONTH} {_YEAR}{_DASH}{_MONTH} {_YEAR}\b"
    rf"|\b{_MONTH} {_YEAR}{_DASH}{_NOW}\b"
    rf"|\b{_MONTH} {_YEAR}\s*to\s*{_MONTH} {_YEAR}\b"
)
ANY_RANGE = (
    rf"(?U)\b\d{{4}}{_DASH}\d{{4}}"
    rf"|\b{_MONTH} \d{{4}}{_DASH}{_MONTH} \d{{4}}"
    rf"|\b{_MONTH} \d{{4}}{_DASH}{_NOW}\b"
)

# Job titles, then companies, tried in order.
_ROLE = r"(?:Engineer|Manager|Director|Analyst|Administrator|Consultant|Specialist)"
JOB_TITLES = (
    r"(?U)(?:Senior|Lead|Principal|Junior|Associate)?\s*(?:Software Engineer|Developer|Data Scientist"
    r"|Manager|Director|Analyst|Administrator|Consultant|Specialist)",
    r"(?U)(?:Chief|VP|Head) of [A-Z][a-z]+(?: [A-Z][a-z]+)*+",
    rf"(?U)[A-Z][a-z]+ {_ROLE}",
)
COMPANIES = tuple(rf"(?U){word} ((?:[A-Z][a-zA-Z]*\s*){{1,3}})" for word in ("at", "with", "for"))


#: Distances of the doubling steps below; the largest exceeds the number of characters of any string.
_STEPS = [1 << k for k in range(31)]


#: Stands for a match where a text is parted; a control character, which texts hardly hold.
_MARK = "\u0001"


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of longs by doubling: n log n additions, no array grows element by element."""
    steps = F.filter(F.array(*[F.lit(d) for d in _STEPS]), lambda d: d < F.size(values))
    return F.aggregate(
        steps, values, lambda sums, d: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - d), F.lit(0).cast("bigint")))
    )


def matches(c: Column | str, pattern: str) -> Column:
    """array<struct<offset (0-based), text>> of every match, left to right.

    The parts between the matches and the matches themselves add up to the offsets. Only a text with matches is parted, and
    at a character it doesn't hold: a split by a pattern would compile that for every text.
    """
    t = _col(c)
    item = lambda m, end: F.struct((end - F.length(m)).cast("int").alias("offset"), m.alias("text"))

    def placed(found: Column) -> Column:
        marked = F.split(F.regexp_replace(t, pattern, _MARK), _MARK, -1)
        parts = F.when(F.contains(t, F.lit(_MARK)), F.split(t, pattern, -1)).otherwise(marked)
        sizes = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
        ends = once(sizes, running_sums)
        return F.when(F.size(found) > 0, F.zip_with(found, ends, item)).otherwise(F.transform(found, lambda m: item(m, F.lit(0).cast("bigint"))))

    return once(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), placed)


def around(c: Column | str, offset: Column, length: Column, left: int = 100, right: int = 100) -> Column:
    """The characters around a match, clipped to the text."""
    begin = F.greatest(F.lit(0), offset - left)
    return F.substring(_col(c), begin + 1, offset + length + right - begin)


def find_with_context(
    df: DataFrame, column: str, pattern: str, left: int = 100, right: int = 100
) -> DataFrame:
    """One row per match: ``match_no``, ``offset``, ``match`` and ``context`` next to the other columns."""
    others = [c for c in df.columns if c != column]
    hits = df.select(*others, column, F.posexplode(matches(column, pattern)).alias("match_no", "hit"))
    offset, text = F.col("hit.offset"), F.col("hit.text")
    return hits.select(
        *others,
        "match_no",
        offset.alias("offset"),
        text.alias("match"),
        around(column, offset, F.length(text), left, right).alias("context"),
    )


def tagged_matches(column: str, tag: Column, name: str, pattern: str) -> Column:
    """The matches of one pattern as array<struct<name, offset, match>>."""

    def tagged(hit: Column) -> Column:
        return F.struct(tag.alias(name), hit["offset"].alias("offset"), hit["text"].alias("match"))

    return F.transform(matches(column, pattern), tagged)


def education_contexts(df: DataFrame, column: str, patterns: Sequence[str] = DEGREES) -> DataFrame:
    """Contexts of degree words; families are searched separately, so one phrase may count twice."""
    others = [c for c in df.columns if c != column]
    families = [tagged_matches(column, F.lit(no), "pattern_no", p) for no, p in enumerate(patterns)]
    hits = df.select(*others, column, F.explode(F.flatten(F.array(*families))).alias("h"))
    context = around(column, F.col("h.offset"), F.length("h.match"))
    return hits.select(*others, "h.*", context.alias("context"))


def section_after(
    df: DataFrame, column: str, headers: Sequence[str] = EXPERIENCE_HEADERS, sep: str = "\n\n"
) -> DataFrame:
    """For every header occurrence, the text from the header to the next separator or the end."""
    others = [c for c in df.columns if c != column]
    found = [tagged_matches(column, F.lit(no), "header_no", rf"(?iU)\b\Q{h}\E\b") for no, h in enumerate(headers)]
    hits = df.select(*others, column, F.explode(F.flatten(F.array(*found))).alias("h"))
    begin = F.col("h.offset") + 1
    stop = F.expr(f"locate({sql_text(sep)}, `{column}`, h.offset + 1 + length(h.match))")
    size = F.when(stop > 0, stop - begin).otherwise(F.length(column))
    section = strip(F.substring(F.col(column), begin, size))
    return hits.select(*others, "h.header_no", "h.offset", section.alias("section")).filter("section <> ''")


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def date_ranges(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(ANY_RANGE), F.lit(0))


def first_match(c: Column | str, patterns: Sequence[str], group: int = 0) -> Column:
    """The first pattern that matches wins; NULL if none does."""
    t = _col(c)
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, group), F.lit("")) for p in patterns])


def job_title(c: Column | str) -> Column:
    return first_match(c, JOB_TITLES)


def company(c: Column | str) -> Column:
    return strip(first_match(c, COMPANIES, 1))


def whole_word(term: str) -> str:
    return r"(?U)\b" + re.sub(r"([^\w\s])", r"\\\1", term) + r"\b"


def find_terms(c: Column | str, terms: Sequence[str]) -> Column:
    """Terms found as whole words, in the given order.

    A term that ends in a symbol needs a word character after it, as the boundary rule says.
    """
    lowered = F.lower(_col(c))
    rows = F.array(*[
        F.when(lowered.contains(t.lower()) & lowered.rlike(whole_word(t.lower())), F.lit(t)) for t in terms
    ])
    return F.array_compact(rows)

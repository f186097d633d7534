"""Parsing of written date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import _col

# Month names that are understood.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
CURRENT = ("present", "current", "now")


def month_number(name: Column) -> Column:
    """1-12 for a full name, its first three letters or "sept"; NULL otherwise."""
    known = {"sept": 9}
    for i, month in enumerate(MONTHS, 1):
        known |= {month: i, month[:3]: i}
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in known.items() for v in pair]), name)


def months_between_dates(start: Column | str, end: Column | str) -> Column:
    """12 times the difference in years plus the difference in months."""
    start, end = _col(start), _col(end)
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def _point(df: DataFrame, text: str, as_of: Column, name: str) -> DataFrame:
    """A date from ``2000`` or ``jan 2000``; what is not written (month, day) is taken from ``as_of``."""
    word, year = f"{name}_word", f"{name}_year"
    read = df.withColumns({
        word: F.regexp_extract(text, r"^([a-z]+) ?\d{4}$", 1),
        year: F.nullif(F.regexp_extract(text, r"^(?:[a-z]+ ?)?(\d{4})$", 1), F.lit("")).try_cast("int"),
    })
    month = F.when(F.col(word) == "", F.month(as_of)).otherwise(month_number(F.col(word)))
    first = read.withColumn(f"{name}_first", F.make_date(F.col(year), month, F.lit(1)))
    begin = F.col(f"{name}_first")
    return first.withColumn(name, F.least(F.date_add(begin, F.dayofmonth(as_of) - 1), F.last_day(begin)))


def with_parsed_range(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    """Adds ``start_date, end_date, duration_months, is_current``; NULL dates if the range cannot be read.

    Each step is a column of its own: written as one expression, every step would be repeated where it is used.
    """
    t = F.col("_t")
    split = F.when(t.contains(" to "), F.split(t, r"\s+to\s+")).when(t.contains("-"), F.split(t, r"\s*-\s*"))
    kept = df.columns
    steps = df.withColumn("_t", F.lower(F.regexp_replace(F.trim(_col(column)), "[–—]", "-"))).withColumn("_parts", split)
    two = F.size("_parts") == 2
    steps = steps.withColumns({
        "_begin": F.when(two, F.trim(F.get("_parts", F.lit(0)))),
        "_finish": F.when(two, F.trim(F.get("_parts", F.lit(1)))),
    })
    steps = _point(_point(steps, "_begin", as_of, "_start"), "_finish", as_of, "_end")
    steps = steps.withColumn("_current", F.coalesce(F.col("_finish").isin(*CURRENT), F.lit(False)))
    steps = steps.withColumn("_end", F.when(F.col("_current"), as_of).otherwise(F.col("_end")))
    steps = steps.withColumn("_ok", F.col("_start").isNotNull() & F.col("_end").isNotNull())
    ok = F.col("_ok")
    return steps.select(
        *kept,
        F.when(ok, F.col("_start")).alias("start_date"),
        F.when(ok, F.col("_end")).alias("end_date"),
        F.when(ok, F.greatest(F.lit(0), months_between_dates("_start", "_end"))).alias("duration_months"),
        (ok & F.col("_current")).alias("is_current"),
    )

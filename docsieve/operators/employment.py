"""Employment history: from free text to records, tenure, gaps and features."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.dates import months_between_dates, with_parsed_range
from docsieve.functions.matching import EMPLOYMENT_RANGE, company, find_with_context, job_title
from docsieve.operators.ordered import next_value, position, ranged

FEATURES = (
    "average_tenure",
    "total_experience",
    "job_count",
    "job_changing_frequency",
    "has_gaps",
    "gap_count",
    "avg_gap_duration",
)
EARLIEST = datetime.date(1900, 1, 1)


def _date(value: datetime.date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def extract_employment(texts: DataFrame, as_of: datetime.date | str, column: str = "text") -> DataFrame:
    """One row per date range found in the text, with what stands around it."""
    others = [c for c in texts.columns if c != column]
    found = find_with_context(texts, column, EMPLOYMENT_RANGE)
    parsed = with_parsed_range(found, "match", _date(as_of))
    return parsed.select(
        *others,
        F.col("match_no").alias("rec_no"),
        F.col("match").alias("date_range"),
        "start_date",
        "end_date",
        "duration_months",
        "is_current",
        job_title("context").alias("job_title"),
        company("context").alias("company"),
        "context",
    )


def order_history(records: DataFrame, key: str = "doc_id", record: str = "rec_no") -> DataFrame:
    """``position``: newest start first, unknown starts last.

    No task holds a key: ranges of rows are numbered and added up. The null key is a key like others.
    """
    order = [F.desc(F.coalesce("start_date", F.lit(EARLIEST))), F.col(record)]
    placed = ranged(records.withColumn("_key", F.struct(key)), [F.col("_key"), *order])
    return position(placed, ["_key"], order, F.col("_range"), "position").drop("_key", "_range")


def with_gaps(records: DataFrame, key: str = "doc_id", record: str = "rec_no") -> DataFrame:
    """Every record with ``next_start`` and ``gap_months``: from its end to the start of the record that ends next.

    Records without dates stay and take no part; they form groups of their own, spread by record.
    """
    dated = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    order = [F.col("end_date"), -F.datediff("start_date", F.lit(EARLIEST)), F.col(record)]
    bucket = F.when(F.col("_dated"), F.year("end_date")).otherwise(F.pmod(F.xxhash64(record), F.lit(1024)))
    following = next_value(
        records.withColumn("_dated", dated), [key, "_dated"], order, bucket, F.col("start_date"), "next_start"
    )
    gap = F.when(F.col("_dated"), months_between_dates("end_date", "next_start") - 1)
    return following.withColumn("gap_months", gap).drop("_dated")


def employment_gaps(
    records: DataFrame, min_gap: int = 3, key: str = "doc_id", record: str = "rec_no"
) -> DataFrame:
    """Months between the end of a record and the start of the one that ends next, where above ``min_gap``."""
    dated = records.select(key, record, "start_date", "end_date").filter("start_date is not null and end_date is not null")
    return with_gaps(dated, key, record).filter(F.col("gap_months") > min_gap).select(
        key, F.col("end_date").alias("start_date"), F.col("next_start").alias("end_date"), "gap_months"
    )


def _pattern_aggregates() -> list[Column]:
    return [
        F.coalesce(F.avg("duration_months"), F.lit(0.0)).alias("average_tenure"),
        F.coalesce(F.sum("duration_months"), F.lit(0)).alias("total_experience"),
        F.count("*").alias("job_count"),
    ]


def _frequency() -> Column:
    years = F.when(F.col("total_experience") > 0, F.col("total_experience") / 12).otherwise(1.0)
    return F.col("job_count") / years


def employment_patterns(records: DataFrame, documents: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Tenure and job changes per document; documents without records get a row of zeros."""
    grouped = records.groupBy(key).agg(*_pattern_aggregates())
    if documents is not None:
        grouped = documents.select(key).join(grouped, key, "left").fillna(0)
    return grouped.select(
        key,
        "average_tenure",
        (F.col("average_tenure") / 12).alias("average_tenure_years"),
        "total_experience",
        (F.col("total_experience") / 12).alias("total_experience_years"),
        "job_count",
        _frequency().alias("job_changing_frequency"),
    )


def turnover_features(
    records: DataFrame,
    documents: DataFrame | None = None,
    min_gap: int = 3,
    key: str = "doc_id",
    record: str = "rec_no",
) -> DataFrame:
    """The seven features, as doubles. The records are read once: gaps are found first and both are aggregated together."""
    needed = records.select(key, record, "start_date", "end_date", "duration_months")
    gap = F.when(F.col("gap_months") > min_gap, F.col("gap_months"))
    grouped = with_gaps(needed, key, record).groupBy(key).agg(
        *_pattern_aggregates(),
        F.count(gap).alias("gap_count"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("avg_gap_duration"),
    )
    if documents is not None:
        grouped = documents.select(key).join(grouped, key, "left").fillna(0)
    full = grouped.withColumns({"job_changing_frequency": _frequency(), "has_gaps": (F.col("gap_count") > 0).cast("int")})
    return full.select(key, *[F.col(f).cast("double").alias(f) for f in FEATURES])

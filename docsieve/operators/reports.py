"""Batch roll-ups: the tables behind reports and dashboards.

They read the one-row-per-document result of ``plans.analyze``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit("Unknown"))


def _yes(flag: str) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "Yes").otherwise("No")


def _category() -> Column:
    return F.coalesce("predicted_category", F.lit("Unknown"))


def batch_summary_rows(results: DataFrame) -> DataFrame:
    return results.select(
        "doc_id",
        file_name("path").alias("file"),
        _category().alias("category"),
        _yes("has_hidden").alias("hidden_text"),
        F.when(F.coalesce("will_leave", F.lit(False)), "High").otherwise("Low").alias("risk"),
    )


def _share(n: Column, total: Column) -> Column:
    return n / F.nullif(total, F.lit(0)) * 100


def batch_statistics(results: DataFrame) -> DataFrame:
    """One row; shares of an empty batch are NULL."""
    counts = results.agg(
        F.count("*").alias("documents"),
        F.count_if(F.coalesce("has_hidden", F.lit(False))).alias("with_hidden"),
        F.count_if(F.coalesce("will_leave", F.lit(False))).alias("high_risk"),
        F.count_if(F.coalesce("stuffing", F.lit(False))).alias("with_stuffing"),
    )
    names = ("with_hidden", "high_risk", "with_stuffing")
    shares = [_share(F.col(n), F.col("documents")).alias(f"{n}_pct") for n in names]
    return counts.select("*", *shares)


def category_distribution(results: DataFrame) -> DataFrame:
    """``category, n, percentage``; the total is a window over one row per category."""
    counts = results.groupBy(_category().alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("category", "n", _share(F.col("n"), total).alias("percentage")).orderBy(F.desc("n"), "category")


def hidden_counts(results: DataFrame) -> DataFrame:
    label = F.when(F.coalesce("has_hidden", F.lit(False)), "Detected").otherwise("None Detected")
    return results.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def hidden_series(results: DataFrame) -> DataFrame:
    share = F.coalesce("hidden_percentage", F.lit(0.0))
    return results.select("doc_id", file_name("path").alias("file"), share.alias("hidden_percentage"))


def classification_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(_category().alias("label")).agg(F.count("*").alias("n"))


def classification_series(results: DataFrame) -> DataFrame:
    confidence = F.coalesce("confidence", F.lit(0.0)) * 100
    return results.select("doc_id", file_name("path").alias("file"), _category().alias("category"), confidence.alias("confidence"))


def _risk_label() -> Column:
    return F.when(F.coalesce("will_leave", F.lit(False)), "High Risk").otherwise("Low Risk")


def turnover_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(_risk_label().alias("label")).agg(F.count("*").alias("n"))


def turnover_series(results: DataFrame) -> DataFrame:
    probability = F.coalesce("leave_probability", F.lit(0.0)) * 100
    return results.select(
        "doc_id", file_name("path").alias("file"), probability.alias("probability"), _risk_label().alias("risk")
    )


def probability_ranking(predicted: DataFrame) -> DataFrame:
    """Categories of each document by falling probability, ranked inside the row."""
    ordered = F.array_sort(
        F.transform(
            "scores", lambda s: F.struct((-s["prob"]).alias("p"), s["ord"].alias("ord"), s["category"].alias("category"), s["prob"].alias("prob"))
        )
    )
    rows = predicted.select("doc_id", "predicted_category", F.posexplode(ordered).alias("pos", "s"))
    return rows.select(
        "doc_id",
        (F.col("pos") + 1).alias("rank"),
        "s.category",
        "s.prob",
        (F.col("s.category") == F.col("predicted_category")).alias("predicted"),
    )


# What a candidate is compared with.
REFERENCE_METRICS = {"average_tenure_years": 4.0, "job_count": 3.0, "job_changing_frequency": 0.25}


def metric_comparison(patterns: DataFrame, key: str = "doc_id", use_average: bool = False) -> DataFrame:
    """``metric, value, reference``: fixed references, or the batch's averages."""
    if use_average:
        means = patterns.agg(*[F.avg(m).alias(m) for m in REFERENCE_METRICS])
        one = means.select(F.struct(*means.columns)).scalar()
        compared = patterns.withColumn("_r", one)
        reference = {m: F.col("_r")[m] for m in REFERENCE_METRICS}
    else:
        compared, reference = patterns, {m: F.lit(v) for m, v in REFERENCE_METRICS.items()}
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), reference[m].alias("reference"))
        for m in REFERENCE_METRICS
    ]
    return compared.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def document_summary(results: DataFrame) -> DataFrame:
    return results.select(
        "doc_id",
        F.when(F.coalesce("has_hidden", F.lit(False)), "Detected").otherwise("None Detected").alias("hidden_text"),
        F.round(F.coalesce("hidden_percentage", F.lit(0.0)), 1).alias("hidden_pct"),
        _category().alias("category"),
        F.round(F.coalesce("confidence", F.lit(0.0)) * 100, 1).alias("confidence_pct"),
        F.when(F.coalesce("will_leave", F.lit(False)), "High").otherwise("Low").alias("risk"),
        F.round(F.coalesce("leave_probability", F.lit(0.0)) * 100, 1).alias("leave_pct"),
    )


def detection_summary(results: DataFrame) -> DataFrame:
    share = F.coalesce("hidden_percentage", F.lit(0.0))
    return results.select(
        "doc_id",
        file_name("path").alias("file"),
        _yes("has_hidden").alias("hidden_text"),
        F.round(share, 2).alias("hidden_pct"),
        F.round(100 - share, 2).alias("visible_pct"),
        _yes("stuffing").alias("stuffing"),
    )

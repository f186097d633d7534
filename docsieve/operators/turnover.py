"""Turnover score: features to contributions, probability, bands and advice. The score has no random part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators.employment import FEATURES
from docsieve.session import small_table

# Feature weights per model type; the last two features are weighed but never scored.
WEIGHTED = (*FEATURES, "industry_stability", "career_progression")
BASE_WEIGHTS = {
    "random_forest": (0.28, 0.12, 0.14, 0.22, 0.09, 0.06, 0.05, 0.02, 0.02),
    "gradient_boosting": (0.34, 0.08, 0.10, 0.28, 0.11, 0.04, 0.03, 0.01, 0.01),
    "logistic_regression": (0.31, 0.13, 0.12, 0.26, 0.10, 0.04, 0.02, 0.01, 0.01),
    "other": (0.30, 0.15, 0.15, 0.21, 0.08, 0.05, 0.03, 0.015, 0.015),
}
SHORT_AND_FREQUENT, GAPS_AND_SHORT = 0.05, 0.04


def weights_of(model_type: str = "random_forest") -> dict[str, float]:
    base = BASE_WEIGHTS.get(model_type, BASE_WEIGHTS["other"])
    return {name: w / sum(base) for name, w in zip(WEIGHTED, base)}


def turnover_weights(spark: SparkSession, model_type: str | None = None) -> DataFrame:
    """``model_type, feature, weight`` with weights that add up to one."""
    types = [model_type] if model_type else list(BASE_WEIGHTS)
    rows = [(t, f, w) for t in types for f, w in weights_of(t).items()]
    return small_table(spark, rows, "model_type string, feature string, weight double")


def feature_stats(features: DataFrame) -> DataFrame:
    """One row: mean and sample deviation of every feature, unknown values as zero."""
    filled = features.fillna(0, list(FEATURES))
    return filled.agg(
        *[F.avg(f).alias(f"{f}_mean") for f in FEATURES],
        *[F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f"{f}_std") for f in FEATURES],
    )


def standardise(features: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Centre and scale with the statistics of the training set (by default of the set itself)."""
    stats = feature_stats(features) if stats is None else stats
    one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    filled = features.fillna(0, list(FEATURES)).withColumn("_s", one)
    scaled = {f: (F.col(f) - F.col("_s")[f"{f}_mean"]) / (F.col("_s")[f"{f}_std"] + 1e-8) for f in FEATURES}
    return filled.withColumns(scaled).drop("_s")


def feature_profile(features: DataFrame) -> DataFrame:
    """``feature, n, mean, std, min, max`` and the covariance with every feature, from one aggregation."""
    aggs = [F.count("*").alias("n")]
    for f in FEATURES:
        aggs += [F.avg(f).alias(f"{f}|mean"), F.stddev_samp(f).alias(f"{f}|std"), F.min(f).alias(f"{f}|min"), F.max(f).alias(f"{f}|max")]
        aggs += [F.covar_samp(f, g).alias(f"{f}|cov_{g}") for g in FEATURES]
    one = features.agg(*aggs)
    names = ["mean", "std", "min", "max", *[f"cov_{g}" for g in FEATURES]]
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"`{f}|{m}`").alias(m) for m in names]) for f in FEATURES
    ])
    return one.select("n", F.explode(rows).alias("r")).select("r.feature", "n", *[f"r.{m}" for m in names])


def norms() -> dict[str, Column]:
    """Every feature on a scale where larger means riskier."""
    one = F.lit(1.0)
    return {
        "average_tenure": 1 / (1 + F.exp(0.05 * (F.col("average_tenure") - 30))),
        "total_experience": 1 - F.log1p("total_experience") / F.log1p(F.lit(120.0)),
        "job_count": F.least(one, F.col("job_count") / 8),
        "job_changing_frequency": F.least(one, F.pow("job_changing_frequency", F.lit(0.8))),
        "has_gaps": F.col("has_gaps"),
        "gap_count": F.least(one, F.col("gap_count") / 3),
        "avg_gap_duration": F.least(one, F.col("avg_gap_duration") / 18),
    }


def feature_contributions(features: DataFrame, model_type: str = "random_forest", key: str = "doc_id") -> DataFrame:
    """One column ``c_<feature>`` per feature."""
    weights = weights_of(model_type)
    return features.select(*features.columns, *[(n * weights[f]).alias(f"c_{f}") for f, n in norms().items()])


def contributions_long(contributions: DataFrame, key: str = "doc_id") -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c_{f}").alias("contribution")) for f in FEATURES])
    return contributions.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def turnover_score(features: DataFrame, model_type: str = "random_forest", score_center: float = 0.0) -> DataFrame:
    """``leave_probability``, ``stay_probability`` and ``will_leave`` next to the features."""
    weights = weights_of(model_type)
    z = sum((n * weights[f] for f, n in norms().items()), F.lit(0.0))
    tenure, gaps = F.col("average_tenure"), F.col("has_gaps") > 0
    z = z + F.when((tenure < 24) & (F.col("job_changing_frequency") > 0.3), SHORT_AND_FREQUENT).otherwise(0.0)
    z = z + F.when(gaps & (tenure < 20), GAPS_AND_SHORT).otherwise(0.0)
    p = 1 / (1 + F.exp((z - score_center) * -2))
    scored = features.withColumn("leave_probability", F.greatest(F.lit(0.01), F.least(F.lit(0.99), p)))
    leave = F.col("leave_probability")
    return scored.withColumns({"stay_probability": 1 - leave, "will_leave": leave > 0.5})


def feature_bands(features: DataFrame, key: str = "doc_id") -> DataFrame:
    """``feature, value, band``: tenure is shown in years."""
    years, frequency = F.col("average_tenure") / 12, F.col("job_changing_frequency")
    bands = {
        "average_tenure": F.when(years < 1.5, "high").when(years < 3, "medium").otherwise("low"),
        "job_changing_frequency": F.when(frequency > 0.5, "high").when(frequency > 0.2, "medium").otherwise("low"),
        "has_gaps": F.when(F.col("has_gaps") > 0, "medium").otherwise("low"),
    }
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            (years if f == "average_tenure" else F.col(f)).alias("value"),
            bands.get(f, F.lit("medium")).alias("band"),
        )
        for f in FEATURES
    ]
    return features.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def risk_level(probability: Column | str = "leave_probability") -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.when(p > 0.7, "High").when(p > 0.4, "Medium").otherwise("Low")


INSIGHTS = {
    "short_tenure": "Positions were held for a short time on average.",
    "long_tenure": "Positions were held for a long time on average.",
    "frequent_changes": "Positions change often.",
    "steady_changes": "Several positions with rare changes.",
    "several_gaps": "More than one gap between positions.",
    "one_gap": "One gap between positions.",
}


def risk_insights() -> Column:
    """Codes of what stands out, see ``INSIGHTS``."""
    years, frequency = F.col("average_tenure") / 12, F.col("job_changing_frequency")
    return F.array_compact(
        F.array(
            F.when(years < 1.5, "short_tenure").when(years > 4, "long_tenure"),
            F.when(frequency > 0.5, "frequent_changes").when(
                (frequency < 0.2) & (F.col("job_count") > 2), "steady_changes"
            ),
            F.when(F.col("gap_count") > 1, "several_gaps").when(F.col("gap_count") == 1, "one_gap"),
        )
    )


RECOMMENDATIONS = {
    "High": ("Clarify career goals early.", "Ask about long-running work.", "Plan retention from the start."),
    "Medium": ("Check the fit with the team.", "Ask why earlier positions ended.", "Offer a path to grow."),
    "Low": ("The history is steady.", "Talk about long-term development.", "Show what the organisation offers."),
}


def recommendations_table(spark: SparkSession) -> DataFrame:
    rows = [(level, i, text) for level, texts in RECOMMENDATIONS.items() for i, text in enumerate(texts, 1)]
    return small_table(spark, rows, "risk_level string, item int, recommendation string")


def risk_recommendations(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Three items per document, by risk level; the nine-row table is broadcast by its size."""
    levels = scored.select(key, risk_level().alias("risk_level"))
    return levels.join(recommendations_table(scored.sparkSession), "risk_level")


def history_only(features: DataFrame, key: str = "doc_id") -> DataFrame:
    """The answer without a model: no prediction, the employment pattern kept."""
    return features.select(
        *features.columns,
        F.lit(0.0).alias("leave_probability"),
        F.lit(1.0).alias("stay_probability"),
        F.lit(False).alias("will_leave"),
        F.lit("Unknown").alias("risk_level"),
    )

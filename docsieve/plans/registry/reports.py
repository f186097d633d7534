"""The whole analysis and the roll-ups of its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve import fixtures as X
from docsieve.operators import employment as E
from docsieve.operators import reports as P
from docsieve.plans import analyze as A
from docsieve.plans.registry import classify as CQ
from docsieve.plans.registry import employment as EQ
from docsieve.plans.registry import hidden as HQ
from docsieve.plans.registry import texts as TQ
from docsieve.plans.registry.hidden import ORDER, STUFFING
from docsieve.session import stored


def documents(spark, d):
    """Every document that has a resume or spans; one without a resume has an empty text."""
    resumes = X.resumes(spark, d).withColumnRenamed("candidate_id", "doc_id")
    others = X.spans(spark, d).select("doc_id").distinct().join(resumes.select("doc_id"), "doc_id", "left_anti")
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return resumes.unionByName(others.withColumn("text", F.lit(""))).withColumn("path", path)


def analysed(spark, d, stages=A.STAGES):
    return A.analyze(
        documents(spark, d),
        spans=X.spans(spark, d),
        lexicon=X.job_lexicon(spark),
        as_of=X.AS_OF,
        stages=stages,
        fallback=X.JOB_FALLBACK,
        skills=X.SKILLS,
        order=ORDER,
        keywords=STUFFING,
        phrase_lexicon=X.product_lexicon(spark),
        entities=X.entities(spark, d),
        gazetteer=HQ.gazetteer(spark, d),
        vectors=HQ.vector_pairs(spark, d),
        intents=HQ.intent_scores(spark, d),
        stop_words=X.STOP_WORDS,
        keep=stored,
    )


def _r(*names, digits=6):
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]


def _b(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# The result as SQL, put together from the statements of the single operators.
_BEST = CQ.BEST.replace("FROM documents", "FROM resume_docs").replace("language_lexicon", "job_lexicon")
_PROBS = CQ.PROBS.replace("FROM documents", "FROM resume_docs").replace("language_lexicon", "job_lexicon")
_FALLBACK = "CASE predicted_category " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in X.JOB_FALLBACK.items()
) + " ELSE [] END"
_ADJUSTED = (
    CQ.ADJUSTED.replace(CQ._FALLBACK, _FALLBACK).replace("FROM documents", "FROM resume_docs").replace("language_lexicon", "job_lexicon")
)
_GAPS = EQ.GAPS.replace("rec_id", "match_no").replace("FROM employment", "FROM dated")
_TURNOVER = (
    EQ.SCORED.replace(EQ.GAPS, _GAPS).replace("FROM employment", "FROM extracted").replace(EQ.CANDIDATES, "SELECT doc_id AS candidate_id FROM resume_docs")
)
# Five of the six tests; the sixth finds no pattern in names of parts.
_CONTEXT = HQ.D16.replace("FROM entities h", "FROM kept_entities h").replace("FROM entities v", "FROM kept_entities v")
_SIMILAR = f"""SELECT doc_id, 'semantic_similarity' AS method, hidden_tokens >= 3 AND (s < 0.3 OR s > 0.95) AS suspicious,
    CASE WHEN hidden_tokens < 3 THEN 0 WHEN s < 0.3 THEN 1 - s / 0.3 WHEN s > 0.95 THEN (s - 0.95) * 20 ELSE 0 END AS confidence, 0 AS n
    FROM ({HQ.SIMILAR}) JOIN ({HQ.SIZES}) USING (doc_id)"""
_INTENT = f"""SELECT doc_id, method, suspicious AND hidden_words >= 5 AS suspicious, CASE WHEN hidden_words >= 5 THEN confidence ELSE 0 END AS confidence, 0 AS n
    FROM ({HQ.D12}) JOIN ({HQ.SIZES}) USING (doc_id)"""
_FOUND = f"{HQ.D3} UNION ALL {HQ.D7} UNION ALL {_CONTEXT} UNION ALL {_SIMILAR} UNION ALL {_INTENT}"
_COMBINED = HQ.COMBINED.replace(HQ.VERDICTS, _FOUND)
_DEGREES = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in TQ._DEGREES)
_SECTIONS = " + ".join(rf"len(regexp_extract_all(text, '(?i)\b{h}\b'))" for h in TQ.R.EXPERIENCE_HEADERS)
RESULT = {
    "resume_docs": "SELECT candidate_id AS doc_id, text FROM resumes UNION ALL SELECT DISTINCT doc_id, '' FROM spans WHERE doc_id NOT IN (SELECT candidate_id FROM resumes)",
    "gazetteer": HQ.GAZETTEER,
    "kept_entities": HQ.KEPT_ENTITIES,
    "extracted": EQ.EXTRACTED,
    "dated": "SELECT * FROM extracted WHERE start_date IS NOT NULL AND end_date IS NOT NULL",
    "scored": _TURNOVER,
    "stats": HQ.STATS,
    "hits": HQ.HITS,
    "combined": _COMBINED,
    "adjusted": _ADJUSTED,
    "results": f"""SELECT r.doc_id, concat('/in/', r.doc_id, '.pdf') AS path, len({TQ._WORDS.format(c='text')}) AS word_count, length(text) AS char_count,
        concat_ws(',', {TQ._SKILL_CASES}) AS skills, {_DEGREES} AS degree_mentions, {_SECTIONS} AS experience_sections,
        coalesce(total_spans, 0) AS total_spans, coalesce(hidden_count, 0) AS hidden_count,
        coalesce(hidden_count / total_spans * 100, 0) AS hidden_percentage, coalesce(hidden_count, 0) > 0 AS has_hidden,
        coalesce(len(hits), 0) > 3 AS stuffing, coalesce(flagged, false) AS flagged, coalesce(c.confidence, 0) AS flag_confidence,
        predicted_category, a.confidence, average_tenure, job_count, p AS leave_probability, p > 0.5 AS will_leave,
        CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.4 THEN 'Medium' ELSE 'Low' END AS risk_level
        FROM resume_docs r LEFT JOIN stats s ON s.doc_id = r.doc_id LEFT JOIN hits h ON h.doc_id = r.doc_id
        LEFT JOIN combined c ON c.doc_id = r.doc_id LEFT JOIN adjusted a ON a.doc_id = r.doc_id LEFT JOIN scored t ON t.candidate_id = r.doc_id""",
}


def i1_analyze(spark, d):
    return analysed(spark, d).select(
        "doc_id",
        *_b("word_count", "char_count", "degree_mentions", "experience_sections", "total_spans", "hidden_count"),
        F.array_join("skills", ",").alias("skills"),
        "stuffing", "flagged", "predicted_category", "will_leave", "risk_level",
        *_r("hidden_percentage", "flag_confidence", "confidence", "average_tenure", "leave_probability"),
    )


I1 = """SELECT doc_id, CAST(word_count AS BIGINT) AS word_count, CAST(char_count AS BIGINT) AS char_count, CAST(degree_mentions AS BIGINT) AS degree_mentions,
    CAST(experience_sections AS BIGINT) AS experience_sections, total_spans, hidden_count, skills, stuffing, flagged, predicted_category, will_leave, risk_level,
    round(hidden_percentage, 6) AS hidden_percentage, round(flag_confidence, 6) AS flag_confidence, round(confidence, 6) AS confidence,
    round(average_tenure, 6) AS average_tenure, round(leave_probability, 6) AS leave_probability FROM results"""


def i1_analyze_two_stages(spark, d):
    """Only features and turnover."""
    return analysed(spark, d, ("features", "turnover")).select("doc_id", *_b("word_count"), "risk_level")


def a11_export_result(spark, d):
    e = A.export_result(analysed(spark, d))
    return e.select(
        "doc_id",
        F.col("document_info.path").alias("path"),
        F.col("features.char_count").cast("bigint").alias("char_count"),
        F.col("hidden_text.hidden_count").alias("hidden_count"),
        F.col("classification.predicted_category").alias("predicted_category"),
        F.col("turnover.risk_level").alias("risk_level"),
    )


def i2_batch_summary_rows(spark, d):
    return P.batch_summary_rows(analysed(spark, d, ("hidden", "category", "turnover")))


I2 = """SELECT doc_id, concat(doc_id, '.pdf') AS file, predicted_category AS category, CASE WHEN has_hidden THEN 'Yes' ELSE 'No' END AS hidden_text,
    CASE WHEN will_leave THEN 'High' ELSE 'Low' END AS risk FROM results"""


def i3_batch_statistics(spark, d):
    s = P.batch_statistics(analysed(spark, d))
    return s.select("documents", "with_hidden", "high_risk", "with_stuffing", *_r("with_hidden_pct", "high_risk_pct", "with_stuffing_pct"))


I3 = """SELECT *, round(with_hidden / documents * 100, 6) AS with_hidden_pct, round(high_risk / documents * 100, 6) AS high_risk_pct,
    round(with_stuffing / documents * 100, 6) AS with_stuffing_pct FROM (SELECT count(*) AS documents, count(*) FILTER (has_hidden) AS with_hidden,
    count(*) FILTER (will_leave) AS high_risk, count(*) FILTER (stuffing) AS with_stuffing FROM results)"""


def i3_batch_statistics_empty(spark, d):
    return P.batch_statistics(analysed(spark, d).filter("word_count < 0"))


I3_EMPTY = """SELECT count(*) AS documents, count(*) AS with_hidden, count(*) AS high_risk, count(*) AS with_stuffing, NULL::DOUBLE AS with_hidden_pct,
    NULL::DOUBLE AS high_risk_pct, NULL::DOUBLE AS with_stuffing_pct FROM results WHERE word_count < 0"""


def i4_category_distribution(spark, d):
    return P.category_distribution(analysed(spark, d, ("category",))).select("category", "n", *_r("percentage"))


I4 = """SELECT predicted_category AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM results) * 100, 6) AS percentage
    FROM results GROUP BY predicted_category"""


def i5_hidden_series(spark, d):
    return P.hidden_series(analysed(spark, d, ("hidden",))).select("doc_id", "file", *_r("hidden_percentage"))


def i5_hidden_counts(spark, d):
    return P.hidden_counts(analysed(spark, d, ("hidden",)))


def i6_classification_series(spark, d):
    return P.classification_series(analysed(spark, d, ("category",))).select("doc_id", "file", "category", *_r("confidence"))


def i6_classification_counts(spark, d):
    return P.classification_counts(analysed(spark, d, ("category",)))


def i7_turnover_series(spark, d):
    return P.turnover_series(analysed(spark, d, ("turnover",))).select("doc_id", "file", "risk", *_r("probability"))


def i7_turnover_counts(spark, d):
    return P.turnover_counts(analysed(spark, d, ("turnover",)))


def i8_probability_ranking(spark, d):
    ranked = P.probability_ranking(analysed(spark, d, ("category",)))
    return ranked.select("doc_id", *_b("rank"), "category", *_r("prob"), "predicted")


I8 = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(prob, 12) DESC, ord) AS rank, category, round(prob, 6) AS prob,
    category = predicted_category AS predicted FROM ({_PROBS}) JOIN (SELECT doc_id, predicted_category FROM ({_BEST})) USING (doc_id)"""


def _patterns(spark, d):
    return E.employment_patterns(EQ._records(spark, d), EQ._candidates(spark, d), EQ.KEY)


def i9_metric_comparison(spark, d):
    return P.metric_comparison(_patterns(spark, d), EQ.KEY).select("candidate_id", "metric", *_r("value", "reference"))


def i9_metric_comparison_averages(spark, d):
    return P.metric_comparison(_patterns(spark, d), EQ.KEY, use_average=True).select("candidate_id", "metric", *_r("value", "reference"))


_METRICS = {"average_tenure_years": "average_tenure / 12", "job_count": "job_count", "job_changing_frequency": "job_changing_frequency"}


def _metrics_sql(average: bool) -> str:
    return " UNION ALL ".join(
        f"SELECT candidate_id, '{m}' AS metric, round({x}, 6) AS value, "
        + (f"round(avg({x}) OVER (), 6)" if average else f"{P.REFERENCE_METRICS[m]}::DOUBLE")
        + f" AS reference FROM ({EQ.PATTERNS})"
        for m, x in _METRICS.items()
    )


def i10_document_summary(spark, d):
    return P.document_summary(analysed(spark, d, ("hidden", "category", "turnover")))


I10 = """SELECT doc_id, CASE WHEN has_hidden THEN 'Detected' ELSE 'None Detected' END AS hidden_text, round(hidden_percentage, 1) AS hidden_pct,
    predicted_category AS category, round(confidence * 100, 1) AS confidence_pct, CASE WHEN will_leave THEN 'High' ELSE 'Low' END AS risk,
    round(leave_probability * 100, 1) AS leave_pct FROM results"""


def i11_detection_summary(spark, d):
    return P.detection_summary(analysed(spark, d, ("hidden",)))


I11 = """SELECT doc_id, concat(doc_id, '.pdf') AS file, CASE WHEN has_hidden THEN 'Yes' ELSE 'No' END AS hidden_text, round(hidden_percentage, 2) AS hidden_pct,
    round(100 - hidden_percentage, 2) AS visible_pct, CASE WHEN stuffing THEN 'Yes' ELSE 'No' END AS stuffing FROM results"""

QUERIES = {
    "a11_export_result": a11_export_result,
    "i1_analyze": i1_analyze,
    "i1_analyze_two_stages": i1_analyze_two_stages,
    "i2_batch_summary_rows": i2_batch_summary_rows,
    "i3_batch_statistics": i3_batch_statistics,
    "i3_batch_statistics_empty": i3_batch_statistics_empty,
    "i4_category_distribution": i4_category_distribution,
    "i5_hidden_series": i5_hidden_series,
    "i5_hidden_counts": i5_hidden_counts,
    "i6_classification_series": i6_classification_series,
    "i6_classification_counts": i6_classification_counts,
    "i7_turnover_series": i7_turnover_series,
    "i7_turnover_counts": i7_turnover_counts,
    "i8_probability_ranking": i8_probability_ranking,
    "i9_metric_comparison": i9_metric_comparison,
    "i9_metric_comparison_averages": i9_metric_comparison_averages,
    "i10_document_summary": i10_document_summary,
    "i11_detection_summary": i11_detection_summary,
}
ORACLE = {
    name: X.oracle(sql, RESULT)
    for name, sql in {
        "a11_export_result": "SELECT doc_id, path, CAST(char_count AS BIGINT) AS char_count, hidden_count, predicted_category, risk_level FROM results",
        "i1_analyze": I1,
        "i1_analyze_two_stages": "SELECT doc_id, CAST(word_count AS BIGINT) AS word_count, risk_level FROM results",
        "i2_batch_summary_rows": I2,
        "i3_batch_statistics": I3,
        "i3_batch_statistics_empty": I3_EMPTY,
        "i4_category_distribution": I4,
        "i5_hidden_series": "SELECT doc_id, concat(doc_id, '.pdf') AS file, round(hidden_percentage, 6) AS hidden_percentage FROM results",
        "i5_hidden_counts": "SELECT CASE WHEN has_hidden THEN 'Detected' ELSE 'None Detected' END AS label, count(*) AS n FROM results GROUP BY label",
        "i6_classification_series": "SELECT doc_id, concat(doc_id, '.pdf') AS file, predicted_category AS category, round(confidence * 100, 6) AS confidence FROM results",
        "i6_classification_counts": "SELECT predicted_category AS label, count(*) AS n FROM results GROUP BY label",
        "i7_turnover_series": """SELECT doc_id, concat(doc_id, '.pdf') AS file, CASE WHEN will_leave THEN 'High Risk' ELSE 'Low Risk' END AS risk,
            round(leave_probability * 100, 6) AS probability FROM results""",
        "i7_turnover_counts": "SELECT CASE WHEN will_leave THEN 'High Risk' ELSE 'Low Risk' END AS label, count(*) AS n FROM results GROUP BY label",
        "i8_probability_ranking": I8,
        "i9_metric_comparison": _metrics_sql(False),
        "i9_metric_comparison_averages": _metrics_sql(True),
        "i10_document_summary": I10,
        "i11_detection_summary": I11,
    }.items()
}

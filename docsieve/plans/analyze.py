"""The whole screening of a set of documents as one plan."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.matching import DEGREES, EXPERIENCE_HEADERS, find_terms, matches
from docsieve.functions.text import basic_features
from docsieve.operators import manipulation as M
from docsieve.operators.classify import adjust_confidence, influential_terms, predict_category, score_categories
from docsieve.operators.employment import extract_employment, turnover_features
from docsieve.operators.spans import (
    SPAN_ORDER,
    is_hidden,
    keyword_hits,
    side_content,
    span_statistics,
    text_chunks,
)
from docsieve.operators.turnover import risk_insights, risk_level, turnover_score

STAGES = ("features", "hidden", "category", "turnover")


def document_features(documents: DataFrame, skills: Sequence[str] = ()) -> DataFrame:
    """Word and character counts, skills, and how many degree contexts and experience sections there are."""
    sizes = basic_features("text")
    degrees = sum((F.size(matches("text", p)) for p in DEGREES), F.lit(0))
    sections = sum((F.size(matches("text", rf"(?iU)\b\Q{h}\E\b")) for h in EXPERIENCE_HEADERS), F.lit(0))
    return documents.select(
        "doc_id",
        sizes["word_count"].alias("word_count"),
        sizes["char_count"].alias("char_count"),
        find_terms("text", skills).alias("skills") if skills else F.array().cast("array<string>").alias("skills"),
        degrees.alias("degree_mentions"),
        sections.alias("experience_sections"),
    )


def suspects(spans: DataFrame) -> DataFrame:
    """The spans of documents that hide anything; only those are tested further."""
    hiding = spans.filter(is_hidden()).select("doc_id").distinct()
    return spans.join(hiding, "doc_id", "left_semi")


def verdicts(
    spans: DataFrame,
    phrase_lexicon: DataFrame | None = None,
    entities: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
    vectors: DataFrame | None = None,
    intents: DataFrame | None = None,
    order: Sequence[str] = SPAN_ORDER,
    stop_words: Iterable[str] = (),
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    chunks: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All test results that the given inputs allow, and ``doc_id, has_hidden, has_visible``.

    ``keep`` stores a table used several times, e.g. ``session.stored`` on a cluster. ``chunks`` are those of the
    ``suspects`` where the caller has them.
    """
    chunks = keep(text_chunks(suspects(spans), order)) if chunks is None else chunks
    sides = chunks.groupBy("doc_id").agg(
        F.bool_or(F.col("side") == "hidden").alias("has_hidden"), F.bool_or(F.col("side") == "visible").alias("has_visible")
    )
    sizes = M.hidden_tokens(chunks, stop_words)
    tfidf = M.term_scores(chunks, stop_words)  # larger than the text, and read once
    found = M.term_frequency_verdict(tfidf, sizes)
    hidden = side_content(chunks).select("doc_id", F.col("content").alias("text"))
    found = found.unionByName(M.pattern_verdict(sizes, M.suspicious_patterns(hidden)))
    if phrase_lexicon is not None:
        counts = M.match_phrases(chunks, phrase_lexicon)
        found = found.unionByName(M.lexicon_verdict(sizes, M.hidden_only_terms(counts)))
    if entities is not None:
        if gazetteer is not None:
            entities = M.drop_gazetteer_entities(entities, gazetteer)
        found = found.unionByName(M.context_verdict(sizes, M.entity_mismatches(entities)))
    if vectors is not None:
        found = found.unionByName(M.similarity_verdict(M.vector_similarity(vectors).join(sizes, "doc_id"), tokens="hidden_tokens"))
    if intents is not None:
        found = found.unionByName(M.intent_verdict(intents, sizes).select(*M.VERDICT))
    return found, sides


def hidden_section(
    spans: DataFrame,
    order: Sequence[str] = SPAN_ORDER,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    keywords: Sequence[str] = (),
    **inputs,
) -> DataFrame:
    """One row per document with spans: statistics, stuffing flag and verdict."""
    stats = span_statistics(spans)
    chunks = keep(text_chunks(suspects(spans), order))  # they hold all hidden text
    hits = keyword_hits(chunks, keywords)  # no words, no stuffing
    found, sides = verdicts(spans, order=order, keep=keep, chunks=chunks, **inputs)
    found = keep(found)
    combined = M.combine_verdicts(found, sides=sides)
    summary = M.verdict_summary(found, combined).select("doc_id", "summary")
    return (
        stats.join(hits, "doc_id", "left")
        .join(combined.withColumnRenamed("confidence", "flag_confidence"), "doc_id", "left")
        .join(summary, "doc_id", "left")
        .select(
            "doc_id",
            "total_spans",
            "hidden_count",
            "hidden_percentage",
            (F.col("hidden_count") > 0).alias("has_hidden"),
            "hits",
            F.coalesce("stuffing", F.lit(False)).alias("stuffing"),
            F.coalesce("flagged", F.lit(False)).alias("flagged"),
            F.coalesce("flag_confidence", F.lit(0.0)).alias("flag_confidence"),
            F.coalesce("summary", F.lit(M.NEUTRAL)).alias("summary"),
        )
    )


def category_section(documents: DataFrame, lexicon: DataFrame, fallback: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    predicted = predict_category(score_categories(documents.select("doc_id", "text"), lexicon))
    predicted = influential_terms(predicted, lexicon, fallback or {})
    predicted = predicted.withColumn("confidence", adjust_confidence("confidence", "influential"))
    return predicted.select("doc_id", "predicted_category", "confidence", "scores", "influential")


def turnover_section(documents: DataFrame, as_of: datetime.date | str, model_type: str = "random_forest") -> DataFrame:
    records = extract_employment(documents.select("doc_id", "text"), as_of)
    scored = turnover_score(turnover_features(records, documents), model_type)
    return scored.select(
        "doc_id", "average_tenure", "total_experience", "job_count", "job_changing_frequency", "has_gaps", "gap_count",
        "avg_gap_duration", "leave_probability", "stay_probability", "will_leave",
        risk_level().alias("risk_level"), risk_insights().alias("insights"),
    )


def analyze(
    documents: DataFrame,
    spans: DataFrame | None = None,
    lexicon: DataFrame | None = None,
    as_of: datetime.date | str | None = None,
    stages: Sequence[str] = STAGES,
    fallback: Mapping[str, Sequence[str]] | None = None,
    skills: Sequence[str] = (),
    model_type: str = "random_forest",
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    **hidden_inputs,
) -> DataFrame:
    """One row per document; each stage adds its columns and can be switched off.

    A document without spans has no hidden text, one without employment records the score of an empty history. Spans of
    other documents are left out first; ``keep`` stores what is left, which the tests read several times, and the documents,
    which every stage reads.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    documents = keep(documents)
    result = documents.select(*[c for c in documents.columns if c != "text"])
    if "features" in stages:
        result = result.join(document_features(documents, skills), "doc_id", "left")
    if "hidden" in stages and spans is not None:
        ids = documents.select("doc_id")
        if hidden_inputs.get("entities") is not None:
            hidden_inputs["entities"] = hidden_inputs["entities"].join(ids, "doc_id", "left_semi")
        section = hidden_section(keep(spans.join(ids, "doc_id", "left_semi")), keep=keep, **hidden_inputs)
        result = result.join(section, "doc_id", "left").fillna(
            {"total_spans": 0, "hidden_count": 0, "hidden_percentage": 0.0, "has_hidden": False, "stuffing": False,
             "flagged": False, "flag_confidence": 0.0, "summary": M.NEUTRAL}
        )
    if "category" in stages and lexicon is not None:
        result = result.join(category_section(documents, lexicon, fallback), "doc_id", "left")
    if "turnover" in stages and as_of is not None:
        result = result.join(turnover_section(documents, as_of, model_type), "doc_id", "left")
    return result


SECTIONS = {
    "document_info": ("path", "file_type", "page_count", "title"),
    "features": ("word_count", "char_count", "skills", "degree_mentions", "experience_sections"),
    "hidden_text": ("total_spans", "hidden_count", "hidden_percentage", "has_hidden", "hits", "stuffing", "flagged", "flag_confidence", "summary"),
    "classification": ("predicted_category", "confidence", "scores", "influential"),
    "turnover": (
        "average_tenure", "total_experience", "job_count", "job_changing_frequency", "has_gaps", "gap_count",
        "leave_probability", "stay_probability", "will_leave", "risk_level", "insights",
    ),
}


def export_result(results: DataFrame) -> DataFrame:
    """``doc_id`` and one struct per section that was computed."""
    present = {name: [c for c in columns if c in results.columns] for name, columns in SECTIONS.items()}
    return results.select("doc_id", *[F.struct(*columns).alias(name) for name, columns in present.items() if columns])

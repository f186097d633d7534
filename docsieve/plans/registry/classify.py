"""Keyword classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve import fixtures as X
from docsieve.operators import classify as K


def _scored(spark, d):
    texts = X.documents(spark, d, "lang")
    return K.score_categories(texts, X.language_lexicon(spark))


def _long(scored):
    return K.category_probabilities(scored, digits=6).select("doc_id", "category", F.round("score", 6).alias("score"), "prob")


def e1_score_categories(spark, d):
    return _long(_scored(spark, d)).drop("prob")


def e1_score_categories_by_join(spark, d):
    """The form for lexicons of any size, on the same input."""
    texts = X.documents(spark, d)
    return _long(K.score_categories_by_join(texts, X.language_lexicon(spark))).drop("prob")


def e1_score_categories_found(spark, d):
    """Only the categories that a document has, of a lexicon too large for an expression."""
    return _long(K.score_categories_by_join(X.documents(spark, d), _large_lexicon(spark), zeros=False)).drop("prob")


SCORES = """SELECT doc_id, category, min(ord) AS ord, sum(CASE WHEN c > 0 THEN
        greatest(0.5, 1 - p / (2 * length(t))) * least(1.0, 0.3 + 0.15 * c) * c ELSE 0 END)::DOUBLE AS score FROM (
    SELECT doc_id, category, ord, t, CAST((length(t) - length(replace(t, concat(' ', term), ''))) // (length(term) + 1) AS DOUBLE) AS c,
        CAST(instr(t, concat(' ', term)) - 1 AS DOUBLE) AS p
    FROM (SELECT doc_id, concat(' ', lower(text), ' ') AS t FROM documents), (SELECT * FROM language_lexicon)) GROUP BY doc_id, category"""
PROBS = f"SELECT *, score / greatest(0.001, sum(score) OVER (PARTITION BY doc_id)) AS prob FROM ({SCORES})"
BEST = f"""SELECT doc_id, category AS predicted_category, prob AS confidence FROM ({PROBS})
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(prob, 12) DESC, ord) = 1"""
E1 = f"SELECT doc_id, category, round(score, 6) AS score FROM ({SCORES})"


def e2_category_probabilities(spark, d):
    return K.category_probabilities(_scored(spark, d)).select("doc_id", "category", "prob")


E2 = f"SELECT doc_id, category, round(prob, 4) AS prob FROM ({PROBS})"


def _predicted(spark, d):
    return K.predict_category(_scored(spark, d))


def e3_predict_category(spark, d):
    return _predicted(spark, d).select("doc_id", "lang", "predicted_category", F.round("confidence", 6).alias("confidence"))


E3 = f"""SELECT d.doc_id, lang, predicted_category, round(confidence, 6) AS confidence
    FROM documents d JOIN ({BEST}) b ON b.doc_id = d.doc_id"""


def _influential(spark, d):
    return K.influential_terms(_predicted(spark, d), X.language_lexicon(spark), X.LANGUAGE_FALLBACK)


def e4_influential_terms(spark, d):
    return _influential(spark, d).select("doc_id", F.array_join("influential", ",").alias("terms"))


def _large_lexicon(spark):
    """The language lexicon and 2,500 terms that no text has: beyond what fits into an expression."""
    filler = spark.range(2500).select(
        F.lit("language").alias("kind"), F.element_at(F.array(*[F.lit(c) for c in ("en", "de", "fr", "es")]), (F.col("id") % 4 + 1).cast("int")).alias("category"),
        F.concat(F.lit("zzq"), F.col("id").cast("string"), F.lit("xk")).alias("term"), F.lit(1.0).alias("weight"), (F.col("id") + 1000).cast("int").alias("ord"),
    )
    lexicon = X.language_lexicon(spark)
    return lexicon.unionByName(filler.select(*[F.col(f.name).cast(f.dataType) for f in lexicon.select("kind", "category", "term", "weight", "ord").schema]), allowMissingColumns=True)


def e4_influential_terms_large_lexicon(spark, d):
    texts, lexicon = X.documents(spark, d), _large_lexicon(spark)
    predicted = K.predict_category(K.score_categories(texts, lexicon))
    return K.influential_terms(predicted, lexicon, X.LANGUAGE_FALLBACK).select("doc_id", F.array_join("influential", ",").alias("terms"))


def e6_batch_predict_large_lexicon(spark, d):
    predicted = K.batch_predict(_with_missing(spark, d), _large_lexicon(spark), X.LANGUAGE_FALLBACK)
    return predicted.select("doc_id", "predicted_category", F.round("confidence", 6).alias("confidence"), "error")


_FALLBACK = "CASE predicted_category " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in X.LANGUAGE_FALLBACK.items()
) + " ELSE [] END"
INFLUENTIAL = f"""SELECT doc_id, list_slice(CASE WHEN len(best) < 3 THEN
        list_concat(best, list_filter({_FALLBACK}, lambda x: NOT list_contains(best, x))) ELSE best END, 1, 10) AS terms FROM (
    SELECT b.doc_id, any_value(predicted_category) AS predicted_category,
        coalesce(list(term ORDER BY rank) FILTER (term IS NOT NULL AND rank <= 10), []) AS best FROM ({BEST}) b LEFT JOIN (
    SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, own DESC, ord) AS rank FROM (
    SELECT doc_id, term, ord, own, CASE WHEN own = 1 THEN weight * (0.7 + 0.3 * (1 - (instr(t, concat(' ', term)) - 1) / length(t)))
        ELSE weight * 0.4 END AS w, sum(own) OVER (PARTITION BY doc_id) AS mine
    FROM (SELECT h.doc_id, h.t, l.term, l.weight, l.ord, CASE WHEN category = predicted_category THEN 1 ELSE 0 END AS own
        FROM (SELECT doc_id, concat(' ', lower(text), ' ') AS t FROM documents) h JOIN ({BEST}) b ON b.doc_id = h.doc_id
        JOIN (SELECT * FROM language_lexicon) l ON contains(t, concat(' ', term, ' ')) OR contains(t, concat(' ', term, 's ')))
    ) WHERE own = 1 OR mine < 3) r ON r.doc_id = b.doc_id GROUP BY b.doc_id)"""
E4 = f"SELECT doc_id, array_to_string(terms, ',') AS terms FROM ({INFLUENTIAL})"


def e5_adjust_confidence(spark, d):
    raised = K.adjust_confidence("confidence", "influential")
    return _influential(spark, d).select("doc_id", F.round(raised, 6).alias("confidence"))


ADJUSTED = f"""SELECT b.doc_id, predicted_category, terms, CASE WHEN len(terms) > 0
    THEN least(0.98, confidence + least(0.15, 0.03 * len(terms))) ELSE confidence END AS confidence
    FROM ({BEST}) b JOIN ({INFLUENTIAL}) i ON i.doc_id = b.doc_id"""
E5 = f"SELECT doc_id, round(confidence, 6) AS confidence FROM ({ADJUSTED})"


def _with_missing(spark, d):
    """Every seventh text is missing."""
    text = F.when(F.col("doc_id") % 7 != 3, F.col("text"))
    return X.documents(spark, d).select("doc_id", text.alias("text"))


def e6_batch_predict(spark, d):
    predicted = K.batch_predict(_with_missing(spark, d), X.language_lexicon(spark), X.LANGUAGE_FALLBACK)
    return predicted.select("doc_id", "predicted_category", F.round("confidence", 6).alias("confidence"), "error")


E6 = f"""SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN predicted_category END AS predicted_category,
    CASE WHEN doc_id % 7 <> 3 THEN round(confidence, 6) ELSE 0 END AS confidence,
    CASE WHEN doc_id % 7 = 3 THEN 'text is missing' END AS error FROM ({ADJUSTED})"""


def e6_batch_predict_disabled(spark, d):
    predicted = K.batch_predict(_with_missing(spark, d), X.language_lexicon(spark), enabled=False)
    return predicted.select("doc_id", "predicted_category", "confidence")


QUERIES = {
    "e1_score_categories": e1_score_categories,
    "e1_score_categories_by_join": e1_score_categories_by_join,
    "e1_score_categories_found": e1_score_categories_found,
    "e2_category_probabilities": e2_category_probabilities,
    "e3_predict_category": e3_predict_category,
    "e4_influential_terms": e4_influential_terms,
    "e4_influential_terms_large_lexicon": e4_influential_terms_large_lexicon,
    "e5_adjust_confidence": e5_adjust_confidence,
    "e6_batch_predict": e6_batch_predict,
    "e6_batch_predict_large_lexicon": e6_batch_predict_large_lexicon,
    "e6_batch_predict_disabled": e6_batch_predict_disabled,
}
ORACLE = {
    name: X.oracle(sql)
    for name, sql in {
        "e1_score_categories": E1,
        "e1_score_categories_by_join": E1,
        "e1_score_categories_found": f"{E1} WHERE score > 0",
        "e2_category_probabilities": E2,
        "e3_predict_category": E3,
        "e4_influential_terms": E4,
        "e4_influential_terms_large_lexicon": E4,
        "e5_adjust_confidence": E5,
        "e6_batch_predict": E6,
        "e6_batch_predict_large_lexicon": E6,
        "e6_batch_predict_disabled": "SELECT doc_id, 'Unknown' AS predicted_category, 0::DOUBLE AS confidence FROM documents",
    }.items()
}

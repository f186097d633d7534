"""Keyword classification: category scores, prediction and the terms behind it.

A small lexicon lives inside the row expression, so classifying is a projection without any shuffle. A lexicon beyond
the size bound is joined (``score_categories_by_join``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.text import _col, once
from docsieve.operators.lexicon import entries, fits, nested

# How position and frequency weigh.
MIN_POSITION, FREQUENCY_BASE, FREQUENCY_STEP = 0.5, 0.3, 0.15
OWN_BASE, OWN_POSITION, FOREIGN = 0.7, 0.3, 0.4
ENOUGH, KEPT = 3, 10


def _padded(c: Column | str) -> Column:
    return F.concat(F.lit(" "), F.lower(_col(c)), F.lit(" "))


def _term_score(length: Column, first: Column, count: Column) -> Column:
    """``first`` is the 0-based position of the first of ``count`` occurrences."""
    position = F.greatest(F.lit(MIN_POSITION), 1 - first / (length * 2))
    frequency = F.least(F.lit(1.0), FREQUENCY_BASE + count * FREQUENCY_STEP)
    return position * frequency * count


def category_score_array(padded: Column, lexicon: Column) -> Column:
    """array<struct<category, ord, score>> for one text, in lexicon order.

    A keyword counts wherever it starts a word. ``padded`` must be a stored column, since it is read once per keyword;
    ``lexicon`` is the constant of ``lexicon.nested``.
    """

    def score(term: Column, length: Column) -> Column:
        start = F.concat(F.lit(" "), term["term"])
        count = (length - F.length(F.replace(padded, start, F.lit("")))) / F.length(start)
        found = lambda at: once(count, lambda n: _term_score(length, at - 1, n))
        return once(F.instr(padded, start), lambda at: F.when(at > 0, found(at)).otherwise(F.lit(0.0)))

    def category(c: Column, length: Column) -> Column:
        total = F.aggregate(c["terms"], F.lit(0.0), lambda acc, term: acc + score(term, length))
        return F.struct(c["category"].alias("category"), c["ord"].alias("ord"), total.alias("score"))

    return once(F.length(padded), lambda length: F.transform(lexicon, lambda c: category(c, length)))


def with_probabilities(scored: DataFrame) -> DataFrame:
    """Adds ``prob`` to every struct of ``scores``."""
    total = F.greatest(F.lit(0.001), F.aggregate("scores", F.lit(0.0), lambda acc, c: acc + c["score"]))
    shares = F.transform(
        "scores",
        lambda c: F.struct(
            c["category"].alias("category"),
            c["ord"].alias("ord"),
            c["score"].alias("score"),
            (c["score"] / F.col("_total")).alias("prob"),
        ),
    )
    return scored.withColumn("_total", total).withColumn("scores", shares).drop("_total")


def score_categories(texts: DataFrame, lexicon: DataFrame, column: str = "text") -> DataFrame:
    """The input with ``scores``; joins instead where the lexicon is too large for an expression."""
    if not fits(lexicon):
        return score_categories_by_join(texts, lexicon, column)
    padded = texts.withColumn("_t", _padded(column))
    scored = padded.withColumn("scores", category_score_array(F.col("_t"), nested(entries(lexicon)))).drop("_t")
    return with_probabilities(scored)


def _terms_in(texts: DataFrame, terms: DataFrame, column: str) -> DataFrame:
    """``doc_id`` and the lexicon rows whose term starts at a word of the text, by an equi-join of word beginnings.

    Beginnings are made distinct in the row and meet the lexicon before anything else, so that where Spark broadcasts it,
    only the terms found are sent.
    """
    lengths = sorted(r.n for r in terms.select(F.length("term").alias("n")).distinct().collect())
    longest = max(lengths, default=1)
    parts = texts.select("doc_id", F.split(_padded(column), " ", -1).alias("parts"))
    # A keyword of n characters spans at most n parts, so a beginning is cut from that many.
    beginnings = F.transform(
        F.sequence(F.lit(2), F.size("parts") - 1),
        lambda i: F.substring(F.array_join(F.slice("parts", i, longest), " "), 1, longest),
    )
    cut = lambda h: F.array(*[F.substring(h, 1, n) for n in lengths])
    prefixes = F.flatten(F.transform(F.array_distinct(beginnings), cut)) if lengths else F.array().cast("array<string>")
    starts = parts.filter(F.size("parts") > 2).select("doc_id", F.explode(F.array_distinct(prefixes)).alias("term"))
    return starts.join(terms.select("term"), "term", "left_semi").distinct().join(terms, "term")


def score_categories_by_join(texts: DataFrame, lexicon: DataFrame, column: str = "text", zeros: bool = True) -> DataFrame:
    """The same scores for a lexicon of any size; ``texts`` needs a ``doc_id``.

    Only the keywords that a document has are met and scored. Without ``zeros`` so are its ``scores``: the categories found,
    in lexicon order, none for a null or foreign text. With it every row gets every category, as large as that makes it.
    """
    terms = lexicon.select("category", "term", F.coalesce("weight", F.lit(1.0)).alias("weight"), "ord")
    firsts = terms.groupBy("category").agg(F.min("ord").alias("first"))
    order = firsts.select("category", (F.row_number().over(Window.orderBy("first", "category")) - 1).alias("place"))
    found = _terms_in(texts, terms, column).groupBy("doc_id", "category").agg(
        F.array_sort(F.collect_list(F.struct("ord", "term", "weight"))).alias("terms")
    )
    own = found.join(order, "category").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("place").alias("ord"), "category", "terms"))).alias("_own")
    )
    joined = texts.join(own, "doc_id", "left").withColumn("_t", _padded(column))
    held = joined.withColumn("scores", F.coalesce(category_score_array(F.col("_t"), F.col("_own")), F.array().cast(_SCORES)))
    scored = with_probabilities(held.drop("_t", "_own"))
    return _with_zeros(scored, order) if zeros else scored


_SCORES = "array<struct<category:string,ord:int,score:double>>"


def _with_zeros(scored: DataFrame, order: DataFrame) -> DataFrame:
    """``scores`` with a zero for every category of ``order`` that a document lacks."""
    zero = F.struct("category", F.col("place").alias("ord"), F.lit(0.0).alias("score"), F.lit(0.0).alias("prob"))
    every = order.agg(F.array_sort(F.collect_list(F.struct("place", zero.alias("zero")))).alias("a")).select(F.transform("a", lambda x: x["zero"])).scalar()
    held = F.map_from_entries(F.transform("scores", lambda c: F.struct(c["ord"], c)))
    return scored.withColumns({"_every": every, "_held": held}).withColumn(
        "scores", F.transform("_every", lambda c: F.coalesce(F.try_element_at("_held", c["ord"]), c))
    ).drop("_every", "_held")


def category_probabilities(scored: DataFrame, digits: int = 4) -> DataFrame:
    """Long form: ``doc_id, category, ord, score, prob``."""
    # An outer explode: the inner one adds a filter on the array, for which it would be computed a second time.
    return scored.select("doc_id", F.explode_outer("scores").alias("s")).filter("s is not null").select(
        "doc_id", "s.category", "s.ord", "s.score", F.round("s.prob", digits).alias("prob")
    )


def best_category(scores: Column | str) -> Column:
    """The struct with the highest probability; on a tie the first in lexicon order; null if there is none."""
    return F.aggregate(
        _col(scores),
        F.try_element_at(_col(scores), F.lit(1)),
        lambda acc, c: F.when(c["prob"] > acc["prob"], c).otherwise(acc),
    )


def predict_category(scored: DataFrame, otherwise: str | None = None) -> DataFrame:
    """``otherwise`` is predicted, with confidence 0, where a text has no score at all."""
    best = best_category("scores")
    none = F.lit(otherwise).cast("string")
    return scored.withColumns({
        "predicted_category": F.coalesce(best["category"], none),
        "confidence": F.coalesce(best["prob"], F.when(none.isNotNull(), F.lit(0.0))),
    })


def predict(texts: DataFrame, lexicon: DataFrame, column: str = "text") -> DataFrame:
    """The prediction for a lexicon of any size; a large one gives a row only the categories that its text has."""
    if fits(lexicon):
        return predict_category(score_categories(texts, lexicon, column))
    first = lexicon.agg(F.min(F.struct("ord", "category"))["category"]).first()[0]
    return predict_category(score_categories_by_join(texts, lexicon, column, zeros=False), first)


def _filled(ranked: DataFrame, fallback: Mapping[str, Sequence[str]]) -> DataFrame:
    """``influential`` from ``_best``: with fewer than three, the category's fallback terms fill up."""
    pairs = [p for k, v in fallback.items() for p in (F.lit(k), F.array(*[F.lit(x) for x in v]))]
    spare = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")
    extra = F.filter(
        F.coalesce(F.try_element_at(spare, F.col("predicted_category")), F.array().cast("array<string>")),
        lambda x: ~F.array_contains("_best", x),
    )
    filled = F.when(F.size("_best") < ENOUGH, F.slice(F.concat("_best", extra), 1, KEPT)).otherwise(F.col("_best"))
    return ranked.withColumn("influential", filled).drop("_best")


def influential_terms(
    predicted: DataFrame, lexicon: DataFrame, fallback: Mapping[str, Sequence[str]], column: str = "text"
) -> DataFrame:
    """``influential``: the terms that speak for the prediction, strongest first.

    Own terms are weighed by position; with fewer than three, terms of other categories join at a reduced weight, and
    with still fewer than three the category's fallback terms fill up. A lexicon too large for an expression is joined.
    """
    if not fits(lexicon):
        return influential_terms_by_join(predicted, lexicon, fallback, column)
    t = F.col("_t")
    terms = F.flatten(
        F.transform(
            nested(entries(lexicon)),
            lambda c: F.transform(
                c["terms"], lambda x: F.struct(c["category"].alias("category"), x["term"].alias("term"), x["weight"].alias("weight"))
            ),
        )
    )

    def ranked(hits: Column, weight) -> Column:
        return F.transform(hits, lambda x: F.struct((-weight(x)).alias("w"), x["term"].alias("term")))

    mine = F.col("predicted_category")
    found = predicted.withColumn("_t", _padded(column)).withColumn("_hits", F.filter(terms, lambda x: _present(t, x["term"])))
    own_hits = ranked(F.filter("_hits", lambda x: x["category"] == mine), lambda x: _own_weight(t, x["term"], x["weight"]))
    foreign = ranked(F.filter("_hits", lambda x: x["category"] != mine), lambda x: x["weight"] * FOREIGN)
    listed = F.when(F.size("_own") < ENOUGH, F.concat("_own", foreign)).otherwise(F.col("_own"))
    numbered = F.transform(listed, lambda x, i: F.struct(x["w"].alias("w"), i.alias("i"), x["term"].alias("term")))
    best = F.transform(F.slice(F.array_sort(numbered), 1, KEPT), lambda x: x["term"])
    return _filled(found.withColumn("_own", own_hits).withColumn("_best", best).drop("_t", "_hits", "_own"), fallback)


def _present(t: Column, term: Column) -> Column:
    """As a word of its own, or with an s."""
    start = F.concat(F.lit(" "), term)
    return F.contains(t, start) & (F.contains(t, F.concat(start, F.lit(" "))) | F.contains(t, F.concat(start, F.lit("s "))))


def _own_weight(t: Column, term: Column, weight: Column) -> Column:
    at = F.instr(t, F.concat(F.lit(" "), term)) - 1
    return weight * (OWN_BASE + OWN_POSITION * (1 - at / F.length(t)))


def influential_terms_by_join(
    predicted: DataFrame, lexicon: DataFrame, fallback: Mapping[str, Sequence[str]], column: str = "text"
) -> DataFrame:
    """The same terms for a lexicon of any size; ``predicted`` needs a ``doc_id``.

    A document's terms are ranked where they meet; as many as its words at most, of which ten are kept.
    """
    terms = lexicon.select("category", "term", F.coalesce("weight", F.lit(1.0)).alias("weight"), "ord")
    order = terms.groupBy("category").agg(F.min("ord").alias("_category_ord"))
    texts = predicted.select("doc_id", "predicted_category", _padded(column).alias("_t"))
    found = _terms_in(predicted, terms.join(order, "category"), column).join(texts, "doc_id").filter(_present(F.col("_t"), F.col("term")))
    own = F.col("category") == F.col("predicted_category")
    weighed = found.select(
        "doc_id", "term", "_category_ord", "ord", own.alias("_own"),
        F.when(own, _own_weight(F.col("_t"), F.col("term"), F.col("weight"))).otherwise(F.col("weight") * FOREIGN).alias("_w"),
    )
    own_count = F.sum(F.col("_own").cast("int")).over(Window.partitionBy("doc_id"))
    strongest = Window.partitionBy("doc_id").orderBy(F.desc("_w"), F.desc("_own"), "_category_ord", "ord")
    counted = weighed.withColumn("_owns", own_count).filter(F.col("_own") | (F.col("_owns") < ENOUGH))
    kept = counted.withColumn("_rank", F.row_number().over(strongest)).filter(F.col("_rank") <= KEPT)
    best = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "term"))).alias("_ranked"))
    joined = predicted.join(best, "doc_id", "left")
    named = F.coalesce(F.transform("_ranked", lambda x: x["term"]), F.array().cast("array<string>"))
    return _filled(joined.withColumn("_best", named).drop("_ranked"), fallback)


def adjust_confidence(confidence: Column | str, influential: Column | str) -> Column:
    n = F.size(_col(influential))
    raised = F.least(F.lit(0.98), _col(confidence) + F.least(F.lit(0.15), n * 0.03))
    return F.when(n > 0, raised).otherwise(_col(confidence))


def batch_predict(
    texts: DataFrame,
    lexicon: DataFrame,
    fallback: Mapping[str, Sequence[str]] | None = None,
    column: str = "text",
    enabled: bool = True,
) -> DataFrame:
    """``doc_id, predicted_category, confidence, influential, error``: one row per text, bad texts as error rows."""
    if not enabled:
        return texts.select(
            "doc_id",
            F.lit("Unknown").alias("predicted_category"),
            F.lit(0.0).alias("confidence"),
            F.array().cast("array<string>").alias("influential"),
            F.lit(None).cast("string").alias("error"),
        )
    scored = influential_terms(predict(texts, lexicon, column), lexicon, fallback or {}, column)
    bad = F.col(column).isNull()
    return scored.select(
        "doc_id",
        F.when(~bad, F.col("predicted_category")).alias("predicted_category"),
        F.when(bad, 0.0).otherwise(adjust_confidence("confidence", "influential")).alias("confidence"),
        F.when(~bad, F.col("influential")).alias("influential"),
        F.when(bad, "text is missing").alias("error"),
    )


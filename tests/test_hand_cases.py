"""Cases worked out by hand, one per constant or rule."""

import math

import pytest
from pyspark.sql import functions as F

from docsieve.functions import matching as R
from docsieve.functions import text as T
from docsieve.functions.dates import with_parsed_range
from docsieve.operators import classify as K
from docsieve.operators import employment as E
from docsieve.operators import manipulation as M
from docsieve.operators import runs as RU
from docsieve.operators import spans as S
from docsieve.operators import turnover as TU
from docsieve.operators.terms import normalise_terms
from docsieve.session import small_table


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


@pytest.mark.parametrize("color, hidden", [(0xF0F0F0, False), (0xF1F1F1, True), (0xFFFFF0, False), (0xFFFFFF, True), (0, False)])
def test_hidden_means_every_channel_above_240(spark, color, hidden):
    df = spark.createDataFrame([(color,)], "color int")
    assert df.select(S.is_hidden()).first()[0] is hidden


def test_clean_text_order(spark):
    text = "Mail Jo@x.org now: http://a.b/c +1 555-123-4567, item 42!"
    assert one(spark, text, T.clean_text("t")).split() == ["mail", "now", "item"]


def test_tokens_are_unicode(spark):
    assert one(spark, "Éa, it's (Ña) well-known x1", T.match_tokens("t")) == ["éa", "ña", "x1"]


def test_ngrams_in_order(spark):
    assert one(spark, "a b c", T.ngrams(T.words("t"), 1, 3)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, "a", T.ngrams(T.words("t"), 1, 3)) == ["a"]


def test_offsets_count_code_points(spark):
    hits = one(spark, "é ab 𝄞 ab", R.matches("t", "ab"))
    assert [(h.offset, h.text) for h in hits] == [(2, "ab"), (7, "ab")]


def test_term_ending_in_a_symbol_needs_a_word_character_after_it(spark):
    assert one(spark, "c++ and sql", R.find_terms("t", ["c++", "sql"])) == ["sql"]
    assert one(spark, "c++x sql", R.find_terms("t", ["c++", "sql"])) == ["c++", "sql"]


@pytest.mark.parametrize(
    "text, start, end, months, current",
    [
        ("Jan 2000 - Mar 2001", "2000-01-31", "2001-03-31", 14, False),
        ("2000 – Present", "2000-05-31", "2002-05-31", 24, True),
        ("Feb 2001 to Sept 2001", "2001-02-28", "2001-09-30", 7, False),
        ("Mar 2001 - Jan 2000", "2001-03-31", "2000-01-31", 0, False),
        ("Janvier 1999 - Marzo 2000", None, None, None, False),
        ("2000 - 2001 - 2002", None, None, None, False),
    ],
)
def test_ranges(spark, text, start, end, months, current):
    df = spark.createDataFrame([(text,)], "r string")
    row = with_parsed_range(df, "r", F.lit("2002-05-31").cast("date")).first()
    assert [str(v) if v else None for v in (row.start_date, row.end_date)] == [start, end]
    assert (row.duration_months, row.is_current) == (months, current)


@pytest.mark.parametrize("next_start, gaps", [("2000-05-01", []), ("2000-06-01", [4])])
def test_a_gap_is_longer_than_three_months(spark, next_start, gaps):
    rows = [(1, 1, "1999-01-01", "2000-01-01"), (1, 2, next_start, "2001-01-01"), (1, 3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, rec_no int, s string, e string").select(
        "doc_id", "rec_no", F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date")
    )
    assert [r.gap_months for r in E.employment_gaps(df).collect()] == gaps


def test_empty_history_scores_above_one_half(spark):
    features = small_table(spark, [(1, *[0.0] * 7)], "doc_id bigint, " + ", ".join(f"{f} double" for f in E.FEATURES))
    row = TU.turnover_score(features).first()
    z = 0.28 / (1 + math.exp(-1.5)) + 0.12
    assert row.leave_probability == pytest.approx(1 / (1 + math.exp(-2 * z)))
    assert round(row.leave_probability, 3) == 0.668 and row.will_leave


def test_weights_add_up_to_one(spark):
    sums = TU.turnover_weights(spark).groupBy("model_type").agg(F.sum("weight").alias("s")).collect()
    assert len(sums) == 4 and all(r.s == pytest.approx(1) for r in sums)


def test_similar_entities(spark):
    rows = [
        (1, "hidden", "ORG", "a b c d"), (1, "visible", "ORG", "a b c d e"),  # 4 of 5
        (2, "hidden", "ORG", "a b c"), (2, "visible", "ORG", "a b c d"),  # 3 of 4
        (3, "hidden", "ORG", "x y"), (3, "visible", "PERSON", "x y"),  # other label
        (4, "hidden", "DATE", "may"),
        (5, "hidden", "GPE", "  "), (5, "visible", "GPE", "  "),
    ]
    df = spark.createDataFrame(rows, "doc_id long, side string, label string, text string")
    assert sorted(r.doc_id for r in M.entity_mismatches(df).collect()) == [2, 3, 5]


@pytest.mark.parametrize("confidence, flagged", [(0.69, False), (0.7, True)])
def test_verdicts_count_from_seven_tenths(spark, confidence, flagged):
    df = spark.createDataFrame([(1, "patterns", True, confidence, 2), (1, "intent", False, 0.9, 0)], ", ".join(
        ["doc_id long", "method string", "suspicious boolean", "confidence double", "n long"]
    ))
    row = M.combine_verdicts(df).first()
    assert (row.flagged, row.confidence) == (flagged, confidence if flagged else 0.0)


def test_repeated_word_and_long_lists(spark):
    texts = [(1, "data data data dataset"), (2, "data data"), (3, "w, " * 9), (4, "word, " * 10), (5, "x, " * 50_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, r.pattern): r.match for r in M.suspicious_patterns(df).collect()}
    assert found[1, "repeated_word"] == "data data data data"
    assert (4, "delimited_list") in found and (5, "delimited_list") in found
    assert not [k for k in found if k[0] in (2, 3)]


def test_keywords_count_where_they_start_a_word(spark):
    lexicon = small_table(spark, [("k", "A", "art", 1.0, 0), ("k", "B", "zzz", 1.0, 1)], "kind string, category string, term string, weight double, ord int")
    texts = spark.createDataFrame([(1, "art artist smart"), (2, "nothing")], "doc_id long, text string")
    rows = {r.doc_id: r for r in K.predict_category(K.score_categories(texts, lexicon)).collect()}
    assert rows[1].scores[0].score == pytest.approx(1.0 * 0.6 * 2)
    assert (rows[2].predicted_category, rows[2].confidence) == ("A", 0.0)  # all zero: the first in order


def test_large_lemma_tables_are_joined(spark):
    tokens = spark.createDataFrame([(1, ["runs", "to", "runs"]), (2, ["x"])], "doc_id long, tokens array<string>")
    lemmas = small_table(spark, [("runs", "run")], "form string, lemma string")
    for limit in (10, 0):
        rows = {r.doc_id: r.tokens for r in normalise_terms(tokens, lemmas, limit=limit).collect()}
        assert rows == {1: ["run", "to", "run"], 2: ["x"]}


@pytest.mark.parametrize("limit", [10, 0])
def test_forms_with_two_lemmas_take_the_smallest(spark, limit):
    tokens = spark.createDataFrame([(1, ["runs", "left", "x"])], "doc_id long, tokens array<string>")
    lemmas = spark.createDataFrame([("left", "leave"), ("left", "left"), ("unused", "b"), ("unused", "a"), ("runs", None), (None, "q")], "form string, lemma string")
    assert normalise_terms(tokens, lemmas, limit=limit).first().tokens == ["runs", "leave", "x"]


LOG = [
    "<BEGIN ANALYSIS id:a mode:analyze file:x.pdf timestamp:20240101_000000>",
    "{'predicted_category': 'HR'}",
    "<BEGIN ANALYSIS id:b mode:analyze timestamp:20240101_000100>",  # inside a
    "<END ANALYSIS id:a timestamp:20240101_000200>",  # closes a, b stays open for ever
    "<BEGIN ANALYSIS id:c mode:batch pattern:*.pdf timestamp:bad>",
    "<BEGIN ANALYSIS id:d mode:analyze timestamp:20240101_000300>",
    "{'prediction': {'will_leave': True, 'note': None}}",
    "<END ANALYSIS timestamp:20240101_000400>",  # cannot be read
    "<END ANALYSIS id:c timestamp:20240101_000500>",
    "{'skills': ['it''s']}",
]


@pytest.mark.parametrize("within", [False, True])
def test_runs(spark, within):
    lines = spark.createDataFrame([(7, i, l) for i, l in enumerate(LOG, 1)], "log_id long, line_no long, line string")
    markers = RU.assign_markers(lines, within)
    runs = {r.id: r for r in RU.run_status(markers).collect()}
    assert {k: (r.status, r.parent_line, r.duration_seconds) for k, r in runs.items()} == {
        "a": ("completed", None, 120),
        "b": ("running", 1, None),
        "c": ("completed", None, None),
        "d": ("error", 5, None),
    }
    results = {r.line_no: (r.result_kind, r.run_line) for r in RU.assign_to_run(lines, markers).collect()}
    assert results == {2: ("classification", 1), 7: ("turnover", 6)}

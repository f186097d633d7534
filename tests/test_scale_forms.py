"""The forms made for large and skewed inputs give what the plain ones give."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docsieve import fixtures as X
from docsieve.functions import text as T
from docsieve.functions.matching import matches
from docsieve.operators import classify as K
from docsieve.operators import employment as W
from docsieve.operators import evaluation as V
from docsieve.operators import manipulation as M
from docsieve.operators import ordered as O
from docsieve.operators import spans as S
from docsieve.operators.terms import with_terms
from docsieve.plans.analyze import analyze, hidden_section
from docsieve.session import stored
from docsieve.sources import files as A


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    rows = [(0 if i % 3 else rng.randrange(4), i, rng.randrange(100) if rng.random() < 0.4 else None) for i in range(3000)]
    return spark.createDataFrame(rows, "k long, i long, v long").repartition(5)


def test_buckets_equal_plain_windows(numbers):
    w = Window.partitionBy("k").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    bucket, order = F.floor(F.col("i") / 37), [F.col("i")]
    found = O.along(numbers, ["k"], order, bucket, {"s": F.coalesce("v", F.lit(1))}, {"l": F.col("v")})
    found = O.next_value(found, ["k"], order, bucket, F.col("v"), "nxt")
    found = O.position(found, ["k"], order, bucket, "p")
    want = numbers.withColumns({
        "s": F.sum(F.coalesce("v", F.lit(1))).over(upto),
        "l": F.last("v", ignorenulls=True).over(upto),
        "nxt": F.lead("v").over(w),
        "p": F.row_number().over(w).cast("long"),
    })
    assert sorted(found.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)


@pytest.fixture
def many_ranges(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_bound_the_rows_of_a_bucket(spark, many_ranges):
    """Starts unknown throughout, one key with most rows, a null key."""
    rng = random.Random(5)
    rows = [(None if i % 9 == 0 else 1 if i % 5 else i, i, None if i % 3 else f"20{rng.randrange(10, 20)}-01-0{rng.randrange(1, 9)}") for i in range(4000)]
    records = spark.createDataFrame(rows, "doc_id long, rec_no long, s string").select("doc_id", "rec_no", F.to_date("s").alias("start_date")).repartition(7)
    found = W.order_history(records)
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.coalesce("start_date", F.lit(W.EARLIEST).cast("date"))), "rec_no")
    want = records.withColumn("position", F.row_number().over(order).cast("long"))
    assert sorted(found.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    ranges = [r["count"] for r in O.ranged(records, [F.col("doc_id"), F.col("rec_no")]).groupBy("_range").count().collect()]
    assert len(ranges) > 1 and max(ranges) < 2 * len(rows) / len(ranges)
    assert W.order_history(records.limit(0)).count() == 0


def test_curve_points_of_scores_anywhere(spark, many_ranges):
    rng = random.Random(6)
    rows = [(rng.choice([-1e9, -3.5, 0.0, 0.5, 1.0, 7.0, float("inf")]) if i % 2 else rng.gauss(50, 9), int(rng.random() < 0.4)) for i in range(2000)]
    points = V.curve_points(spark.createDataFrame(rows, "score double, label int").repartition(6)).collect()
    assert len(points) == len({s for s, _ in rows})
    for r in points:
        assert r.tp == sum(l for s, l in rows if s >= r.score) and r.fp == sum(1 - l for s, l in rows if s >= r.score)


@pytest.mark.parametrize("threshold", [0.8, 0.5, 0.67])
def test_similar_entities_equal_all_pairs(spark, threshold):
    """Sets of all sizes, long ones too, that differ in few tokens."""
    rng = random.Random(7)
    def text():
        n = rng.choice([1, 2, 3, 4, 5, 6, 9, 10, 11, 24, 25, 26, 31, 32, 40, 60])
        return " ".join(sorted({f"c{k}" for k in range(n)} ^ {f"c{rng.randrange(n + 2)}" for _ in range(rng.randrange(0, 1 + n // 4 + 1))} | {f"u{rng.randrange(9)}"} - {"u0", "u1", "u2", "u3"}))
    rows = [(d, rng.choice(["hidden", "visible"]), "ORG", text()) for d in (1, 2) for _ in range(150)]
    entities = spark.createDataFrame(rows, "doc_id long, side string, label string, text string")
    found = {(r.doc_id, r.text) for r in M.entity_mismatches(entities, threshold, labels=["ORG"]).collect()}
    sets = lambda d, s: {(t, frozenset(t.split())) for e, side, _, t in rows if (e, side) == (d, s)}
    near = lambda a, b: a == b or (a and len(a & b) >= (threshold - 1e-12) * len(a | b))
    want = {(d, t) for d in (1, 2) for t, a in sets(d, "hidden") if not any(near(a, b) for _, b in sets(d, "visible") if b)}
    assert found == want and want


def test_one_rare_word_among_frequent_ones_meets_nothing(spark):
    """n texts alike but for their last word, on both sides: keys grow with n, pairs don't."""
    n = 3000
    texts = spark.range(2 * n).select(
        F.lit(1).alias("doc_id"), F.lit("ORG").alias("label"), F.when(F.col("id") < n, "hidden").otherwise("visible").alias("side"),
        F.concat(F.lit("acme corp north region "), F.col("id").cast("string")).alias("text"),
    )
    assert M.entity_mismatches(texts, labels=["ORG"]).count() == n
    tokens = F.transform(F.split("text", " "), lambda w: F.struct(F.when(w.rlike("^[0-9]"), 1).otherwise(n).alias("f"), w.alias("token")))
    keys = texts.select(F.explode(M._size_keys(F.array_sort(tokens), 0.8)).alias("k")).groupBy("k").count()
    same_size = keys.filter("k.mine = k.theirs").agg(F.max("count")).first()[0]
    assert same_size == 1


@pytest.fixture(scope="module")
def long_document(spark):
    rng = random.Random(2)
    words = "red blue bolt ring small widget x".split()
    rows = [
        (d, page, n, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), rng.choice([0xFFFFFF, 0]))
        for d in (1, 2) for page in range(40) for n in range(rng.randrange(0, 4))
    ]
    return spark.createDataFrame(rows, "doc_id long, page int, span_no int, text string, color int")


@pytest.mark.parametrize("pages", [1, 3])
def test_runs_and_keywords_cross_chunk_borders(spark, long_document, pages):
    whole, cut = (S.text_chunks(long_document, pages=p) for p in (1000, pages))
    for form in (
        lambda c: M.side_terms(c),
        lambda c: M.match_phrases(c, X.product_lexicon(spark)),
        lambda c: S.keyword_hits(c, ["ring small widget red", "d b", "x x x"]),
        lambda c: S.side_content(c),
    ):
        assert sorted(form(whole).collect(), key=str) == sorted(form(cut).collect(), key=str)


@pytest.mark.parametrize("literal", [4096, 0])
def test_long_phrases_and_large_lexicons(spark, long_document, literal):
    """Phrases of up to 70 tokens, over chunk borders, whether beginnings are held in the expression or joined."""
    long = " ".join(r.content for r in S.side_content(S.text_chunks(long_document, pages=1), "visible").collect())
    tokens = long.split()
    phrases = [tokens[at : at + n] for at, n in ((0, 70), (3, 1), (5, 2), (9, 9), (20, 33), (1, 70))] + [["red", "red", "red"], ["nowhere"], ["red"], ["blue", "bolt"]]
    rows = [("k", "A", " ".join(p), 1.0, k) for k, p in enumerate(phrases)]
    lexicon = spark.createDataFrame(rows, X.LEXICON_SCHEMA)
    whole = {}
    for (doc, side), spans in S.side_content(S.text_chunks(long_document, pages=1), "visible").rdd.map(lambda r: ((r.doc_id, "visible"), r.content.split())).collect():
        for p in {tuple(p) for p in phrases}:
            n = sum(tuple(spans[i : i + len(p)]) == p for i in range(len(spans)))
            if n:
                whole[doc, " ".join(p)] = n * sum(list(p) == q for q in phrases)
    chunks = S.text_chunks(long_document, pages=1).filter("side = 'visible'")
    found = {(r.doc_id, r.phrase): r.n for r in M.match_phrases(chunks, lexicon, literal=literal).collect()}
    assert found == whole and max(len(p.split()) for _, p in found) == 70
    twice = spark.createDataFrame([(1, "red bolt red"), (1, "red bolt red"), (None, "red"), (2, None), (3, "")], "doc_id long, text string")
    again = {(r.doc_id, r.phrase): r.n for r in M.match_phrases(twice, lexicon, literal=literal).collect()}
    assert again[1, "red"] == 4 * sum(p == ["red"] for p in phrases) and again[None, "red"] == sum(p == ["red"] for p in phrases)
    assert M.match_phrases(twice, lexicon.limit(0), literal=literal).count() == 0


def test_beginnings_bound_the_runs(spark):
    """A text that holds one beginning gives one run, whatever lengths the lexicon has."""
    text = " ".join(f"t{i}" for i in range(500))
    rows = [("k", "A", " ".join(f"t{i}" for i in range(7, 7 + n)), 1.0, n) for n in (2, 30, 70)]
    lexicon = spark.createDataFrame(rows, X.LEXICON_SCHEMA)
    texts = spark.createDataFrame([(1, text)], "doc_id long, text string")
    tokens = texts.select(M.phrase_tokens("text").alias("tokens"))
    runs = tokens.select(F.size(M._runs_of_small(F.col("tokens"), None, {2: ["t7"], 30: ["t7"], 70: ["t7"]}))).first()[0]
    assert runs == 3 and M.match_phrases(texts, lexicon).count() == 3


def test_scoring_by_join_equals_scoring_in_the_row(spark):
    texts = spark.createDataFrame(
        [(1, "a a a b  ab a"), (2, ""), (3, "aa a b\na"), (4, "a a")], "doc_id long, text string"
    )
    rows = [("k", "A", "a a", 1.0, 0), ("k", "A", "ab", 1.0, 1), ("k", "B", "a", 1.0, 2), ("k", "C", "q", 1.0, 3)]
    lexicon = spark.createDataFrame(rows, X.LEXICON_SCHEMA)
    found = [sorted((r.doc_id, r.scores) for r in f(texts, lexicon).collect()) for f in (K.score_categories, K.score_categories_by_join)]
    assert found[0] == found[1]
    held = K.score_categories_by_join(texts, lexicon, zeros=False).collect()
    assert [sorted((r.doc_id, [c for c in r.scores if c.score > 0]) for r in K.score_categories(texts, lexicon).collect())] == [
        sorted((r.doc_id, r.scores) for r in held)
    ]


def test_many_categories_leave_rows_small(spark):
    """5,000 categories: a row holds those of its text, and the prediction is that of the plain form."""
    rows = [("k", f"C{i:04}", f"w{i}", 1.0, i) for i in range(5000)]
    lexicon = spark.createDataFrame(rows, X.LEXICON_SCHEMA)
    texts = spark.createDataFrame([(1, "w7 w4000 w4000"), (2, "none"), (3, None), (4, "w9 W8")], "doc_id long, text string")
    held = {r.doc_id: [c.category for c in r.scores] for r in K.score_categories_by_join(texts, lexicon, zeros=False).collect()}
    assert held == {1: ["C0004", "C0007", "C0040", "C0400", "C4000"], 2: [], 3: [], 4: ["C0008", "C0009"]}
    few = lexicon.filter("ord in (0, 4, 7, 8, 9, 40, 400, 4000)")
    plain = {r.doc_id: (r.predicted_category, r.confidence) for r in K.predict(texts, few).collect()}
    found = {r.doc_id: (r.predicted_category, r.confidence) for r in K.predict(texts, lexicon).collect()}
    assert found == plain and found[2] == ("C0000", 0.0)


@pytest.mark.parametrize("limit", [64, 0])
def test_terms_of_a_list_in_the_row_and_joined(spark, limit):
    texts = [(1, "Project management, C++x and .NET"), (1, "sql"), (None, "SQL c++ a.net"), (2, None), (3, ""), (4, "x--y élan vital_"), (5, "projects management")]
    terms = [("sql", 1), ("project management", 0), ("c++", 2), (".net", 2), ("--", 3), ("élan", 3), ("vital", 3), ("sql", 1), ("", 0), (None, 0)]
    listed = spark.createDataFrame(terms, "term string, ord int")
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(((r.doc_id, r.text, r.terms) for r in with_terms(rows, listed, limit=limit).collect()), key=str)
    want = [(1, ["project management", "c++"]), (1, ["sql", "sql"]), (None, ["sql", "sql", ".net"]), (2, []), (3, []), (4, ["--", "élan"]), (5, [])]
    assert found == sorted(((d, t, w) for (d, t), (_, w) in zip(texts, want)), key=str)
    assert [r.terms for r in with_terms(rows, listed.limit(0), limit=limit).collect()] == [[]] * 7
    assert with_terms(rows.limit(0), listed, limit=limit).count() == 0


def test_results_do_not_depend_on_the_partitioning(spark, sf_dir):
    spans = X.spans(spark, sf_dir)
    a, b = (S.top_words(S.hidden_spans(s)).collect() for s in (spans, spans.repartition(13, "px")))
    assert sorted(a) == sorted(b) and a


def test_documents_lexicons_and_logs_from_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("one\ntwo")
    (tmp_path / "b.md").write_text("x")
    docs = A.document_metadata(A.read_documents(spark, str(tmp_path))).collect()
    assert [(r.text, r.file_type, r.page_count, r.title) for r in docs] == [("one\ntwo", "txt", 1, "a.TXT")]
    (tmp_path / "lexicon.json").write_text('{"B": ["x y"], "A": ["z", "c++"]}')
    rows = A.read_lexicon(spark, str(tmp_path / "lexicon.json"), "skill").orderBy("ord").collect()
    assert [(r.category, r.term) for r in rows] == [("B", "x y"), ("A", "z"), ("A", "c++")]
    lines = [f"line {i}" for i in range(5000)]
    (tmp_path / "run.log").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    read = A.read_run_log(spark, str(tmp_path / "run.log")).orderBy("line_no").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in read] == lines and [r.line_no for r in read] == list(range(1, 5001))


def test_term_scores_are_read_once(spark):
    """The verdict counts and ranks the strong terms in one pass over the largest table."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(1, f"t{k}", 0.0, 0.2) for k in range(8)] + [(2, "t", 0.5, 0.2)]
    table = spark.createDataFrame(rows, "doc_id long, term string, visible_score double, hidden_score double")
    sizes = spark.createDataFrame([(1, 9), (2, 9), (3, 2)], "doc_id long, hidden_tokens long")
    found = M.term_frequency_verdict(table.mapInPandas(count, table.schema), sizes).orderBy("doc_id").collect()
    assert [(r.n, r.suspicious, r.confidence) for r in found] == [(8, True, 1.0), (0, False, 0.0), (0, False, 0.0)]
    assert seen.value == len(rows)


def test_verdicts_are_stored_before_they_are_read_twice(spark, tmp_path):
    from docsieve.plans.registry import hidden

    lines = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(1, k, k, 1.0, float(k), 0.1 if k > 2 else 0.0, "A", "F") for k in range(1, 5)], lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"red bolt {k}") for k in range(1, 5)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found, sides = hidden._verdicts(spark, str(tmp_path))
    assert found.count() == 3 and sides.count() == 1
    for table in (found, sides):
        assert "parquet" not in table._jdf.queryExecution().optimizedPlan().toString().lower()


def test_long_lists_send_hashes_and_terms_only(spark):
    texts = spark.createDataFrame([(1, "Red bolt, c++ x"), (2, "a red\nbolt"), (None, "RED BOLT"), (1, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("red bolt", 0), ("Bolt", 1), ("c++", 1), ("c++ x", 2)], "term string, ord int")
    long, short = with_terms(texts, terms, limit=0), with_terms(texts, terms)
    assert sorted(map(str, long.collect())) == sorted(map(str, short.collect()))
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "pattern" not in plan and "hash(" in plan


def test_beginnings_meet_the_lexicon_before_they_are_sent(spark):
    """Of many words only those of the lexicon are made distinct over rows; repeated rows and terms count as before."""
    texts = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(500)) + " red bolt"), (1, "red"), (2, None), (None, "red bolt")], "doc_id long, text string")
    terms = spark.createDataFrame([("red", "a"), ("red", "a"), ("red bolt", "b"), ("w49", "c")], "term string, category string")
    found = K._terms_in(texts, terms, "text")
    rows = sorted((r.doc_id or 0, r.term, r.category) for r in found.collect())
    own = [("red", "a"), ("red", "a"), ("red bolt", "b")]
    assert rows == [(0, *x) for x in own] + [(1, *x) for x in [*own, ("w49", "c")]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate [") < plan.index("Join LeftSemi") < plan.index("Generate explode")


def test_tokens_of_runs_are_computed_once(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "a")], "doc_id long, text string")
    runs = texts.select("doc_id", F.explode(T.ngrams(T.words("text"), 2, 3)).alias("run"))
    assert sorted(r.run for r in runs.collect()) == ["a b", "a b c", "b c", "b c d", "c d"]
    for lo, hi in ((1, 1), (1, 3), (3, 4)):
        want = [" ".join("abcd"[i : i + n]) for n in range(lo, hi + 1) for i in range(5 - n)]
        assert texts.filter("doc_id = 1").select(T.ngrams(T.words("text"), lo, hi)).first()[0] == want
    one = texts.select(F.explode(T.ngrams(F.regexp_extract_all("text", F.lit(r"(\w+)")), 1, 3)))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_terms_of_short_documents_are_counted_by_document(spark):
    """Long and short documents together, null ids and pages; scores as without, and short ones send their chunks once."""
    words = ("ore bolt ring red small large and the x " * 3).split()
    rng = random.Random(9)
    rows = [(None if k % 11 == 0 else k % 5, rng.choice(["hidden", "visible"]), None if k == 7 else k // 5 * 16, " ".join(rng.choices(words, k=rng.randrange(4)))) for k in range(120)]
    chunks = spark.createDataFrame(rows, "doc_id long, side string, chunk long, text string").dropDuplicates(["doc_id", "side", "chunk"])
    want = sorted(map(str, M.side_tfidf(M.side_terms(chunks, ["the"])).collect()))
    assert want and "doc_id=None" not in want[0]
    for short in (64, 1, 10**6):
        assert sorted(map(str, M.term_scores(chunks, ["the"], short).collect())) == want
    plan = M.term_scores(chunks, short=10**6)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    runs = M.side_terms(chunks.repartition("doc_id"), by_document=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in runs and not any("hashpartitioning(doc_id" in x and "term" in x for x in runs.splitlines())


def test_sets_are_not_sent_with_each_of_their_tokens(spark):
    """Null ids and texts, repeated rows, signs that mean something in a pattern."""
    same = "a| b. c* d$ e\\ f"
    rows = [(1, "hidden", same), (1, "hidden", same), (1, "visible", "A|  b. c* d$ e\\"), (1, "hidden", "p q r s t"), (1, "hidden", None),
            (2, "hidden", same), (None, "hidden", same), (None, "visible", "a| b. c* d$ e\\"), (1, "visible", None), (1, "visible", " ")]
    table = spark.createDataFrame([(d, s, "ORG", t) for d, s, t in rows], "doc_id long, side string, label string, text string")
    found = M.entity_mismatches(table)
    kept = sorted(((r.doc_id, r.text, r.n) for r in found.collect()), key=str)
    assert kept == sorted([(1, "p q r s t", 1), (1, None, 1), (2, same, 1), (None, same, 1)], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "by_rarity" in plan and not re.search(r"Aggregate \[doc_id#\d+L?, label#\d+, s#\d+, tokens#\d+\]", plan)


def test_documents_of_the_analysis_are_read_once(spark):
    """Every stage reads them, from where they are kept; hidden text is put together once for all that searches it."""
    seen, kept = spark.sparkContext.accumulator(0), []

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def keep(df):
        kept.append(df.columns)
        return stored(df)

    rows = [(k, "Developer at Acme, Jan 1999 - Mar 2001. python" if k % 2 else "") for k in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    found = analyze(documents, lexicon=X.job_lexicon(spark), as_of="2002-01-15", stages=("features", "category", "turnover"), keep=keep)
    got = {r.doc_id: (r.job_count, r.predicted_category, r.word_count) for r in found.collect()}
    assert got == {k: (1.0, "Development", 9) if k % 2 else (0.0, "Development", 0) for k in range(40)}
    assert seen.value == len(rows)
    spans = [(k, 1, i, text, 16777215 if i else 0) for k in range(6) for i, text in enumerate(("a visible text", "red bolt", "bolt blue green"))]
    table = spark.createDataFrame(spans, "doc_id long, page int, span_no int, text string, color int").selectExpr("*", "'f' AS font", "1.0D AS size")
    kept.clear()
    section = hidden_section(table, keep=keep, keywords=("red", "bolt blue", "bolt bolt", "green"), phrase_lexicon=X.product_lexicon(spark))
    assert {r.doc_id: (r.hits, r.stuffing) for r in section.collect()} == {k: (["red", "bolt blue", "bolt bolt", "green"], True) for k in range(6)}
    assert [c for c in kept if "chunk" in c] == [["doc_id", "side", "chunk", "text", "spans"]]
    assert section._jdf.queryExecution().optimizedPlan().toString().count("listagg") == 0


def test_matches_in_texts_that_hold_the_mark(spark):
    texts = [("ab 12 \u0001 345",), ("\u000112",), ("none",), ("",), (None,), ("7",), ("😀 12 é 3",)]
    table = spark.createDataFrame(texts, "t string").select("t", matches("t", r"\d+").alias("m"))
    for r in table.collect():
        want = None if r.t is None else [(m.start(), m.group()) for m in re.finditer(r"\d+", r.t)]
        assert (None if r.m is None else [tuple(x) for x in r.m]) == want
    plan = spark.createDataFrame([("x",)], "t string").select(F.size(T.words("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # which compiles its pattern for every row


def test_long_lists_are_found_by_joins_alone(spark):
    """Neither do terms of usual lengths search a text, nor does a text travel that isn't asked for; every form agrees with the search."""
    draw = np.random.default_rng(2)
    bits = ["a", "bb", "É1", "c_d", "--", " ", ", ", "\n", "😀", ".", "B"]
    made = lambda n: "".join(draw.choice(bits, n))
    texts = [(k % 7 if k % 5 else None, made(draw.integers(0, 60))) for k in range(60)] + [(1, None), (2, ""), (3, "--"), (4, "x" * 3000)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    every = [(made(n), int(draw.integers(0, 2))) for n in range(1, 9) for _ in range(40)]
    every += [(f"a{', a' * n}", 0) for n in (3, 6, 9)] + [("--", 1), (" ", 0), (", ", 0), ("a ", 1), (" a", 1), ("", 0), (None, 0)]
    shown = lambda t: sorted(map(str, t.collect()))
    for some in (every, [t for t in every if t[0] in ("--", " ", ", ")], [t for t in every if t[0] and len(t[0]) > 20]):
        terms = spark.createDataFrame(some, "term string, ord int")
        assert shown(with_terms(table, terms, limit=0)) == shown(with_terms(table, terms, limit=10_000))
    plain = spark.createDataFrame([("a bb", 0), ("B, a", 0), ("bb", 1)], "term string, ord int")
    found = with_terms(table, plain, limit=0).select("doc_id", "terms")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "_lowered" not in plan
    assert shown(found) == shown(with_terms(table, plain).select("doc_id", "terms"))

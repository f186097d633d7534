"""Hidden text: span analytics and manipulation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve import fixtures as X
from docsieve.operators import manipulation as M
from docsieve.operators import spans as S
from docsieve.operators.lexicon import union_terms
from docsieve.plans.registry.texts import _STOP, ASCII, found_sql
from docsieve.session import cut_lineage
from docsieve.sources.files import to_detection_json

ORDER = X.SPAN_ORDER
STUFFING = ("red", "bolt", "small ring", "large widget", "green", "blue", "bolt red", "ring blue")


def _spans(spark, d):
    return X.spans(spark, d)


def _chunks(spark, d):
    return S.text_chunks(_spans(spark, d), ORDER)


def _b(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _r(*names, digits=6):
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]


# --- spans ----------------------------------------------------------------------------------------------------------


def c1_unpack_color(spark, d):
    return S.unpack_color(_spans(spark, d)).select(*_b("doc_id", "page", "pk", "r", "g", "b"), "px", "color_hex")


_RGB = "(color >> 16) & 255 AS r, (color >> 8) & 255 AS g, color & 255 AS b"
_HEX = "printf('#%02x%02x%02x', (color >> 16) & 255, (color >> 8) & 255, color & 255)"
C1 = f"""SELECT doc_id, CAST(page AS BIGINT) AS page, pk, px, CAST((color >> 16) & 255 AS BIGINT) AS r,
    CAST((color >> 8) & 255 AS BIGINT) AS g, CAST(color & 255 AS BIGINT) AS b, {_HEX} AS color_hex FROM spans"""


def c2_flag_hidden(spark, d):
    background = F.when(F.col("page") % 2 == 0, 0xFFFFFF).otherwise(0x111111)
    return S.flag_hidden(_spans(spark, d), background=background).select(
        *_b("doc_id", "page", "pk"), "px", "is_hidden", "is_background"
    )


C2 = f"""SELECT doc_id, CAST(page AS BIGINT) AS page, pk, px, {X.hidden_sql()} AS is_hidden,
    abs(((color >> 16) & 255) - bg) < 15 AND abs(((color >> 8) & 255) - bg) < 15 AND abs((color & 255) - bg) < 15 AS is_background
    FROM (SELECT *, CASE WHEN page % 2 = 0 THEN 255 ELSE 17 END AS bg FROM spans)"""


def c3_hidden_spans(spark, d):
    return S.hidden_spans(_spans(spark, d)).select(*_b("doc_id", "page", "pk", "color"), "text", "font", "size", "px")


C3 = f"""SELECT doc_id, CAST(page AS BIGINT) AS page, pk, CAST(color AS BIGINT) AS color, text, font, size, px
    FROM spans WHERE {X.hidden_sql()}"""


def _all_documents(spark, d):
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))


def c4_span_statistics(spark, d):
    stats = S.span_statistics(_spans(spark, d), _all_documents(spark, d))
    return stats.select("doc_id", *_b("total_spans", "unique_fonts", "unique_sizes", "unique_colors", "hidden_count"), *_r("hidden_percentage"))


STATS = f"""SELECT doc_id, count(*) AS total_spans, count(DISTINCT font) AS unique_fonts, count(DISTINCT size) AS unique_sizes,
    count(DISTINCT color) AS unique_colors, count(*) FILTER ({X.hidden_sql()}) AS hidden_count FROM spans GROUP BY doc_id"""
C4 = f"""SELECT o_orderkey AS doc_id, coalesce(total_spans, 0) AS total_spans, coalesce(unique_fonts, 0) AS unique_fonts,
    coalesce(unique_sizes, 0) AS unique_sizes, coalesce(unique_colors, 0) AS unique_colors, coalesce(hidden_count, 0) AS hidden_count,
    coalesce(round(hidden_count / total_spans * 100, 6), 0) AS hidden_percentage
    FROM orders LEFT JOIN ({STATS}) s ON o_orderkey = s.doc_id"""


def c5_color_distribution(spark, d):
    return S.color_distribution(_spans(spark, d)).select("doc_id", "color_hex", "n", *_r("percentage"))


C5 = f"""SELECT doc_id, {_HEX} AS color_hex, count(*) AS n,
    round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS DOUBLE) * 100, 6) AS percentage FROM spans GROUP BY doc_id, color"""


def c6_hidden_content(spark, d):
    chunks = _chunks(spark, d)
    both = S.side_content(chunks, "hidden").withColumn("side", F.lit("hidden")).unionByName(
        S.side_content(chunks, "visible").withColumn("side", F.lit("visible"))
    )
    return both.select("doc_id", "side", "content", *_b("span_count"))


CONTENT = """SELECT doc_id, side, string_agg(text, ' ' ORDER BY page, pk, px) AS content, count(*) AS span_count
    FROM sided GROUP BY doc_id, side"""
C6 = CONTENT


def c7_top_words(spark, d):
    """Per page over all documents as well as per document: both have ties to break."""
    per_doc = S.top_words(S.hidden_spans(_spans(spark, d)))
    return per_doc.select("doc_id", "word", *_b("n", "rank"))


C7 = f"""SELECT * FROM (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank
    FROM (SELECT doc_id, word, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM spans WHERE {X.hidden_sql()}) GROUP BY ALL))
    WHERE rank <= 20"""


def _hits(spark, d):
    return S.keyword_hits(_chunks(spark, d), STUFFING, more_than=3)


def c8_keyword_hits(spark, d):
    return _hits(spark, d).select("doc_id", F.array_join("hits", ",").alias("hits"))


_HIT = ", ".join(f"CASE WHEN contains(lower(content), '{k}') THEN '{k}' END" for k in STUFFING)
HITS = f"SELECT doc_id, list_filter([{_HIT}], lambda x: x IS NOT NULL) AS hits FROM ({CONTENT}) WHERE side = 'hidden'"
C8 = f"SELECT doc_id, array_to_string(hits, ',') AS hits FROM ({HITS})"


def c9_stuffing_flag(spark, d):
    return _hits(spark, d).select("doc_id", "stuffing")


C9 = f"SELECT doc_id, len(hits) > 3 AS stuffing FROM ({HITS})"


def c10_locate_hidden(spark, d):
    spans = _spans(spark, d)
    located = S.locate_hidden(S.hidden_spans(spans), X.layout(spans))
    return located.select(*_b("doc_id", "page"), "text", "font", "size", *_b("x0", "y0", "x1", "y1", "times"))


C10 = f"""SELECT l.doc_id, CAST(l.page AS BIGINT) AS page, l.text, l.font, l.size,
    CAST(trunc(l.size * 2) AS BIGINT) AS x0, CAST(trunc(l.page * 10 * 2) AS BIGINT) AS y0,
    CAST(trunc((l.size + 5.5) * 2) AS BIGINT) AS x1, CAST(trunc((l.page * 10 + 8.25) * 2) AS BIGINT) AS y1, h.times
    FROM spans l JOIN (SELECT doc_id, page, text, font, size, count(*) AS times FROM spans WHERE {X.hidden_sql()} GROUP BY ALL) h
    USING (doc_id, page, text, font, size)"""


# --- term frequency -------------------------------------------------------------------------------------------------


def _scores(spark, d):
    return M.term_scores(_chunks(spark, d), X.STOP_WORDS)


def d1_side_tfidf(spark, d):
    return _scores(spark, d).select("doc_id", "term", "visible_score", "hidden_score")


_W = f"list_filter(regexp_split_to_array(lower(content), ' '), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))"
TERMS = f"""SELECT doc_id, term, count(*) FILTER (side = 'visible') AS v, count(*) FILTER (side = 'hidden') AS h
    FROM (SELECT doc_id, side, unnest(list_concat(w,
        list_transform(generate_series(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1])),
        list_transform(generate_series(1, len(w) - 2), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])))) AS term
    FROM (SELECT doc_id, side, {_W} AS w FROM ({CONTENT}))) GROUP BY doc_id, term"""
TFIDF = f"""SELECT doc_id, term, coalesce(round(vw / nullif(sqrt(sum(vw * vw) OVER (PARTITION BY doc_id)), 0), 9), 0) AS vs,
    coalesce(round(hw / nullif(sqrt(sum(hw * hw) OVER (PARTITION BY doc_id)), 0), 9), 0) AS hs
    FROM (SELECT *, v * idf AS vw, h * idf AS hw FROM (SELECT *,
        ln(3.0 / (1 + CASE WHEN v > 0 THEN 1 ELSE 0 END + CASE WHEN h > 0 THEN 1 ELSE 0 END)) + 1 AS idf FROM ({TERMS})))"""
D1 = f"SELECT doc_id, term, vs AS visible_score, hs AS hidden_score FROM ({TFIDF})"


def d2_significant_terms(spark, d):
    found = M.significant_terms(_scores(spark, d))
    return found.select("doc_id", "term", "visible_score", "hidden_score", *_r("ratio"), *_b("rank"))


D2 = f"""SELECT * FROM (SELECT doc_id, term, vs AS visible_score, hs AS hidden_score,
    round(hs / greatest(vs, 0.001), 6) AS ratio,
    row_number() OVER (PARTITION BY doc_id ORDER BY round(hs - vs, 9) DESC, term) AS rank
    FROM ({TFIDF}) WHERE hs > 2 * vs AND hs > 0.1) WHERE rank <= 10"""


def d3_term_frequency_verdict(spark, d):
    chunks = cut_lineage(_chunks(spark, d))  # read for the terms and for the sizes
    tfidf = M.term_scores(chunks, X.STOP_WORDS)
    return M.term_frequency_verdict(tfidf, M.hidden_tokens(chunks, X.STOP_WORDS)).select(*M.VERDICT)


SIZES = f"""SELECT doc_id, len(list_filter(regexp_split_to_array(lower(content), ' '), lambda x: x NOT IN ({_STOP}))) AS hidden_tokens,
    len(regexp_split_to_array(content, ' ')) AS hidden_words FROM ({CONTENT}) WHERE side = 'hidden'"""
D3 = f"""SELECT doc_id, 'term_frequency' AS method, n >= 3 AS suspicious, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END AS confidence, n
    FROM (SELECT s.doc_id, CASE WHEN hidden_tokens >= 3 THEN coalesce(n, 0) ELSE 0 END AS n FROM ({SIZES}) s
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({TFIDF}) WHERE hs > 2 * vs AND hs > 0.1 GROUP BY doc_id) USING (doc_id))"""


# --- phrases --------------------------------------------------------------------------------------------------------


def _phrases(spark, d):
    return M.match_phrases(_chunks(spark, d), X.product_lexicon(spark))


def d4_match_phrases(spark, d):
    return _phrases(spark, d).select("doc_id", "side", "kind", "category", "phrase", *_b("n"))


def _phrase_sql(source: str, keys: str, lexicon: str) -> str:
    padded = f"SELECT {keys}, concat(' ', array_to_string(list_filter(regexp_split_to_array(lower({{c}}), '[^a-z0-9]+'), lambda x: x <> ''), '  '), ' ') AS t FROM ({source})"
    return padded, f"""SELECT {keys}, kind, category, term AS phrase, (length(t) - length(replace(t, p, ''))) // length(p) AS n
        FROM ({{padded}}) , (SELECT *, concat(' ', replace(term, ' ', '  '), ' ') AS p FROM {lexicon}) WHERE contains(t, p)"""


_padded, _matched = _phrase_sql(CONTENT, "doc_id, side", "product_lexicon")
PHRASES = _matched.format(padded=_padded.format(c="content"))
D4 = f"SELECT doc_id, side, kind, category, phrase, CAST(n AS BIGINT) AS n FROM ({PHRASES})"


def d4_match_phrases_documents(spark, d):
    """Phrase matching over whole documents with the language lexicon."""
    texts = X.documents(spark, d)
    return M.match_phrases(texts, X.language_lexicon(spark)).select("doc_id", "kind", "category", "phrase", *_b("n"))


D4_DOCUMENTS = r"""SELECT doc_id, kind, category, term AS phrase, count(*) AS n FROM
    (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) JOIN language_lexicon ON w = term
    GROUP BY ALL"""


def d5_hidden_only_terms(spark, d):
    return M.hidden_only_terms(_phrases(spark, d))


HIDDEN_ONLY = f"""SELECT DISTINCT doc_id, kind, phrase AS term FROM ({PHRASES}) h WHERE side = 'hidden' AND NOT EXISTS
    (SELECT 1 FROM ({PHRASES}) v WHERE v.side = 'visible' AND v.doc_id = h.doc_id AND v.kind = h.kind AND v.phrase = h.phrase)"""


def d6_term_category_counts(spark, d):
    return M.term_category_counts(_phrases(spark, d)).select("doc_id", "kind", "category", *_b("n"))


D6 = f"SELECT doc_id, kind, category, CAST(sum(n) AS BIGINT) AS n FROM ({PHRASES}) WHERE side = 'hidden' GROUP BY ALL"


def d7_lexicon_verdict(spark, d):
    chunks = _chunks(spark, d)
    counts = M.match_phrases(chunks, X.product_lexicon(spark))
    documents = M.hidden_tokens(chunks)
    return M.lexicon_verdict(documents, M.hidden_only_terms(counts)).select(*M.VERDICT)


D7 = f"""SELECT doc_id, 'industry_terms' AS method, coalesce(n, 0) >= 5 AS suspicious,
    least(1.0::DOUBLE, coalesce(n, 0) / 10) AS confidence, coalesce(n, 0) AS n
    FROM (SELECT doc_id FROM ({SIZES})) LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({HIDDEN_ONLY}) GROUP BY doc_id) USING (doc_id)"""


# --- patterns -------------------------------------------------------------------------------------------------------


def _patterns(spark, d):
    return M.suspicious_patterns(X.pattern_docs(spark, d))


def d8_suspicious_patterns(spark, d):
    found = _patterns(spark, d).filter("pattern <> 'repeated_word'")
    return found.select("doc_id", "pattern", *_b("offset", "length"), "match")


_ITEM = r"\b\w+\b[,.;]"
_HEAD = r"\b[^\n]{0,30}?[:\-–]"
_RE2 = {
    "skill_list": rf"(?i)\b(?:skills|expertise|proficient|proficiency|experience)s?{_HEAD}[^\n]{{0,200}}?{_ITEM}(?:[^\n]{{0,10}}?{_ITEM}){{9,}}",
    "meta_tags": rf"(?i)\b(?:keywords|tags|meta|seo){_HEAD}[^\n]{{0,200}}",
    "job_title": rf"(?i)\b(?:job\s+title|position|role){_HEAD}[^\n]{{0,100}}",
    "delimited_list": r"(?i)(?:\b\w+\b[,.;]\s*){10,}",
}
_ASCII_DOCS = f"SELECT doc_id, {ASCII.format(c='text')} AS text, text AS original FROM pattern_docs"
PATTERNS = " UNION ALL ".join(
    f"""SELECT doc_id, '{name}' AS pattern, "offset", CAST(length(match) AS BIGINT) AS length,
        substring(original, "offset" + 1, length(match)) AS match FROM ({found_sql(f"({_ASCII_DOCS})", "doc_id, original", regex)})
        WHERE length(match) > 10"""
    for name, regex in _RE2.items()
)
D8 = f"""SELECT doc_id, pattern, "offset", length, CASE WHEN length > 100 THEN concat(substring(match, 1, 100), '...') ELSE match END AS match
    FROM ({PATTERNS})"""


def d8_repeated_words(spark, d):
    """Documents in which a word is repeated three times in a row, with the number of such places."""
    found = M.suspicious_patterns(X.pattern_docs(spark, d), min_length=0).filter("pattern = 'repeated_word'")
    return found.select("doc_id", *_b("offset"))


# The start of every run: a word equal to the next one, and to the start of the one after, with only whitespace between.
# A run may begin inside what an earlier one took only after its end, so runs are told apart by gaps and islands.
_WORDS_AT = found_sql("(SELECT doc_id, lower(text) AS text, text AS raw FROM pattern_docs)", "doc_id", r"[\p{L}\p{N}_]+")
REPEATED = rf"""SELECT doc_id, min("offset") AS "offset" FROM (
    SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY match_no) AS island FROM (
    SELECT doc_id, match_no, "offset", match, coalesce(match = lag(match) OVER w
        AND regexp_full_match(substring(text, p + 1, "offset" - p), '\s+'), false) AS same,
        coalesce(starts_with(lead(match) OVER w, match), false)
            AND regexp_full_match(substring(text, e + 1, lead("offset") OVER w - e), '\s+') AS grows
    FROM (SELECT *, "offset" + length(match) AS e, lag("offset" + length(match)) OVER (PARTITION BY doc_id ORDER BY match_no) AS p
          FROM ({_WORDS_AT})) WINDOW w AS (PARTITION BY doc_id ORDER BY match_no)))
    GROUP BY doc_id, island HAVING count(*) >= 3 OR (count(*) = 2 AND bool_or(grows AND same))"""


def d9_pattern_verdict(spark, d):
    """All five families; repeated words count at any length, as in ``d8_repeated_words``."""
    docs = X.pattern_docs(spark, d)
    found = M.suspicious_patterns(docs, min_length=0).filter("length > 10 or pattern = 'repeated_word'")
    verdict = M.pattern_verdict(docs, found)
    return verdict.select("doc_id", "method", "suspicious", *_r("confidence"), "n")


D9 = f"""SELECT doc_id, 'patterns' AS method, coalesce(n, 0) >= 1 AS suspicious, round(least(1.0::DOUBLE, coalesce(n, 0) / 3), 6) AS confidence,
    coalesce(n, 0) AS n FROM pattern_docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM (
    SELECT doc_id FROM ({PATTERNS}) UNION ALL SELECT doc_id FROM ({REPEATED})) GROUP BY doc_id) USING (doc_id)"""


# --- vectors and intent ---------------------------------------------------------------------------------------------


def vector_pairs(spark, d):
    vectors = X.table(spark, d, "embeddings")
    visible = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("visible_vec"))
    following = vectors.select((F.col("vec_id") - 1).alias("doc_id"), F.col("embedding").cast("array<double>").alias("next_vec"))
    middle = F.zip_with("visible_vec", "next_vec", lambda a, b: (a + b) / 2)
    kind = F.col("doc_id") % 3
    hidden = F.when(kind == 0, F.col("visible_vec")).when(kind == 1, middle).otherwise(F.col("next_vec"))
    return visible.join(following, "doc_id").select("doc_id", "visible_vec", hidden.alias("hidden_vec"))


def d10_vector_similarity(spark, d):
    return M.vector_similarity(vector_pairs(spark, d)).select("doc_id", *_r("similarity"))


SIMILAR = """SELECT doc_id, list_sum(list_transform(generate_series(1, len(a)), lambda i: a[i] * b[i]))
    / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))) AS s
    FROM (SELECT v.vec_id AS doc_id, CAST(v.embedding AS DOUBLE[]) AS a, CASE v.vec_id % 3 WHEN 0 THEN CAST(v.embedding AS DOUBLE[])
        WHEN 1 THEN list_transform(generate_series(1, len(v.embedding)), lambda i: (CAST(v.embedding[i] AS DOUBLE) + CAST(n.embedding[i] AS DOUBLE)) / 2)
        ELSE CAST(n.embedding AS DOUBLE[]) END AS b FROM embeddings v JOIN embeddings n ON n.vec_id = v.vec_id + 1)"""
D10 = f"SELECT doc_id, round(s, 6) AS similarity FROM ({SIMILAR})"


def d11_similarity_verdict(spark, d):
    verdict = M.similarity_verdict(M.vector_similarity(vector_pairs(spark, d)))
    return verdict.select("doc_id", "method", "suspicious", *_r("confidence"))


D11 = f"""SELECT doc_id, 'semantic_similarity' AS method, s < 0.3 OR s > 0.95 AS suspicious,
    round(CASE WHEN s < 0.3 THEN 1 - s / 0.3 WHEN s > 0.95 THEN (s - 0.95) * 20 ELSE 0 END, 6) AS confidence FROM ({SIMILAR})"""

_LABELS = {
    "signup": "keyword stuffing",
    "view": "relevant skills",
    "click": "job qualifications",
    "purchase": "personal information",
    "error": "legitimate content",
}


def intent_scores(spark, d):
    label = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _LABELS.items()])
    sums = X.table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id"), label.alias("label")).agg(F.sum("value").alias("s"))
    totals = sums.groupBy("doc_id").agg(F.sum("s").alias("t"))
    return sums.join(totals, "doc_id").select("doc_id", "label", F.round(F.col("s") / F.col("t"), 9).alias("score"))


def d12_intent_verdict(spark, d):
    verdict = M.intent_verdict(intent_scores(spark, d))
    return verdict.select("doc_id", "method", "suspicious", *_r("confidence"), "top_label", "second_label")


_LABEL_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " END"
D12 = f"""SELECT doc_id, 'intent' AS method, top_label = 'keyword stuffing' AS suspicious,
    CASE WHEN top_label = 'keyword stuffing' THEN round(score, 6) ELSE 0 END AS confidence, top_label, second_label FROM (
    SELECT doc_id, max(label) FILTER (rank = 1) AS top_label, max(score) FILTER (rank = 1) AS score, max(label) FILTER (rank = 2) AS second_label
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rank FROM (
        SELECT user_id AS doc_id, {_LABEL_CASE} AS label, round(sum(value) / sum(sum(value)) OVER (PARTITION BY user_id), 9) AS score
        FROM events GROUP BY user_id, event_type)) GROUP BY doc_id)"""


# --- entities -------------------------------------------------------------------------------------------------------


def gazetteer(spark, d):
    """Chosen lexicon categories, extra words, and the names of parts that cost less than average, from the whole table."""
    chosen = union_terms(X.product_lexicon(spark), {"skill": ["size"], "industry": ["part"]}, ["Anvil", "GREEN"])
    parts = X.table(spark, d, "part")
    mean = parts.agg(F.avg("p_retailprice").alias("mean")).scalar()
    named = parts.groupBy(F.lower("p_name").alias("term")).agg(F.avg("p_retailprice").alias("price"))
    cheap = named.filter(F.col("price") < mean).select("term")
    return chosen.unionByName(cheap).distinct()


def d13_build_gazetteer(spark, d):
    return gazetteer(spark, d)


GAZETTEER = """SELECT lower(term) AS term FROM product_lexicon WHERE (kind = 'skill' AND category = 'size') OR (kind = 'industry' AND category = 'part')
    UNION SELECT unnest(['anvil', 'green']) UNION SELECT lower(p_name) FROM part GROUP BY lower(p_name)
        HAVING avg(p_retailprice) < (SELECT avg(p_retailprice) FROM part)"""


def d14_drop_gazetteer_entities(spark, d):
    kept = M.drop_gazetteer_entities(X.entities(spark, d), gazetteer(spark, d))
    return kept.groupBy("doc_id", "side", "label", "text").agg(F.count("*").alias("n"))


KEPT_ENTITIES = r"""SELECT e.* FROM entities e WHERE side = 'visible' OR NOT (lower(text) IN (SELECT term FROM gazetteer)
    OR EXISTS (SELECT 1 FROM gazetteer g WHERE list_contains(regexp_split_to_array(lower(e.text), '\s+'), g.term)))"""
D14 = f"""WITH g AS ({GAZETTEER}) SELECT doc_id, side, label, text, count(*) AS n FROM entities e
    WHERE side = 'visible' OR NOT (lower(text) IN (SELECT term FROM g)
        OR EXISTS (SELECT 1 FROM g WHERE list_contains(regexp_split_to_array(lower(e.text), '\\s+'), g.term))) GROUP BY ALL"""


def d15_entity_mismatches(spark, d):
    return M.entity_mismatches(X.entities(spark, d)).select("doc_id", "label", "text", *_b("n"))


_SET = r"list_distinct(regexp_split_to_array(lower({c}.text), '\s+'))"
MISMATCHES = f"""SELECT doc_id, label, lower(text) AS text, count(*) AS n FROM entities h WHERE side = 'hidden' AND label <> 'DATE' AND NOT EXISTS (
    SELECT 1 FROM entities v WHERE v.side = 'visible' AND v.doc_id = h.doc_id AND v.label = h.label
    AND len(list_intersect({_SET.format(c='h')}, {_SET.format(c='v')}))
        >= 0.8 * len(list_distinct(list_concat({_SET.format(c='h')}, {_SET.format(c='v')})))) GROUP BY ALL"""


def d15_entity_mismatches_long_names(spark, d):
    """Sentences of conversations as entities: long token sets, where similar but unequal ones exist."""
    return M.entity_mismatches(_long_entities(spark, d)).select("doc_id", "label", "text", *_b("n"))


def _long_entities(spark, d):
    """Turns cut into sentences; a sentence also appears on the other side with its first word left out."""
    turns = X.table(spark, d, "conversations")
    sentence = turns.select("conv_id", "turn", F.explode(F.split("text", r"[.\n]+")).alias("s")).filter("length(s) > 0")
    whole = sentence.select(
        F.col("conv_id").alias("doc_id"), F.when(F.col("turn") % 2 == 0, "hidden").otherwise("visible").alias("side"), F.col("s").alias("text")
    )
    short = sentence.filter("turn % 2 = 0").select(
        F.col("conv_id").alias("doc_id"), F.lit("visible").alias("side"), F.regexp_replace("s", r"^\s*\S+\s", "").alias("text")
    )
    return whole.unionByName(short).withColumn("label", F.lit("ORG"))


_LONG = r"""SELECT doc_id, side, 'ORG' AS label, text FROM (
    SELECT conv_id AS doc_id, CASE WHEN turn % 2 = 0 THEN 'hidden' ELSE 'visible' END AS side, s AS text FROM sentences
    UNION ALL SELECT conv_id, 'visible', regexp_replace(s, '^\s*\S+\s', '') FROM sentences WHERE turn % 2 = 0)"""
_SENTENCES = r"SELECT * FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.\n]+')) AS s FROM conversations) WHERE length(s) > 0"
_LSET = r"list_filter(list_distinct(regexp_split_to_array(lower({c}.text), '\s+')), lambda x: x <> '')"
D15_LONG = f"""WITH sentences AS ({_SENTENCES}), long_entities AS ({_LONG})
    SELECT doc_id, label, lower(text) AS text, count(*) AS n FROM long_entities h WHERE side = 'hidden' AND NOT EXISTS (
    SELECT 1 FROM long_entities v WHERE v.side = 'visible' AND v.doc_id = h.doc_id AND len({_LSET.format(c='h')}) > 0 AND len({_LSET.format(c='v')}) > 0
    AND len(list_intersect({_LSET.format(c='h')}, {_LSET.format(c='v')})) * 10
        >= 8 * len(list_distinct(list_concat({_LSET.format(c='h')}, {_LSET.format(c='v')})))) GROUP BY ALL"""


def d16_context_verdict(spark, d):
    sizes = M.hidden_tokens(_chunks(spark, d))
    verdict = M.context_verdict(sizes, M.entity_mismatches(X.entities(spark, d)), min_words=5)
    return verdict.select("doc_id", "method", "suspicious", *_r("confidence"), "n")


D16 = f"""SELECT doc_id, 'context_relevance' AS method, n >= 3 AS suspicious, round(least(1.0::DOUBLE, n / 5), 6) AS confidence, n FROM (
    SELECT doc_id, CAST(CASE WHEN hidden_words >= 5 THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS n FROM ({SIZES})
    LEFT JOIN (SELECT doc_id, sum(n) AS n FROM ({MISMATCHES}) GROUP BY doc_id) USING (doc_id))"""


# --- verdict --------------------------------------------------------------------------------------------------------


def _verdicts(spark, d):
    """Chunks and verdicts are stored: the tests and what is made of them read both several times."""
    chunks = cut_lineage(_chunks(spark, d))
    sizes = M.hidden_tokens(chunks, X.STOP_WORDS)
    tfidf = M.term_scores(chunks, X.STOP_WORDS)
    phrases = M.match_phrases(chunks, X.product_lexicon(spark))
    found = (
        M.term_frequency_verdict(tfidf, sizes)
        .unionByName(M.lexicon_verdict(sizes, M.hidden_only_terms(phrases), min_terms=2, full=3))
        .unionByName(M.context_verdict(sizes, M.entity_mismatches(X.entities(spark, d)), min_words=4, min_count=2, full=4))
    )
    sides = chunks.groupBy("doc_id").agg(
        F.bool_or(F.col("side") == "hidden").alias("has_hidden"), F.bool_or(F.col("side") == "visible").alias("has_visible")
    )
    return cut_lineage(found), sides


_LEX = f"""SELECT doc_id, 'industry_terms' AS method, coalesce(n, 0) >= 2 AS suspicious, least(1.0::DOUBLE, coalesce(n, 0) / 3) AS confidence,
    coalesce(n, 0) AS n FROM (SELECT doc_id FROM ({SIZES})) LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({HIDDEN_ONLY}) GROUP BY doc_id) USING (doc_id)"""
_CTX = f"""SELECT doc_id, 'context_relevance' AS method, n >= 2 AS suspicious, least(1.0::DOUBLE, n / 4) AS confidence, n FROM (
    SELECT doc_id, CAST(CASE WHEN hidden_words >= 4 THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS n FROM ({SIZES})
    LEFT JOIN (SELECT doc_id, sum(n) AS n FROM ({MISMATCHES}) GROUP BY doc_id) USING (doc_id))"""
VERDICTS = f"{D3} UNION ALL {_LEX} UNION ALL {_CTX}"
COMBINED = f"""SELECT s.doc_id, coalesce(flagged, false) AND has_hidden AND has_visible AS flagged,
    CASE WHEN has_hidden AND has_visible THEN coalesce(confidence, 0) ELSE 0 END AS confidence
    FROM (SELECT doc_id, bool_or(side = 'hidden') AS has_hidden, bool_or(side = 'visible') AS has_visible FROM sided GROUP BY doc_id) s
    LEFT JOIN (SELECT doc_id, bool_or(suspicious AND confidence >= 0.7) AS flagged,
        max(CASE WHEN suspicious AND confidence >= 0.7 THEN confidence END) AS confidence FROM ({VERDICTS}) GROUP BY doc_id) v ON v.doc_id = s.doc_id"""


def d17_combine_verdicts(spark, d):
    found, sides = _verdicts(spark, d)
    return M.combine_verdicts(found, sides=sides).select("doc_id", "flagged", *_r("confidence"))


D17 = f"SELECT doc_id, flagged, round(confidence, 6) AS confidence FROM ({COMBINED})"


def d18_verdict_summary(spark, d):
    found, sides = _verdicts(spark, d)
    return M.verdict_summary(found, M.combine_verdicts(found, sides=sides))


D18 = f"""SELECT c.doc_id, flagged, CASE WHEN flagged THEN concat(printf('Likely manipulation (confidence %.2f): ', confidence), parts)
    ELSE '{M.NEUTRAL}' END AS summary FROM ({COMBINED}) c LEFT JOIN (
    SELECT doc_id, concat_ws('; ', max(CASE WHEN method = 'term_frequency' THEN concat(n, ' over-weighted hidden terms') END),
        max(CASE WHEN method = 'industry_terms' THEN concat(n, ' lexicon terms only in hidden text') END),
        max(CASE WHEN method = 'context_relevance' THEN concat(n, ' entities foreign to the document') END)) AS parts
    FROM ({VERDICTS}) WHERE suspicious GROUP BY doc_id) p ON p.doc_id = c.doc_id"""


# --- report ---------------------------------------------------------------------------------------------------------


def a8_to_detection_json(spark, d):
    spans = _spans(spark, d)
    chunks = S.text_chunks(spans, ORDER)
    results = (
        S.span_statistics(spans)
        .join(S.side_content(chunks).select("doc_id", F.col("content").alias("hidden_text")), "doc_id", "left")
        .join(S.keyword_hits(chunks, STUFFING), "doc_id", "left")
        .withColumns({
            "path": F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")),
            "file_type": F.lit("pdf"),
            "page_count": F.lit(1),
            "has_hidden": F.col("hidden_count") > 0,
        })
    )
    j = to_detection_json(results)
    return j.select(
        "doc_id",
        F.get_json_object("json", "$.document_info.filename").alias("filename"),
        F.get_json_object("json", "$.detection_results.has_white_text").alias("has_white_text"),
        F.get_json_object("json", "$.detection_results.white_text_count").cast("bigint").alias("white_text_count"),
        F.get_json_object("json", "$.white_text_content").alias("content"),
        F.get_json_object("json", "$.potential_keywords").alias("keywords"),
    )


A8 = f"""SELECT s.doc_id, concat('/in/', s.doc_id, '.pdf') AS filename, CASE WHEN hidden_count > 0 THEN 'true' ELSE 'false' END AS has_white_text,
    hidden_count AS white_text_count, content,
    CASE WHEN hidden_count > 0 THEN concat('[', array_to_string(list_transform(hits, lambda x: concat('"', x, '"')), ','), ']') END AS keywords
    FROM ({STATS}) s LEFT JOIN (SELECT doc_id, content FROM ({CONTENT}) WHERE side = 'hidden') c ON c.doc_id = s.doc_id
    LEFT JOIN ({HITS}) h ON h.doc_id = s.doc_id"""

QUERIES = {
    "a8_to_detection_json": a8_to_detection_json,
    "c1_unpack_color": c1_unpack_color,
    "c2_flag_hidden": c2_flag_hidden,
    "c3_hidden_spans": c3_hidden_spans,
    "c4_span_statistics": c4_span_statistics,
    "c5_color_distribution": c5_color_distribution,
    "c6_hidden_content": c6_hidden_content,
    "c7_top_words": c7_top_words,
    "c8_keyword_hits": c8_keyword_hits,
    "c9_stuffing_flag": c9_stuffing_flag,
    "c10_locate_hidden": c10_locate_hidden,
    "d1_side_tfidf": d1_side_tfidf,
    "d2_significant_terms": d2_significant_terms,
    "d3_term_frequency_verdict": d3_term_frequency_verdict,
    "d4_match_phrases": d4_match_phrases,
    "d4_match_phrases_documents": d4_match_phrases_documents,
    "d5_hidden_only_terms": d5_hidden_only_terms,
    "d6_term_category_counts": d6_term_category_counts,
    "d7_lexicon_verdict": d7_lexicon_verdict,
    "d8_suspicious_patterns": d8_suspicious_patterns,
    "d8_repeated_words": d8_repeated_words,
    "d9_pattern_verdict": d9_pattern_verdict,
    "d10_vector_similarity": d10_vector_similarity,
    "d11_similarity_verdict": d11_similarity_verdict,
    "d12_intent_verdict": d12_intent_verdict,
    "d13_build_gazetteer": d13_build_gazetteer,
    "d14_drop_gazetteer_entities": d14_drop_gazetteer_entities,
    "d15_entity_mismatches": d15_entity_mismatches,
    "d15_entity_mismatches_long_names": d15_entity_mismatches_long_names,
    "d16_context_verdict": d16_context_verdict,
    "d17_combine_verdicts": d17_combine_verdicts,
    "d18_verdict_summary": d18_verdict_summary,
}
ORACLE = {
    name: X.oracle(sql)
    for name, sql in {
        "a8_to_detection_json": A8,
        "c1_unpack_color": C1,
        "c2_flag_hidden": C2,
        "c3_hidden_spans": C3,
        "c4_span_statistics": C4,
        "c5_color_distribution": C5,
        "c6_hidden_content": C6,
        "c7_top_words": C7,
        "c8_keyword_hits": C8,
        "c9_stuffing_flag": C9,
        "c10_locate_hidden": C10,
        "d1_side_tfidf": D1,
        "d2_significant_terms": D2,
        "d3_term_frequency_verdict": D3,
        "d4_match_phrases": D4,
        "d4_match_phrases_documents": D4_DOCUMENTS,
        "d5_hidden_only_terms": HIDDEN_ONLY,
        "d6_term_category_counts": D6,
        "d7_lexicon_verdict": D7,
        "d8_suspicious_patterns": D8,
        "d8_repeated_words": REPEATED,
        "d9_pattern_verdict": D9,
        "d10_vector_similarity": D10,
        "d11_similarity_verdict": D11,
        "d12_intent_verdict": D12,
        "d13_build_gazetteer": GAZETTEER,
        "d14_drop_gazetteer_entities": D14,
        "d15_entity_mismatches": MISMATCHES,
        "d15_entity_mismatches_long_names": D15_LONG,
        "d16_context_verdict": D16,
        "d17_combine_verdicts": D17,
        "d18_verdict_summary": D18,
    }.items()
}

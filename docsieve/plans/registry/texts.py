"""Text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve import fixtures as X
from docsieve.functions import matching as R
from docsieve.functions import text as T
from docsieve.operators.terms import normalise_terms, with_terms
from docsieve.session import small_table

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_PUNCT = T.PUNCTUATION.replace("'", "''")
# Whitespace-separated words of a column.
_WORDS = r"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '')"


def _documents(spark, d):
    return X.documents(spark, d, "lang")


def b1_clean_text(spark, d):
    return _documents(spark, d).select("doc_id", T.clean_text("text").alias("clean"))


# Letters are mapped to ASCII in a copy of the same length where a boundary matters.
ASCII = "translate({c}, 'éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ', 'eoencueaosiEENOCAEUOI')"

_CLEAN = (
    r"regexp_replace(regexp_replace(regexp_replace(lower(text), '\S*@\S*\s?', '', 'g'), 'http\S+', '', 'g'),"
    r" '\b(?:\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b', '', 'g')"
)
B1_SQL = rf"SELECT doc_id, regexp_replace(translate({_CLEAN}, '{_PUNCT}', ''), '\d+', '', 'g') AS clean FROM documents"


def b2_tokens(spark, d):
    return _documents(spark, d).select("doc_id", T.tokens(T.clean_text("text"), X.STOP_WORDS).alias("tokens"))


B2_SQL = f"""SELECT doc_id, array_to_string(list_filter({_WORDS.format(c='clean')}, lambda x: x NOT IN ({_STOP})), ' ') AS tokens
    FROM ({B1_SQL})"""


def b3_normalise_terms(spark, d):
    lemmas = small_table(spark, list(X.LEMMAS.items()), "form string, lemma string")
    tokens = _documents(spark, d).select("doc_id", T.words(T.clean_text("text")).alias("tokens"))
    return normalise_terms(tokens, lemmas).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


_LEMMA_CASE = "CASE x " + " ".join(f"WHEN '{f}' THEN '{l}'" for f, l in X.LEMMAS.items()) + " ELSE x END"
B3_SQL = f"""SELECT doc_id, array_to_string(list_transform({_WORDS.format(c='clean')}, lambda x: {_LEMMA_CASE}), ' ') AS tokens
    FROM ({B1_SQL})"""


def b4_match_form(spark, d):
    return _documents(spark, d).select("doc_id", T.match_form("text", X.STOP_WORDS).alias("form"))


# Words with outer symbols stripped, kept if only letters and digits are left.
_PLAIN = (
    r"list_filter(list_transform(regexp_split_to_array(lower({c}), '\s+'),"
    r" lambda x: regexp_replace(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '')),"
    r" lambda x: regexp_full_match(x, '[\p{{L}}\p{{N}}]+') AND x NOT IN ({stop}))"
)
B4_SQL = f"SELECT doc_id, array_to_string({_PLAIN.format(c='text', stop=_STOP)}, ' ') AS form FROM documents"


def b5_token_features(spark, d):
    f = T.token_features("text")
    return _documents(spark, d).select(
        "doc_id",
        f["word_count"].cast("bigint").alias("word_count"),
        F.round(f["avg_word_length"], 6).alias("avg_word_length"),
        F.array_join(f["bigrams"], "|").alias("bigrams"),
    )


B5_SQL = f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS word_count,
    round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END, 6) AS avg_word_length,
    array_to_string(list_transform(generate_series(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1])), '|') AS bigrams
    FROM (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents)"""


def b6_basic_features(spark, d):
    f = T.basic_features("text")
    return _documents(spark, d).select("doc_id", *[c.cast("bigint").alias(n) for n, c in f.items()])


B6_SQL = f"""SELECT doc_id, CAST(len({_WORDS.format(c='text')}) AS BIGINT) AS word_count,
    CAST(length(text) AS BIGINT) AS char_count FROM documents"""


def b7_vocabulary_stats(spark, d):
    n = F.size(F.array_intersect(T.words("text"), F.array(*[F.lit(w) for w in X.STOP_WORDS])))
    f = T.vocabulary_stats("text", n)
    return _documents(spark, d).select(
        "doc_id",
        f["text_length"].cast("bigint").alias("text_length"),
        F.round(f["vocabulary_diversity"], 6).alias("vocabulary_diversity"),
        F.round(f["keyword_relevance"], 6).alias("keyword_relevance"),
    )


B7_SQL = f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length,
    round(len(list_distinct(w)) / greatest(1, len(w)), 6) AS vocabulary_diversity,
    round(least(1.0, CAST(0.15 AS DOUBLE) * len(list_distinct(list_filter(w, lambda x: x IN ({_STOP}))))), 6) AS keyword_relevance
    FROM (SELECT doc_id, text, {_WORDS.format(c='text')} AS w FROM documents)"""


def b8_find_terms(spark, d):
    return X.resumes(spark, d).select("candidate_id", F.array_join(R.find_terms("text", X.SKILLS), ",").alias("skills"))


_SKILL_CASES = ", ".join(
    rf"CASE WHEN regexp_matches(lower(text), '\b{s.replace('+', chr(92) + '+')}\b') THEN '{s}' END" for s in X.SKILLS
)
B8_SQL = X.oracle(f"SELECT candidate_id, concat_ws(',', {_SKILL_CASES}) AS skills FROM resumes")


def b8_find_terms_long_list(spark, d):
    """The first two words of every line are the terms: thousands, so that they are joined."""
    texts = X.documents(spark, d)
    heads = F.regexp_extract_all("text", F.lit(r"(?:^|\n)([^ \n]+ [^ \n]+)"), F.lit(1))
    terms = texts.select(F.explode(heads).alias("term"), F.lit(0).alias("ord")).distinct()
    return with_terms(texts, terms).select("doc_id", F.array_join("terms", "|").alias("terms"))


# Lower-cased texts have their capitals free to stand for the letters that the other engine's boundaries don't know.
_BOUNDED = "translate(lower({c}), 'éóèñçüêäößí', 'ABCDEFGHIJK')"
B8_LONG_SQL = rf"""WITH terms AS (SELECT DISTINCT term,
        '\b' || regexp_replace({_BOUNDED.format(c='term')}, '([^\w\s])', '\\\1', 'g') || '\b' AS pattern
    FROM (SELECT unnest(regexp_extract_all(text, '(?:^|\n)([^ \n]+ [^ \n]+)', 1)) AS term FROM documents)),
    texts AS (SELECT doc_id, {_BOUNDED.format(c='text')} AS text FROM documents),
    words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\w+')) AS word FROM texts),
    found AS (SELECT doc_id, term FROM words JOIN terms ON word = regexp_extract({_BOUNDED.format(c='term')}, '\w+')
        JOIN texts USING (doc_id) WHERE contains(text, {_BOUNDED.format(c='term')}) AND regexp_matches(text, pattern))
    SELECT d.doc_id, coalesce(string_agg(term, '|' ORDER BY term), '') AS terms
    FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


def b9_find_with_context(spark, d):
    found = R.find_with_context(X.resumes(spark, d), "text", R.EMPLOYMENT_RANGE)
    return found.select("candidate_id", *[F.col(c).cast("bigint").alias(c) for c in ("match_no", "offset")], "match", "context")


_Y, _M, _D, _N = r"(?:19|20)\d{2}", r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*", r"\s*[-–—]\s*", "(?:Present|Current|Now)"
RANGE_RE2 = (
    rf"\b{_Y}{_D}(?:{_Y}|{_N})\b|\b{_M} {_Y}{_D}{_M} {_Y}\b|\b{_M} {_Y}{_D}{_N}\b|\b{_M} {_Y}\s*to\s*{_M} {_Y}\b"
)


def found_sql(source: str, key: str, pattern: str, text: str = "text") -> str:
    """Matches with number, offset and surroundings: offsets add up from the parts between the matches."""
    return rf"""SELECT {key}, k - 1 AS match_no, pos AS "offset", m[k] AS match,
        substring({text}, greatest(0, pos - 100) + 1, pos + length(m[k]) + 100 - greatest(0, pos - 100)) AS context, {text}
        FROM (SELECT *, CAST(coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0)
              + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
        FROM (SELECT *, unnest(generate_series(1, len(m))) AS k
        FROM (SELECT {key}, {text}, regexp_extract_all({text}, '{pattern}') AS m,
              regexp_split_to_array({text}, '{pattern}') AS p FROM {source})))"""


B9_SQL = X.oracle(f'SELECT candidate_id, match_no, "offset", match, context FROM ({found_sql("resumes", "candidate_id", RANGE_RE2)})')


def b10_education_contexts(spark, d):
    found = R.education_contexts(X.resumes(spark, d), "text")
    return found.select("candidate_id", F.col("pattern_no").cast("bigint").alias("pattern_no"), "match", "context")


_DEGREES = (
    r"\b(?:Bachelor|Master|PhD|Doctorate|BSc|MSc|BA|MA|MD|JD|MBA)\b",
    r"\b(?:Bachelor''s|Master''s|Doctoral|Graduate|Undergraduate)\b",
    r"\b(?:B\.\s?S\.|M\.\s?S\.|B\.\s?A\.|M\.\s?A\.|Ph\.\s?D\.)\b",
)
B10_SQL = X.oracle(
    " UNION ALL ".join(
        f"SELECT candidate_id, CAST({i} AS BIGINT) AS pattern_no, match, context FROM ({found_sql('resumes', 'candidate_id', p)})"
        for i, p in enumerate(_DEGREES)
    )
)


def b11_section_after(spark, d):
    found = R.section_after(X.resumes(spark, d), "text")
    return found.select("candidate_id", *[F.col(c).cast("bigint").alias(c) for c in ("header_no", "offset")], "section")


def _section_sql(i: int, header: str) -> str:
    found = found_sql("resumes", "candidate_id", rf"(?i)\b{header}\b")
    rest = 'substring(text, "offset" + 1 + length(match))'
    stop = f"CASE WHEN instr({rest}, chr(10) || chr(10)) > 0 THEN instr({rest}, chr(10) || chr(10)) - 1 ELSE length({rest}) END"
    return f"""SELECT candidate_id, CAST({i} AS BIGINT) AS header_no, "offset",
        regexp_replace(regexp_replace(match || substring({rest}, 1, {stop}), '^\\s+', ''), '\\s+$', '') AS section FROM ({found})"""


B11_SQL = X.oracle(
    "SELECT * FROM (" + " UNION ALL ".join(_section_sql(i, h) for i, h in enumerate(R.EXPERIENCE_HEADERS)) + ") WHERE section <> ''"
)


def b12_date_ranges(spark, d):
    ranges = X.resumes(spark, d).select("candidate_id", F.explode(R.date_ranges("text")).alias("range"))
    return ranges.groupBy("candidate_id", "range").agg(F.count("*").alias("n"))


_ANY_RE2 = rf"\b\d{{4}}{_D}\d{{4}}|\b{_M} \d{{4}}{_D}{_M} \d{{4}}|\b{_M} \d{{4}}{_D}{_N}\b"
B12_SQL = X.oracle(
    f"""SELECT candidate_id, range, count(*) AS n FROM
        (SELECT candidate_id, unnest(regexp_extract_all(text, '{_ANY_RE2}')) AS range FROM resumes) GROUP BY ALL"""
)


def b13_ngrams(spark, d):
    runs = T.ngrams(T.long_words(F.lower("text")), 1, 3)
    terms = _documents(spark, d).select("lang", F.explode(runs).alias("term"))
    return terms.groupBy("lang", "term").agg(F.count("*").alias("n"))


B13_SQL = r"""SELECT lang, term, count(*) AS n FROM (
    SELECT lang, unnest(list_concat(w,
        list_transform(generate_series(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1])),
        list_transform(generate_series(1, len(w) - 2), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])))) AS term
    FROM (SELECT lang, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) AS w FROM documents))
    GROUP BY ALL"""


def b14_first_match(spark, d):
    found = R.find_with_context(X.resumes(spark, d), "text", R.EMPLOYMENT_RANGE)
    return found.select(
        "candidate_id",
        F.col("match_no").cast("bigint").alias("match_no"),
        R.job_title("context").alias("job_title"),
        R.company("context").alias("company"),
    )


_ROLES = "(?:Engineer|Manager|Director|Analyst|Administrator|Consultant|Specialist)"
TITLE_SQL = rf"""coalesce(
    nullif(regexp_extract(context, '(?:Senior|Lead|Principal|Junior|Associate)?\s*(?:Software Engineer|Developer|Data Scientist|Manager|Director|Analyst|Administrator|Consultant|Specialist)'), ''),
    nullif(regexp_extract(context, '(?:Chief|VP|Head) of [A-Z][a-z]+(?: [A-Z][a-z]+)*'), ''),
    nullif(regexp_extract(context, '[A-Z][a-z]+ {_ROLES}'), ''))"""
COMPANY_SQL = (
    "regexp_replace(coalesce("
    + ", ".join(rf"nullif(regexp_extract(context, '{w} ((?:[A-Z][a-zA-Z]*\s*){{1,3}})', 1), '')" for w in ("at", "with", "for"))
    + r"), '\s+$', '')"
)
B14_SQL = X.oracle(
    f"""SELECT candidate_id, match_no, {TITLE_SQL} AS job_title, {COMPANY_SQL} AS company
        FROM ({found_sql("resumes", "candidate_id", RANGE_RE2)})"""
)


def b15_clip(spark, d):
    return _documents(spark, d).select("doc_id", T.clip("text", 100).alias("shown"))


B15_SQL = "SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substring(text, 1, 100), '...') ELSE text END AS shown FROM documents"

QUERIES = {
    "b1_clean_text": b1_clean_text,
    "b2_tokens": b2_tokens,
    "b3_normalise_terms": b3_normalise_terms,
    "b4_match_form": b4_match_form,
    "b5_token_features": b5_token_features,
    "b6_basic_features": b6_basic_features,
    "b7_vocabulary_stats": b7_vocabulary_stats,
    "b8_find_terms": b8_find_terms,
    "b8_find_terms_long_list": b8_find_terms_long_list,
    "b9_find_with_context": b9_find_with_context,
    "b10_education_contexts": b10_education_contexts,
    "b11_section_after": b11_section_after,
    "b12_date_ranges": b12_date_ranges,
    "b13_ngrams": b13_ngrams,
    "b14_first_match": b14_first_match,
    "b15_clip": b15_clip,
}
ORACLE = {
    "b1_clean_text": B1_SQL,
    "b2_tokens": B2_SQL,
    "b3_normalise_terms": B3_SQL,
    "b4_match_form": B4_SQL,
    "b5_token_features": B5_SQL,
    "b6_basic_features": B6_SQL,
    "b7_vocabulary_stats": B7_SQL,
    "b8_find_terms": B8_SQL,
    "b8_find_terms_long_list": B8_LONG_SQL,
    "b9_find_with_context": B9_SQL,
    "b10_education_contexts": B10_SQL,
    "b11_section_after": B11_SQL,
    "b12_date_ranges": B12_SQL,
    "b13_ngrams": B13_SQL,
    "b14_first_match": B14_SQL,
    "b15_clip": B15_SQL,
}

"""Is hidden text manipulative? Six tests of the hidden against the visible text, and their verdict.

Every test gives ``doc_id, method, suspicious, confidence, n``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.matching import tagged_matches
from docsieve.functions.text import clip, cosine, match_tokens, ngrams, phrase_tokens, words
from docsieve.operators.spans import with_following

VERDICT = ("doc_id", "method", "suspicious", "confidence", "n")
COMPARED_LABELS = ("PERSON", "ORG", "GPE", "PRODUCT")
ENTITY_LABELS = (*COMPARED_LABELS, "DATE")

# Signs of stuffing, matched case-insensitively. A possessive tail (``}+``) gives the same matches as a
# greedy one here and keeps the matcher from recursing on long texts.
_ITEM = r"\b\w+\b[,.;]"
_AFTER_HEADER = r"\b[^\n]{0,30}?[:\-–]"
SUSPICIOUS_PATTERNS = (
    ("repeated_word", r"(?iU)(\b\w+\b)(?:\s+\1){2,}+"),
    (
        "skill_list",
        rf"(?iU)\b(?:skills|expertise|proficient|proficiency|experience)s?{_AFTER_HEADER}[^\n]{{0,200}}?"
        rf"{_ITEM}(?:[^\n]{{0,10}}?{_ITEM}){{9,}}+",
    ),
    ("meta_tags", rf"(?iU)\b(?:keywords|tags|meta|seo){_AFTER_HEADER}[^\n]{{0,200}}"),
    ("job_title", rf"(?iU)\b(?:job\s+title|position|role){_AFTER_HEADER}[^\n]{{0,100}}"),
    ("delimited_list", r"(?iU)(?:\b\w+\b[,.;]\s*){10,}+"),
)


def _verdict(df: DataFrame, method: str, suspicious: Column, confidence: Column, n: Column) -> DataFrame:
    return df.select(
        "doc_id",
        F.lit(method).alias("method"),
        suspicious.alias("suspicious"),
        confidence.cast("double").alias("confidence"),
        n.cast("bigint").alias("n"),
    )


# --- term frequency -------------------------------------------------------------------------------------------------


#: Chunk numbers of a document whose terms are counted in one place.
SHORT_DOCUMENT = 64


def side_terms(
    chunks: DataFrame, stop_words: Iterable[str] = (), lo: int = 1, hi: int = 3, by_document: bool = False
) -> DataFrame:
    """``doc_id, term, visible, hidden``: how often each token run occurs on each side.

    Runs that cross a chunk border start in the earlier chunk, which is given the next tokens. With ``by_document`` the
    tokens of a document come to one task and are counted there; otherwise each run is sent.
    """
    terms = F.filter(match_tokens("text", stop_words), lambda w: F.length(w) >= 2)
    placed = chunks.repartition("doc_id") if by_document else chunks
    tokens = placed.select("doc_id", "side", "chunk", terms.alias("tokens")).filter(F.size("tokens") > 0)
    reach = max(hi - 1, 1)
    head, merge = F.slice("tokens", 1, reach), lambda h: F.slice(F.flatten(h), 1, reach)
    if by_document:
        following = Window.partitionBy("doc_id", "side").orderBy("chunk").rowsBetween(1, reach)
        after = merge(F.collect_list(head).over(following))
        spread = tokens.withColumn("next_tokens", F.when(F.col("chunk").isNotNull(), after))
    else:
        spread = with_following(tokens, head, reach, merge, "next_tokens")
    joined = F.when(F.col("next_tokens").isNull(), F.col("tokens")).otherwise(F.concat("tokens", "next_tokens"))
    runs = spread.select("doc_id", "side", F.explode(ngrams(joined, lo, hi, starts=F.size("tokens"))).alias("term"))
    return runs.groupBy("doc_id", "term").agg(
        F.count_if(F.col("side") == "visible").alias("visible"), F.count_if(F.col("side") == "hidden").alias("hidden")
    )


def side_tfidf(terms: DataFrame, by_document: bool = False) -> DataFrame:
    """Smoothed tf-idf over the two sides of each document, each side scaled to length one, to 9 digits.

    ``by_document`` is for terms that lie by document: they stay there, sorted, instead of meeting their document's lengths.
    """
    sides = (F.col("visible") > 0).cast("int") + (F.col("hidden") > 0).cast("int")
    idf = F.log(F.lit(3.0) / (1 + sides)) + 1
    weighted = terms.withColumns({"v": F.col("visible") * idf, "h": F.col("hidden") * idf})
    squares = {n: F.sum(F.col(c) * F.col(c)) for c, n in (("v", "vn"), ("h", "hn"))}
    if by_document:
        document = Window.partitionBy("doc_id")
        joined = weighted.filter("doc_id is not null").withColumns({n: F.sqrt(s.over(document)) for n, s in squares.items()})
    else:
        joined = weighted.join(weighted.groupBy("doc_id").agg(*[F.sqrt(s).alias(n) for n, s in squares.items()]), "doc_id")

    def scaled(x: str, norm: str) -> Column:  # most terms stand on one side: rounding, by far the dearest step, only that
        return F.when((F.col(x) > 0) & (F.col(norm) > 0), F.round(F.col(x) / F.col(norm), 9)).otherwise(F.lit(0.0))

    return joined.select(
        "doc_id", "term", scaled("v", "vn").alias("visible_score"), scaled("h", "hn").alias("hidden_score")
    )


def term_scores(chunks: DataFrame, stop_words: Iterable[str] = (), short: int = SHORT_DOCUMENT) -> DataFrame:
    """``side_tfidf`` of the ``side_terms``: a document's chunks are sent once, not its far larger runs of tokens.

    Documents that reach beyond ``short`` chunks are counted and scaled run by run, so that no task follows a long one.
    """
    long = chunks.filter(F.abs("chunk") >= short).select("doc_id").distinct()
    whole = long.isEmpty()
    rest = chunks if whole else chunks.join(long, "doc_id", "left_anti")
    near = side_tfidf(side_terms(rest, stop_words, by_document=True), by_document=True)
    return near if whole else near.unionByName(side_tfidf(side_terms(chunks.join(long, "doc_id", "left_semi"), stop_words)))


def significant_terms(
    tfidf: DataFrame, min_ratio: float = 2.0, min_score: float = 0.1, keep: int = 10
) -> DataFrame:
    """The terms that weigh far more in hidden text, the strongest ``keep`` per document."""
    return _ranked_terms(tfidf, min_ratio, min_score).filter(F.col("rank") <= keep)


def _ranked_terms(tfidf: DataFrame, min_ratio: float, min_score: float) -> DataFrame:
    v, h = F.col("visible_score"), F.col("hidden_score")
    strong = tfidf.filter((h > v * min_ratio) & (h > min_score)).withColumn("ratio", h / F.greatest(v, F.lit(0.001)))
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.round(h - v, 9)), "term")
    return strong.withColumn("rank", F.row_number().over(best))


def hidden_tokens(chunks: DataFrame, stop_words: Iterable[str] = ()) -> DataFrame:
    """``doc_id, hidden_tokens, hidden_words``: hidden text size in comparable tokens and in plain words."""
    hidden = chunks.filter(F.col("side") == "hidden")
    return hidden.groupBy("doc_id").agg(
        F.sum(F.size(match_tokens("text", stop_words))).alias("hidden_tokens"),
        F.sum(F.size(words("text"))).alias("hidden_words"),
    )


def term_frequency_verdict(
    tfidf: DataFrame, sizes: DataFrame, min_tokens: int = 3, min_terms: int = 3, min_ratio: float = 2.0, min_score: float = 0.1
) -> DataFrame:
    """Suspicious from ``min_terms`` strong terms on; documents with too little hidden text are not.

    ``sizes`` is ``doc_id, hidden_tokens``, one row per document with hidden text. The scores are read once.
    """
    top = F.avg(F.when(F.col("rank") <= 5, F.col("ratio"))).alias("mean_ratio")
    strong = _ranked_terms(tfidf, min_ratio, min_score).groupBy("doc_id").agg(F.count("*").alias("n"), top)
    joined = sizes.select("doc_id", "hidden_tokens").join(strong, "doc_id", "left")
    enough = F.col("hidden_tokens") >= min_tokens
    n = F.when(enough, F.coalesce("n", F.lit(0))).otherwise(0)
    confidence = F.when(enough, F.least(F.lit(1.0), F.coalesce("mean_ratio", F.lit(0.0)))).otherwise(0.0)
    return _verdict(joined, "term_frequency", n >= min_terms, confidence, n)


# --- lexicon terms --------------------------------------------------------------------------------------------------


def phrase_lexicon(lexicon: DataFrame) -> DataFrame:
    tokens = phrase_tokens("term")
    return lexicon.select("kind", "category", F.array_join(tokens, " ").alias("phrase"), F.size(tokens).alias("len"))


#: Phrase beginnings (first token and length) that are looked up inside the row; more of them are joined.
LITERAL_BEGINNINGS = 4096


def _begin(tokens: Column, starts: Column | None, wanted: Callable[[Column], Column]) -> Column:
    """(token, place from 1) where a phrase may begin, among the first ``starts`` tokens."""
    first = tokens if starts is None else F.slice(tokens, F.lit(1), starts)
    return F.filter(F.transform(first, lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i"))), lambda p: wanted(p["t"]))


def _runs_of_small(tokens: Column, starts: Column | None, beginnings: dict[int, list[str]]) -> Column:
    """The token runs of each phrase length that begin like a phrase of that length, by sets held in the expression."""

    def runs(n: int, firsts: list[str]) -> Column:
        places = _begin(tokens, starts, lambda t: t.isin(firsts))
        return F.transform(F.filter(places, lambda p: p["i"] + n - 1 <= F.size(tokens)), lambda p: F.array_join(F.slice(tokens, p["i"], F.lit(n)), " "))

    return F.flatten(F.array(*[runs(n, firsts) for n, firsts in sorted(beginnings.items())]))


def _with_beginnings(tokens: DataFrame, source: Column, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """``lengths``: for the tokens of a row that begin phrases, how long those are. Rows without any are left out.

    A row's distinct tokens meet the first tokens of the phrases; only what is found goes back to the row.
    """
    index = phrases.select(F.substring_index("phrase", " ", 1).alias("first"), "len").groupBy("first").agg(F.array_sort(F.collect_set("len")).alias("lens"))
    keyed = tokens.withColumn("_row", F.xxhash64(source))
    met = keyed.select(*keys, "_row", F.explode(F.array_distinct("tokens")).alias("first")).distinct().join(index, "first")
    found = met.groupBy(*keys, "_row").agg(F.map_from_entries(F.collect_list(F.struct("first", "lens"))).alias("lengths"))
    same = F.lit(True)
    for c in (*keys, "_row"):
        same = same & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    return keyed.join(found.select(*[F.col(c).alias(f"_f_{c}") for c in (*keys, "_row")], "lengths"), same)


def _runs_of_large(tokens: Column, starts: Column | None) -> Column:
    places = _begin(tokens, starts, lambda t: F.map_contains_key("lengths", t))
    each = F.transform(
        places,
        lambda p: F.transform(
            F.filter(F.element_at("lengths", p["t"]), lambda n: p["i"] + n - 1 <= F.size(tokens)), lambda n: F.array_join(F.slice(tokens, p["i"], n), " ")
        ),
    )
    return F.flatten(each)


def match_phrases(
    texts: DataFrame, lexicon: DataFrame, column: str = "text", longest: int | None = None, literal: int = LITERAL_BEGINNINGS
) -> DataFrame:
    """Every token-sequence match of a lexicon phrase, overlaps included, counted per document and phrase.

    ``texts`` may be whole documents or chunks (``side, chunk``); chunk borders are bridged. A run of tokens is only built
    where a phrase of its length begins with its first token, so what goes on to the equi-join with the lexicon is in
    proportion to such beginnings, not to tokens times lengths. Up to ``literal`` beginnings are part of the expression,
    more are joined to the distinct tokens of each row; both give the same. A lexicon without phrases matches nothing.
    """
    phrases = phrase_lexicon(lexicon).filter("len > 0")
    if longest is not None:
        phrases = phrases.filter(F.col("len") <= longest)
    beginnings = phrases.select(F.substring_index("phrase", " ", 1).alias("first"), "len").distinct()
    known = beginnings.limit(literal + 1).collect()
    small = len(known) <= literal
    most = max((r.len for r in known), default=1) if small else phrases.agg(F.max("len")).first()[0]
    keys = [c for c in ("doc_id", "side") if c in texts.columns]
    place = [c for c in ("chunk",) if c in texts.columns]
    tokens = texts.select(*keys, *place, phrase_tokens(column).alias("tokens"))
    tokens = tokens.filter(F.size("tokens") > 0)
    reach = most - 1
    run_source, starts = F.col("tokens"), None
    if place and reach > 0:
        tokens = with_following(
            tokens, F.slice("tokens", 1, reach), reach, lambda h: F.slice(F.flatten(h), 1, reach), "next_tokens"
        )
        run_source = F.when(F.col("next_tokens").isNull(), F.col("tokens")).otherwise(F.concat("tokens", "next_tokens"))
        starts = F.size("tokens")
    if not known:
        runs = F.array().cast("array<string>")
    elif small:
        firsts: dict[int, list[str]] = {}
        for r in known:
            firsts.setdefault(r.len, []).append(r.first)
        runs = _runs_of_small(run_source, starts, firsts)
    else:
        tokens = _with_beginnings(tokens, run_source, phrases, keys + place)
        runs = _runs_of_large(run_source, starts)
    found = tokens.select(*keys, F.explode(runs).alias("phrase")).join(phrases, "phrase")
    return found.groupBy(*keys, "kind", "category", "phrase").agg(F.count("*").alias("n"))


def hidden_only_terms(phrase_counts: DataFrame) -> DataFrame:
    """Hidden terms that do not occur in the visible text, per lexicon kind."""
    return (
        phrase_counts.groupBy("doc_id", "kind", F.col("phrase").alias("term"))
        .agg(F.bool_or(F.col("side") == "hidden").alias("h"), F.bool_or(F.col("side") == "visible").alias("v"))
        .filter("h and not v")
        .select("doc_id", "kind", "term")
    )


def term_category_counts(phrase_counts: DataFrame) -> DataFrame:
    hidden = phrase_counts.filter(F.col("side") == "hidden")
    return hidden.groupBy("doc_id", "kind", "category").agg(F.sum("n").alias("n"))


def lexicon_verdict(documents: DataFrame, hidden_only: DataFrame, min_terms: int = 5, full: int = 10) -> DataFrame:
    counts = hidden_only.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = documents.select("doc_id").join(counts, "doc_id", "left").fillna(0)
    n = F.col("n")
    return _verdict(joined, "industry_terms", n >= min_terms, F.least(F.lit(1.0), n / full), n)


# --- patterns -------------------------------------------------------------------------------------------------------


def suspicious_patterns(texts: DataFrame, column: str = "text", min_length: int = 10, shown: int = 100) -> DataFrame:
    """``doc_id, pattern, offset, match``: matches longer than ``min_length``, shortened for display only."""
    hits = F.flatten(F.array(*[tagged_matches(column, F.lit(name), "pattern", p) for name, p in SUSPICIOUS_PATTERNS]))
    found = texts.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*")
    length = F.length("match")
    return found.filter(length > min_length).select(
        "doc_id", "pattern", "offset", length.alias("length"), clip("match", shown).alias("match")
    )


def pattern_verdict(documents: DataFrame, patterns: DataFrame, full: int = 3) -> DataFrame:
    counts = patterns.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = documents.select("doc_id").join(counts, "doc_id", "left").fillna(0)
    n = F.col("n")
    return _verdict(joined, "patterns", n >= 1, F.least(F.lit(1.0), n / full), n)


# --- vectors and intent ---------------------------------------------------------------------------------------------


def vector_similarity(pairs: DataFrame, visible: str = "visible_vec", hidden: str = "hidden_vec") -> DataFrame:
    others = [c for c in pairs.columns if c not in (visible, hidden)]
    return pairs.select(*others, cosine(visible, hidden).alias("similarity"))


def similarity_verdict(
    similarities: DataFrame, low: float = 0.3, high: float = 0.95, min_tokens: int = 3, tokens: str | None = None
) -> DataFrame:
    s = F.col("similarity")
    enough = F.lit(True) if tokens is None else F.col(tokens) >= min_tokens
    suspicious = F.coalesce(enough & ((s < low) | (s > high)), F.lit(False))
    confidence = F.when(~enough | s.isNull(), 0.0).when(s < low, 1 - s / low).when(s > high, (s - high) * 20).otherwise(0.0)
    return _verdict(similarities, "semantic_similarity", suspicious, confidence, F.lit(0))


def intent_verdict(
    scores: DataFrame, texts: DataFrame | None = None, bad: Sequence[str] = ("keyword stuffing",), min_words: int = 5
) -> DataFrame:
    """From ``doc_id, label, score``: the two best labels; suspicious if the best one is bad.

    ``texts`` (``doc_id, hidden_words``) switches the test off for short hidden texts.
    """
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "label")
    top = scores.withColumn("rank", F.row_number().over(best)).filter("rank <= 2")
    wide = top.groupBy("doc_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("top_label"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.max(F.when(F.col("rank") == 2, F.col("label"))).alias("second_label"),
    )
    enough = F.lit(True)
    if texts is not None:
        wide = wide.join(texts.select("doc_id", "hidden_words"), "doc_id", "left")
        enough = F.coalesce(F.col("hidden_words") >= min_words, F.lit(False))
    suspicious = enough & F.col("top_label").isin(list(bad))
    confidence = F.when(suspicious, F.col("top_score")).otherwise(0.0)
    return wide.select(
        "doc_id",
        F.lit("intent").alias("method"),
        suspicious.alias("suspicious"),
        confidence.alias("confidence"),
        F.lit(0).cast("bigint").alias("n"),
        "top_label",
        "second_label",
    )


# --- entities -------------------------------------------------------------------------------------------------------


def drop_gazetteer_entities(entities: DataFrame, gazetteer: DataFrame, labels: Sequence[str] = ENTITY_LABELS) -> DataFrame:
    """Hidden entities named by the gazetteer, whole or by one of their words, are left out.

    The decision depends on the text alone, so it is taken once per distinct hidden text.
    """
    kept = entities.filter(F.col("label").isin(list(labels))).withColumn("text", F.lower("text"))
    texts = kept.filter(F.col("side") == "hidden").select("text").distinct()
    parts = F.array_union(F.array("text"), F.split("text", r"(?U)\s+"))
    known = (
        texts.select("text", F.explode(parts).alias("term"))
        .join(gazetteer, "term", "left_semi")
        .select(F.col("text").alias("text"), F.lit("hidden").alias("side"))
        .distinct()
    )
    return kept.join(known, ["text", "side"], "left_anti").select(*entities.columns)


def entity_mismatches(entities: DataFrame, threshold: float = 0.8, labels: Sequence[str] = COMPARED_LABELS) -> DataFrame:
    """``doc_id, label, text, n``: hidden entities without a visible one whose token set is ``threshold`` similar.

    Token sets are reduced to distinct ones per document and label, equal sets are removed first, and the rest meet
    only where they can reach the threshold: by one of their rarest tokens, as many as their two sizes leave open
    (``_size_keys``), and neither is smaller than ``threshold`` times the other.
    """
    tokens = F.array_sort(F.array_distinct(words(F.lower("text"))))
    base = entities.filter(F.col("label").isin(list(labels))).select(
        "doc_id", "label", "side", F.lower("text").alias("text"), tokens.alias("tokens")
    )
    key = ["doc_id", "label"]
    hidden = base.filter(F.col("side") == "hidden").groupBy(*key, "text", "tokens").agg(F.count("*").alias("n"))
    sets = base.filter(F.size("tokens") > 0).groupBy(*key, "tokens").agg(
        F.bool_or(F.col("side") == "hidden").alias("h"), F.bool_or(F.col("side") == "visible").alias("v")
    )
    open_sets = sets.filter("h and not v").select(*key, "tokens")
    candidates = sets.filter("v").select(*key, "tokens")
    similar = _similar_sets(open_sets, candidates, key, threshold)
    equal = sets.filter("h and v").select(*key, "tokens")
    matched = similar.unionByName(equal)
    return hidden.join(matched, [*key, "tokens"], "left_anti").select(*key, "text", "n")


def _similar_sets(left: DataFrame, right: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """The left sets with a different right set of at least ``threshold`` Jaccard similarity.

    Different sets reach at most n / (n + 1), n being the smaller size, so smaller sets than that allows are left out.
    """
    if threshold >= 1:
        return left.limit(0)
    large = F.size("tokens") >= threshold / (1 - threshold) - 1e-9
    left, right = left.filter(large), right.filter(large)
    both = left.withColumn("s", F.lit("l")).unionByName(right.withColumn("s", F.lit("r")))
    # A token goes with 128 bits that stand for its set, which is put together of its tokens again.
    spread = both.select(*key, "s", F.unhex(F.md5(F.array_join("tokens", " "))).alias("set"), F.explode("tokens").alias("token"))
    frequency = spread.groupBy(*key, "token").agg(F.count("*").alias("f"))
    ranked = spread.join(frequency, [*key, "token"]).groupBy(*key, "s", "set").agg(
        F.array_sort(F.collect_list(F.struct("f", "token"))).alias("by_rarity")
    ).withColumn("words", F.array_join(F.array_sort(F.transform("by_rarity", lambda p: p["token"])), " "))
    keyed = ranked.select(*key, "s", "words", F.explode(_size_keys(F.col("by_rarity"), threshold)).alias("p")).select(*key, "s", "words", "p.*")
    l = keyed.filter("s = 'l'").select(*key, "token", "mine", "theirs", "words")
    r = keyed.filter("s = 'r'").select(*key, "token", F.col("theirs").alias("mine"), F.col("mine").alias("theirs"), F.col("words").alias("other"))
    met = l.join(r, [*key, "token", "mine", "theirs"]).select(*key, F.split("words", " ").alias("tokens"), F.split("other", " ").alias("other"))
    shared = F.size(F.array_intersect("tokens", "other"))
    jaccard = shared / (F.size("tokens") + F.size("other") - shared)
    sizes = (F.size("other") >= F.size("tokens") * threshold - 1e-9) & (F.size("tokens") >= F.size("other") * threshold - 1e-9)
    return met.filter(sizes & (jaccard >= threshold - 1e-12)).select(*key, "tokens").distinct()


#: Where bands of set sizes begin: every size up to 24, then steps of a quarter.
SIZE_BANDS = [*range(25), *(round(25 * 1.25**k) for k in range(48))]


def _size_keys(by_rarity: Column, threshold: float) -> Column:
    """array<struct<token, mine, theirs>>: for each band of sizes that can reach the threshold, the rarest tokens.

    Sets of n and m tokens that reach it share t / (1 + t) * (n + m) of them at least, so one of the first that can be spared
    and one more. The bound is much closer for a given size than for all: texts that differ in one rare word of five and
    share four frequent ones don't meet at all.
    """
    bands = F.array(*[F.lit(n) for n in SIZE_BANDS])
    size = F.size(by_rarity)

    def band(n: Column) -> Column:  # a size up to 24 is its own band
        return F.when(n.between(0, 24), n.cast("int")).otherwise(F.size(F.filter(bands, lambda begin: begin <= n)) - 1)

    least = F.ceil(size * threshold - 1e-9).cast("int")

    def keys(theirs: Column) -> Column:
        shared = F.ceil((size + F.greatest(bands[theirs], least)) * (threshold / (1 + threshold)) - 1e-9).cast("int")
        rarest = F.slice(by_rarity, 1, F.greatest(size - shared + 1, F.lit(0)))
        return F.transform(rarest, lambda p: F.struct(p["token"].alias("token"), band(size).alias("mine"), theirs.alias("theirs")))

    return F.flatten(F.transform(F.sequence(band(least), band(F.floor(size / threshold + 1e-9))), keys))


def context_verdict(
    documents: DataFrame, mismatches: DataFrame, min_words: int = 5, min_count: int = 3, full: int = 5
) -> DataFrame:
    """``documents`` has ``doc_id`` and ``hidden_words``."""
    counts = mismatches.groupBy("doc_id").agg(F.sum("n").alias("n"))
    joined = documents.select("doc_id", "hidden_words").join(counts, "doc_id", "left").fillna(0)
    n = F.when(F.col("hidden_words") >= min_words, F.col("n")).otherwise(0)
    return _verdict(joined, "context_relevance", n >= min_count, F.least(F.lit(1.0), n / full), n)


# --- verdict --------------------------------------------------------------------------------------------------------


def combine_verdicts(verdicts: DataFrame, threshold: float = 0.7, sides: DataFrame | None = None) -> DataFrame:
    """Flagged if any method is suspicious with enough confidence; confidence is the highest of those.

    ``sides`` (``doc_id, has_hidden, has_visible``) clears documents that lack one side.
    """
    sure = F.col("suspicious") & (F.col("confidence") >= threshold)
    combined = verdicts.groupBy("doc_id").agg(
        F.bool_or(sure).alias("flagged"),
        F.coalesce(F.max(F.when(sure, F.col("confidence"))), F.lit(0.0)).alias("confidence"),
    )
    if sides is None:
        return combined
    both = F.coalesce(F.col("has_hidden") & F.col("has_visible"), F.lit(False))
    return sides.join(combined, "doc_id", "left").select(
        "doc_id",
        (both & F.coalesce("flagged", F.lit(False))).alias("flagged"),
        F.when(both, F.coalesce("confidence", F.lit(0.0))).otherwise(0.0).alias("confidence"),
    )


METHOD_PHRASES = {
    "term_frequency": "%d over-weighted hidden terms",
    "industry_terms": "%d lexicon terms only in hidden text",
    "patterns": "%d stuffing patterns",
    "intent": "intent looks like stuffing",
    "context_relevance": "%d entities foreign to the document",
}
NEUTRAL = "Hidden text shows no manipulation."


def verdict_summary(verdicts: DataFrame, combined: DataFrame) -> DataFrame:
    """One line per document naming the suspicious methods."""
    counts = verdicts.filter("suspicious").groupBy("doc_id").agg(
        *[F.max(F.when(F.col("method") == m, F.col("n"))).alias(m) for m in METHOD_PHRASES]
    )
    parts = [
        F.when(F.col(m).isNotNull(), F.format_string(text, m) if "%d" in text else F.lit(text))
        for m, text in METHOD_PHRASES.items()
    ]
    lead = F.format_string("Likely manipulation (confidence %.2f): ", F.col("confidence"))
    line = F.when(F.col("flagged"), F.concat(lead, F.concat_ws("; ", *parts))).otherwise(F.lit(NEUTRAL))
    return combined.join(counts, "doc_id", "left").select("doc_id", "flagged", line.alias("summary"))

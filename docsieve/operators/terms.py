"""Token to base form by a lemma table; term lists of any length found in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.matching import find_terms
from docsieve.session import stored

MAX_LITERAL_LEMMAS = 256  # a lookup in a row walks the whole map
MAX_LITERAL_TERMS = 64  # every term is searched for in every text
LEAST_SHARE = 1 / 16  # of the terms, that a length needs for texts to send all runs of it
MOST_PARTS = 8  # of a run
MOST_WORDS = 1 << 22  # of a Bloom filter, 32 MB; beyond that more runs pass it and are joined in vain


def normalise_terms(
    tokenised: DataFrame, lemmas: DataFrame, column: str = "tokens", key: str = "doc_id", limit: int = MAX_LITERAL_LEMMAS
) -> DataFrame:
    """Tokens found in ``lemmas`` (``form, lemma``) become their lemma, others stay.

    A small table is looked up inside the row; a larger one is joined once per distinct token of a document. Of several
    lemmas of a form the smallest holds; a null form or lemma changes nothing.
    """
    lemmas = lemmas.filter("form is not null and lemma is not null").groupBy("form").agg(F.min("lemma").alias("lemma"))
    rows = lemmas.limit(limit + 1).collect()
    if len(rows) <= limit:
        pairs = [F.lit(v) for r in rows for v in (r.form, r.lemma)]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return tokenised.withColumn(column, F.transform(column, lambda t: F.coalesce(F.try_element_at(table, t), t)))
    used = tokenised.select(key, F.explode(F.array_distinct(column)).alias("form"))
    per_doc = used.join(lemmas.select("form", "lemma"), "form").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("_map")
    )
    joined = tokenised.join(per_doc, key, "left")
    found = F.transform(column, lambda t: F.coalesce(F.try_element_at("_map", t), t))
    return joined.withColumn(column, F.when(F.col("_map").isNull(), F.col(column)).otherwise(found)).drop("_map")


def _whole_word(term: Column) -> Column:
    """The pattern of ``matching.whole_word``."""
    quoted = F.regexp_replace(F.lower(term), r"(?U)([^\w\s])", r"\\$1")
    return F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b"))


def _parts(lowered: Column) -> Column:
    """Words and the gaps between them, by turns."""
    return F.regexp_extract_all(lowered, F.lit(r"(?U)\w+|\W+"), F.lit(0))


def _direct_lengths(counts: dict[int, int]) -> list[int]:
    """The lengths (in parts) of which texts send runs: the shortest, and those of many terms. Others go by a beginning."""
    least = sum(counts.values()) * LEAST_SHARE
    return sorted({min(k, MOST_PARTS) for n, k in enumerate(sorted(counts)) if n == 0 or counts[k] >= least})


def term_index(terms: DataFrame, lengths: list[int]) -> DataFrame:
    """``terms`` (``term, ord`` and more) with ``anchor``, a part that stands in any text with the term, and ``sure``, whether the
    term stands in any text with the anchor.

    Words found whole have what is between them in common with the text too. So the anchor is the longest beginning, from the
    first word, that has one of ``lengths`` parts. A term without any word stands between two word characters: it is the gap itself.
    """
    rest = F.col("size") - F.col("lead").cast("int")
    begun = F.greatest(F.lit(0), F.lit(0), *[F.when(rest >= k, k) for k in lengths])
    begin = F.array_join(F.slice(_parts(F.lower("term")), F.col("lead").cast("int") + 1, begun), "")
    anchor = F.when(rest == 0, F.lower("term")).otherwise(begin)
    sure = (rest == 0) | (~F.col("lead") & (begun == F.col("size")))
    return terms.withColumns({"anchor": anchor, "sure": sure}).drop("size", "lead")


def _runs(lowered: Column, lengths: list[int], gaps: bool) -> Column:
    """The runs of so many parts from each word of a text, "" where it ends before, and the gaps between words.

    A part goes to where it ends in the text; a gap at the end of a run has a word beyond it.
    """

    def of(k: int) -> Column:
        run = "".join(r"\W++" if j % 2 else r"\w++" for j in range(k))
        beyond = "" if k % 2 else r"\w"
        return F.regexp_extract_all(lowered, F.lit(rf"(?U)(?:(?=({run}){beyond}))?\w++"), F.lit(1))

    between = [F.regexp_extract_all(lowered, F.lit(r"(?U)(?<=\w)(\W++)(?=\w)"), F.lit(1))] if gaps else []
    return F.concat(*map(of, lengths), *between)


def _place(value: Column, words: int) -> tuple[Column, Column]:
    """Which word of a Bloom filter a value is in, and its two bits there."""
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(F.hash(value), n).bitwiseAND(F.lit(63)))
    return F.xxhash64(value).bitwiseAND(F.lit(words - 1)), bit(0).bitwiseOR(bit(6))


def _sketch(values: DataFrame, column: str, n: int) -> tuple[Column, int]:
    """A Bloom filter of ``n`` values as array<array<bigint>> for a subquery, 16 bits for each up to 32 MB, and its words."""
    words = max(1 << 10, min(MOST_WORDS, 1 << (max(n, 1) * 16 // 64).bit_length()))
    at, bits = _place(F.col(column), words)
    found = values.select(at.alias("w"), bits.alias("bits"))
    empty = values.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("bits"))
    dense = found.unionByName(empty).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
    blocks = dense.groupBy(F.shiftright("w", 10).alias("block")).agg(in_order("w", "bits").alias("bits"))
    return blocks.agg(in_order("block", "bits").alias("sketch")).scalar(), words


def _may_be_in(column: str, sketch: Column, words: int) -> Column:
    at, bits = _place(F.col(column), words)
    word = F.get(F.get(sketch, F.shiftright(at, 10).cast("int")), at.bitwiseAND(F.lit(1023)).cast("int"))
    return word.bitwiseAND(bits) == bits


def with_terms(
    texts: DataFrame, terms: DataFrame, column: str = "text", key: str = "doc_id", name: str = "terms", limit: int = MAX_LITERAL_TERMS
) -> DataFrame:
    """``texts`` with the terms (``term, ord``) that each holds as whole words, by ``ord``, then term.

    A short list is searched for in the row. A longer one is stored, and texts send those runs of parts (words and gaps) that a
    Bloom filter of the terms lets pass, to be joined on equality: a run that is a whole term is a hit, and only terms of rare
    lengths, which meet by a beginning, are checked in the row by the same rule. Terms in the list twice are found twice; empty
    and null ones never. A null text has no terms; keys may be null or repeated, each row answers for its own text.
    """
    listed = terms.filter("term <> ''").groupBy("term", "ord").agg(F.count(F.lit(1)).alias("n")).persist()
    numbered = lambda t: t.select(*[c for c in t.columns if c != "n"], F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("no"))
    none = F.array().cast("array<string>")
    try:
        rows = numbered(listed).limit(limit + 1).collect()
        if len(rows) <= limit:
            ordered = [r.term for r in sorted(rows, key=lambda r: (r.ord, r.term))]
            return texts.withColumn(name, F.when(F.col(column).isNotNull(), find_terms(column, ordered) if ordered else none).otherwise(none))
        parts = listed.withColumn("parts", _parts(F.lower("term")))
        lead = F.get("parts", F.lit(0)).rlike(r"(?U)^\W")
        listed_once = stored(parts.select("term", "ord", "n", F.size("parts").alias("size"), lead.alias("lead")))
    finally:
        listed.unpersist()
    shapes = listed_once.groupBy((F.col("size") - F.col("lead").cast("int")).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("lead").alias("led")
    ).collect()
    lengths = _direct_lengths({r.k: r.n for r in shapes if r.k})
    index = term_index(numbered(listed_once), lengths)
    sketch, words = _sketch(index, "anchor", sum(r.n for r in shapes))
    lowered, own = F.lower(column), F.xxhash64(column)
    runs = F.explode(_runs(lowered, lengths, any(r.k == 0 for r in shapes)))
    sent = texts.select(F.col(key).alias("_key"), own.alias("_own"), runs.alias("anchor"))
    met = sent.filter(_may_be_in("anchor", sketch, words)).join(index, "anchor").groupBy("_key", "_own").agg(
        F.sort_array(F.collect_set(F.struct("ord", "term", "no", "sure"))).alias("_met")
    )
    rows = texts.withColumn("_text_hash", own)
    joined = rows.join(met, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_text_hash") == F.col("_own")), "left")
    hits = F.col("_met")
    if any(r.k and (r.led or r.k not in lengths) for r in shapes):
        joined = joined.withColumn("_lowered", F.when(F.exists("_met", lambda x: ~x["sure"]), lowered))
        whole = lambda x: F.contains("_lowered", F.lower(x["term"])) & F.regexp_like("_lowered", _whole_word(x["term"]))
        hits = F.filter(hits, lambda x: x["sure"] | whole(x))
    found = F.transform(hits, lambda x: x["term"])
    return joined.withColumn(name, F.coalesce(found, none)).drop("_key", "_own", "_text_hash", "_met", "_lowered")

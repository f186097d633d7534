"""Lines that repeat across documents, as keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.llm.common import BLANKS, ascii_lower, hash128, hot_values, table, text_key, text_of
from docsieve.session import cut_lineage

#: Parts into which a hot line is dealt, and lines in a word of a bitmap.
SALTS, BITS = 64, 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text_key, dropped, keep_words for every row that loses lines.

    A line's key is the line without outer white space, A-Z in lower case. A key of ``min_chars`` code points found in
    ``min_docs`` documents (ids) stays only in the largest id that holds it. ``keep_words`` is the row's keep bitmap,
    compressed: ``{word, bits}`` for each run of 64 lines that loses any, where a set bit is a line that stays; runs that
    are not listed stay whole.

    Key hashes (128 bits) are range-partitioned and sorted by hash, id and position, so a partition streams each key's
    occurrences, the kept id first; texts stay where they are. A key that a bounded sketch finds frequent is dealt to
    parts by id; each part counts its ids, and the parts' counts (at most 64 rows for each of at most 200 keys) decide.
    """
    text = text_of(F.col("text"))
    lines = docs.select("doc_id", text_key(text).alias("_key"), F.posexplode(_lines(text)).alias("_pos", "_line"))
    lines = lines.withColumn("_line", F.btrim("_line", F.lit(BLANKS))).filter(F.char_length("_line") >= min_chars)
    h1, h2 = hash128(ascii_lower(F.col("_line")))
    lines = cut_lineage(lines.select("doc_id", "_key", "_pos", h1.alias("_h1"), h2.alias("_h2")))  # read four times
    hot = F.col("_h1").isin(hot_values(lines, "_h1"))
    lines = lines.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) + 1).otherwise(0))

    part = ["_h1", "_h2", "_salt"]
    newest_first = F.desc_nulls_last("doc_id")
    placed = lines.repartitionByRange(*part).sortWithinPartitions(*part, newest_first, "_pos")
    whole = Window.partitionBy(*part)
    stream = whole.orderBy(newest_first)
    ranked = placed.withColumns({"_rank": F.dense_rank().over(stream), "_newest": F.first("doc_id").over(stream)})
    ranked = ranked.withColumn("_ids", F.max("_rank").over(whole))

    parts = ranked.filter("_salt > 0 and _rank = 1").groupBy(*part).agg(F.max("_ids").alias("_n"), F.max(F.struct("_newest")).alias("_m"))
    hot_keys = parts.groupBy("_h1", "_h2").agg(F.sum("_n").alias("_all_ids"), F.max("_m").alias("_all_newest"))
    ranked = ranked.join(F.broadcast(hot_keys), ["_h1", "_h2"], "left").withColumns({
        "_ids": F.coalesce("_all_ids", "_ids"),
        "_newest": F.when(F.col("_all_ids").isNotNull(), F.col("_all_newest._newest")).otherwise(F.col("_newest")),
    })
    dropped = ranked.filter((F.col("_ids") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("_newest")))
    # every word of a bitmap lies in one task with its row's other words, so both sums share one shuffle
    placed_rows = dropped.select("doc_id", "_key", F.expr(f"_pos div {BITS}").cast("int").alias("_word"), F.expr(f"shiftleft(1L, _pos % {BITS})").alias("_bit"))
    words = placed_rows.repartition("doc_id", "_key").groupBy("doc_id", "_key", "_word").agg(F.bit_or("_bit").alias("_lost"))
    return words.groupBy("doc_id", "_key").agg(
        F.sum(F.bit_count("_lost").cast("bigint")).alias("dropped"),
        F.sort_array(F.collect_list(F.struct(F.col("_word").alias("word"), F.bitwise_not("_lost").alias("bits")))).alias("keep_words"),
    ).withColumnRenamed("_key", "text_key")


def _kept_text(text: Column, words: Column) -> Column:
    """The lines whose bit is set. The bitmap is laid out flat once, so a line finds its bit at once."""
    by_word = F.map_from_entries(words)
    last = F.element_at(words, -1)["word"]
    flat = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.element_at(by_word, w), F.lit(-1).cast("bigint")))
    pair = F.struct(flat.alias("bits"), _lines(text).alias("lines"))

    def chosen(pair: Column) -> Column:
        def stays(line: Column, i: Column) -> Column:
            bits = F.get(pair["bits"], F.floor(i / BITS).cast("int"))
            return bits.isNull() | (F.getbit(bits, F.pmod(i, F.lit(BITS))) == 1)

        return F.array_join(F.filter(pair["lines"], stays), "\n")

    return F.get(F.transform(F.array(pair), chosen), 0)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of ``docs``, with their columns in the struct ``doc``, and n_lines, n_dropped, kept_text.

    Null and empty texts are one empty line. A null id counts as one document, smaller than any other. Rows that repeat
    an id are one document; an empty table gives no rows. A text all of whose lines go is the empty text.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_id"), text_of(F.col("text")).alias("_text"))
    rows = rows.withColumn("_key", text_key(F.col("_text")))
    maps = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).withColumnRenamed("doc_id", "_map_id")
    found = rows.join(maps, F.col("_id").eqNullSafe(F.col("_map_id")) & (F.col("_key") == F.col("text_key")), "left")
    return found.select(
        "doc",
        F.size(_lines(F.col("_text"))).cast("bigint").alias("n_lines"),
        F.coalesce("dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("keep_words").isNull(), F.col("_text")).otherwise(_kept_text(F.col("_text"), F.col("keep_words"))).alias("kept_text"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
with l as (
    select doc_id, generate_subscripts(parts, 1) pos, unnest(parts) line
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) parts from documents)
), k as (
    select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key
    from l
), f as (
    select key, max(doc_id) newest from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), d as (
    select k.doc_id, pos, line, f.key is not null and k.doc_id <> f.newest as gone from k left join f using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from d group by doc_id
"""

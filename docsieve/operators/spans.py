"""Font-span analytics: which text is hidden, and what it says.

Spans carry ``doc_id, page, text, font, size, color`` and columns that order them within a page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.text import word_runs

SPAN_ORDER = ("page", "span_no")
WHITE = 240  # fixed value: every channel must exceed it
PAGES_PER_CHUNK = 64


def channels(color: Column | str) -> tuple[Column, Column, Column]:
    color = F.col(color) if isinstance(color, str) else color
    return tuple(F.shiftright(color, shift).bitwiseAND(F.lit(255)) for shift in (16, 8, 0))


def unpack_color(spans: DataFrame) -> DataFrame:
    r, g, b = channels("color")
    return spans.withColumns({"r": r, "g": g, "b": b, "color_hex": hex_color("color")})


def hex_color(color: Column | str) -> Column:
    return F.format_string("#%02x%02x%02x", *channels(color))


def is_hidden(color: Column | str = "color", threshold: int = WHITE) -> Column:
    r, g, b = channels(color)
    return (r > threshold) & (g > threshold) & (b > threshold)


def near_background(color: Column | str, background: Column | int, tolerance: int = 255 - WHITE) -> Column:
    """Every channel lies closer to the background's than ``tolerance``."""
    background = F.lit(background) if isinstance(background, int) else background
    close = [F.abs(c - k) < tolerance for c, k in zip(channels(color), channels(background))]
    return close[0] & close[1] & close[2]


def flag_hidden(spans: DataFrame, threshold: int = WHITE, background: Column | int | None = None) -> DataFrame:
    """``is_hidden``, and ``is_background``: the same test unless a background colour is given."""
    hidden = is_hidden("color", threshold)
    same = hidden if background is None else near_background("color", background, 255 - threshold)
    return spans.withColumns({"is_hidden": hidden, "is_background": same})


def hidden_spans(spans: DataFrame, threshold: int = WHITE) -> DataFrame:
    return spans.filter(is_hidden("color", threshold))


def span_statistics(spans: DataFrame, documents: DataFrame | None = None, threshold: int = WHITE) -> DataFrame:
    """Counts per document; documents without spans get a row of zeros."""
    stats = spans.groupBy("doc_id").agg(
        F.count("*").alias("total_spans"),
        F.countDistinct("font").alias("unique_fonts"),
        F.countDistinct("size").alias("unique_sizes"),
        F.countDistinct("color").alias("unique_colors"),
        F.count_if(is_hidden("color", threshold)).alias("hidden_count"),
    )
    if documents is not None:
        stats = documents.select("doc_id").join(stats, "doc_id", "left").fillna(0)
    share = F.when(F.col("total_spans") > 0, F.col("hidden_count") / F.col("total_spans") * 100)
    return stats.withColumn("hidden_percentage", F.coalesce(share, F.lit(0.0)))


def color_distribution(spans: DataFrame) -> DataFrame:
    """Colour counts per document; the total is taken over one row per colour."""
    counts = spans.groupBy("doc_id", "color").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return counts.select(
        "doc_id", hex_color("color").alias("color_hex"), "n", (F.col("n") / total * 100).alias("percentage")
    )


def _chunk(pages: int) -> Column:
    return F.floor(F.col("page") / pages).alias("chunk")


def text_chunks(
    spans: DataFrame, order: Sequence[str] = SPAN_ORDER, pages: int = PAGES_PER_CHUNK, threshold: int = WHITE
) -> DataFrame:
    """``doc_id, side, chunk, text``: the hidden and the visible text per range of pages.

    The page range bounds what one group holds, however long the document is.
    """
    side = F.when(is_hidden("color", threshold), "hidden").otherwise("visible").alias("side")
    ordering = ", ".join(order)
    return (
        spans.select("doc_id", side, _chunk(pages), "text", *order)
        .groupBy("doc_id", "side", "chunk")
        .agg(F.expr(f"listagg(text, ' ') within group (order by {ordering})").alias("text"), F.count("*").alias("spans"))
    )


def with_following(chunks: DataFrame, head: Column, take: int, merge, name: str) -> DataFrame:
    """What the next ``take`` chunks of the same side begin with, for runs that cross a border.

    Only ``head`` travels, not the text; ``merge`` puts the array of heads together and NULL means nothing follows.
    """
    keys = ["doc_id", "side", "chunk"]
    following = Window.partitionBy("doc_id", "side").orderBy("chunk").rowsBetween(1, take)
    heads = (
        chunks.select(*keys, head.alias("_head"))
        .withColumn("_heads", F.collect_list("_head").over(following))
        .filter(F.size("_heads") > 0)
        .select(*keys, merge(F.col("_heads")).alias(name))
    )
    return chunks.join(heads, keys, "left")


def side_content(chunks: DataFrame, side: str = "hidden") -> DataFrame:
    """The whole text of one side per document, put together from its chunks in page order."""
    return (
        chunks.filter(F.col("side") == side)
        .groupBy("doc_id")
        .agg(
            F.expr("listagg(text, ' ') within group (order by chunk)").alias("content"),
            F.sum("spans").alias("span_count"),
        )
    )


def hidden_content(
    spans: DataFrame, order: Sequence[str] = SPAN_ORDER, threshold: int = WHITE, side: str = "hidden"
) -> DataFrame:
    return side_content(text_chunks(spans, order, threshold=threshold), side)


def top_words(spans: DataFrame, k: int = 20, text: str = "text") -> DataFrame:
    """The ``k`` most frequent words per document; ties in alphabetical order.

    Spans are joined by a space, so words never cross spans and can be counted span by span.
    """
    counts = (
        spans.select("doc_id", F.explode(word_runs(text)).alias("word"))
        .groupBy("doc_id", "word")
        .agg(F.count("*").alias("n"))
    )
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def keyword_hits(chunks: DataFrame, keywords: Sequence[str], more_than: int = 3) -> DataFrame:
    """Keywords found as substrings of each document's hidden text, and the stuffing flag.

    Found chunk by chunk; the first characters of the next chunks are appended so that a keyword across a border counts.
    """
    hidden = chunks.filter(F.col("side") == "hidden")
    if not keywords:
        return hidden.select("doc_id").distinct().withColumns({"hits": F.array().cast("array<string>"), "stuffing": F.lit(False)})
    reach = max(len(k) for k in keywords)
    head = F.substring(F.concat(F.lit(" "), "text"), 1, reach)
    spread = with_following(hidden, head, reach, lambda h: F.substring(F.array_join(h, ""), 1, reach), "_next")
    searched = F.lower(F.concat("text", F.coalesce("_next", F.lit(""))))
    seen = spread.select("doc_id", searched.alias("t")).groupBy("doc_id").agg(
        *[F.bool_or(F.col("t").contains(k.lower())).alias(f"k{i}") for i, k in enumerate(keywords)]
    )
    hits = F.array_compact(F.array(*[F.when(F.col(f"k{i}"), F.lit(k)) for i, k in enumerate(keywords)]))
    return seen.select("doc_id", hits.alias("hits")).withColumn("stuffing", F.size("hits") > more_than)


def locate_hidden(hidden: DataFrame, layout: DataFrame, scale: int = 2) -> DataFrame:
    """Boxes of the layout spans that repeat a hidden span on the same page.

    ``layout`` has ``x0, y0, x1, y1``. Equal hidden spans are counted first and every box is given once with the
    number of hidden spans it stands for, so a text repeated n times costs n rows, not n squared.
    """
    key = ["doc_id", "page", "text", "font", "size"]
    counted = hidden.groupBy(*key).agg(F.count("*").alias("times"))
    boxes = [(F.col(c) * scale).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return layout.join(counted, key).select(*key, *boxes, "times")

"""Pieces that several operators share: text rules, row keys, hot keys, running totals.

Rules that hold in every operator. A null text counts as an empty one. A null ``doc_id`` counts as one id, smaller than
any other. Rows are told apart by ``doc_id`` and text together (``text_key``), so repeated ids do no harm and repeated
rows get equal answers. Operators read the columns they name and nothing else, so other columns may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.session import cut_lineage

#: White space of the contracts, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the quick way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_key(text: Column) -> Column:
    """Tells rows of one id apart. Together with the id it keys a row."""
    return F.xxhash64(text)


def hash128(value: Column) -> tuple[Column, Column]:
    """128 bits in two longs: the second half starts from another seed."""
    return F.xxhash64(value), F.xxhash64(F.lit(0x5EED), value)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def hot_values(df: DataFrame, column: str, share: float = 0.002, keep: int = 200) -> list:
    """Values that a bounded sketch holds to be more than ``share`` of the rows, ``keep`` at most.

    Only the placing of rows may depend on it, never a result: a value that is missed is merely not spread.
    """
    sketch = df.select(column).agg(
        F.expr(f"approx_top_k({column}, {keep}, {50 * keep})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return [e["item"] for e in sketch["top"] or [] if e["item"] is not None and e["count"] > share * sketch["n"]]


def running_before(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Adds, under the names in ``sums``, the totals of a column over all rows that come before a row in ``order``.

    Rows are range-partitioned and sorted, each partition is summed, and the partitions' totals (one row each, so their
    number is that of the partitions) are summed in order and added to what a row finds in its own partition. No task
    sees more than its own range. Nulls sort first. The placed rows are written, so that both readings agree and a lost
    executor changes nothing; callers pass narrow rows.
    """
    rows = cut_lineage(df)
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = placed.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    joined = here.join(F.broadcast(totals), "_part")
    return joined.withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in sums}).drop("_part", *[f"_t_{n}" for n in sums])

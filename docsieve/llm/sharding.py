"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.common import running_before, table, text_of


def byte_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row: ids in order, cut where the bytes reach equal targets.

    ``size`` is the text's UTF-8 bytes and one. A row goes to the shard in which the middle of its bytes falls, so a
    shard's bytes miss the target by half a row at each end at most, and only an exceptionally long text can leave
    a shard short or empty. ``slot`` counts a shard's rows from 0 in the order of ids.

    Null texts have size 1 and the checksum of no bytes. Null ids come first. Rows of one id are ordered by checksum and
    size; rows equal in all are interchangeable. An empty table gives no rows. Equal texts may lie in several shards.
    """
    body = text_of(F.col("text")).cast("binary")
    sized = docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), F.lit(1).cast("bigint").alias("_one")
    )
    placed = running_before(sized, ["doc_id", "text_crc32", "size"], {"_bytes": "size", "_rows": "_one"})
    total = placed.agg(F.max(F.col("_bytes") + F.col("size"))).first()[0] or 1
    cut = placed.withColumn("shard", F.expr(f"cast((_bytes * 2 + size) * {int(shards)} div {2 * total} as int)"))
    first = cut.groupBy("shard").agg(F.min("_rows").alias("_first"))  # one row a shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rows") - F.col("_first")).alias("slot")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"), 16).withColumns({
        "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")
    })

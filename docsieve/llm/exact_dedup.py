"""Exact duplicates: equal 128-bit content hashes, confirmed on the bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.common import ascii_lower, hash128, table, text_of


def exact_duplicates(
    docs: DataFrame,
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    hashed: Callable[[Column], tuple[Column, Column]] = hash128,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are grouped by their 128-bit hash and their bytes at once, so two texts that share a hash are two groups. The
    grouping combines on the map side: a task sends a text once, however often it has read it. Members then find their
    group by hash and digest, in a join without texts whose large keys Spark splits.

    The smallest (or largest) id of a group stays. Null texts count as empty ones and are equal to each other. A null id
    counts as the smallest. Repeated rows are members like others; rows that repeat the kept id are all kept. An empty
    table gives no rows.
    """
    h1, h2 = hashed(F.col("_norm"))
    rows = docs.select("doc_id", normalise(text_of(F.col("text"))).alias("_norm"))
    rows = rows.select("doc_id", "_norm", h1.alias("_h1"), h2.alias("_h2"))
    id_order = F.struct(F.col("doc_id"))
    chosen = F.min(id_order) if keep == "smallest" else F.max(id_order)
    groups = rows.groupBy("_h1", "_h2", "_norm").agg(chosen.alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("_h1", "_h2", F.sha2("_norm", 256).alias("text_sha256"), F.col("_keep.doc_id").alias("keep_id"), "group_size")
    members = rows.select("doc_id", "_h1", "_h2", F.sha2("_norm", 256).alias("text_sha256"))
    return members.join(groups, ["_h1", "_h2", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
with n as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents
), g as (
    select t, max(doc_id) keep_id, count(*) group_size from n group by t
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)
"""

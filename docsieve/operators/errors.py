"""Bad rows become error rows; the batch goes on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORTED = (".pdf", ".docx", ".txt")


def extension(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\.[^.]*)$", 1))


def with_errors(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``error``: the message of the first failed check (a condition that must hold), else NULL."""
    message = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in checks.items()])
    return df.withColumn("error", message)


def document_errors(documents: DataFrame, types: tuple[str, ...] = SUPPORTED) -> DataFrame:
    return with_errors(
        documents,
        {"path is missing": F.col("path").isNotNull(), "unsupported file type": extension("path").isin(*types)},
    )

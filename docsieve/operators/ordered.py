"""Ordered computations over keys of any size.

A window partitioned by a key puts that whole key into one task. Here the order is cut into buckets (a year,
a range of line numbers, a range of pages), rows are windowed within (key, bucket), and what crosses a bucket
border travels as one summary row per bucket. A key holding a third of all rows is spread over its buckets.

``bucket`` must be non-decreasing along the order. Both branches start from the same repartitioning, so the rows
are computed and shuffled once (Spark reuses the exchange); only the summaries move again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.session import cut_lineage

_BUCKET = "_bucket"


def place(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Rows by key and bucket, in one shuffle for both branches.

    An exchange is reused only where both branches read the same columns from it. The condition, always true, refers
    to all of them and is not moved below the exchange, so neither branch gets a narrower one of its own.
    """
    placed = df.withColumn(_BUCKET, bucket.cast("bigint")).repartition(*keys, _BUCKET)
    return placed.filter(F.monotonically_increasing_id() >= F.least(F.xxhash64(*placed.columns), F.lit(0)))


def ranged(df: DataFrame, order: Sequence[Column], name: str = "_range") -> DataFrame:
    """``df`` with a bucket along ``order`` (keys first): ranges of about equally many rows, whatever the values are.

    For orders without a natural bucket that bounds its rows. The ranges come from a sample, so they are written once:
    every reader sees the same ones, also after the loss of an executor.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id().cast("bigint")))


def _local(keys: Sequence[str], order: Sequence[Column]) -> Window:
    return Window.partitionBy(*keys, _BUCKET).orderBy(*order)


def _attach(placed: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join of the bucket summaries to the rows."""
    on = [*keys, _BUCKET]
    renamed = summary.select(*[F.col(c).alias(f"_s_{c}") for c in on], "_carry")
    cond = F.lit(True)
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_s_{c}"))
    return placed.join(renamed, cond, "left").drop(*[f"_s_{c}" for c in on])


def along(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Running totals (``sums``) and latest non-null values (``lasts``) up to and including each row."""
    sums, lasts = sums or {}, lasts or {}
    placed = place(df.withColumns({**sums, **lasts}), keys, bucket)
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    totals = [F.sum(n).alias(n) for n in sums]
    latest = [F.max_by(n, F.when(F.col(n).isNotNull(), rank)).alias(n) for n in lasts]
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum(n).over(before).alias(n) for n in sums] + [F.last(n, ignorenulls=True).over(before).alias(n) for n in lasts]
    summary = placed.groupBy(*keys, _BUCKET).agg(*totals, *latest).select(*keys, _BUCKET, F.struct(*carry).alias("_carry"))
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    here = placed.withColumns({
        **{n: F.sum(n).over(upto) for n in sums},
        **{n: F.last(n, ignorenulls=True).over(upto) for n in lasts},
    })
    joined = _attach(here, summary, keys)
    return joined.withColumns({
        **{n: F.col(n) + F.coalesce(F.col("_carry")[n], F.lit(0)) for n in sums},
        **{n: F.coalesce(F.col(n), F.col("_carry")[n]) for n in lasts},
    }).drop("_carry", _BUCKET)


def last_seen(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column, name: str
) -> DataFrame:
    """The latest non-null ``value`` at or before each row."""
    return along(df, keys, order, bucket, lasts={name: value})


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column, name: str
) -> DataFrame:
    """``value`` of the following row. ``order`` must be ascending columns; a null order value sorts first."""
    placed = place(df.withColumn("_v", F.struct(value.alias("v"))), keys, bucket)
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    summary = placed.groupBy(*keys, _BUCKET).agg(F.min_by("_v", rank).alias("_first"))
    by_bucket = Window.partitionBy(*keys).orderBy(_BUCKET)
    summary = summary.withColumn("_carry", F.lead("_first").over(by_bucket)).filter(F.col("_carry").isNotNull())
    here = placed.withColumn("_here", F.lead("_v").over(_local(keys, order)))
    joined = _attach(here, summary, keys)
    return joined.withColumn(name, F.coalesce("_here", "_carry")["v"]).drop("_v", "_here", "_carry", _BUCKET)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, sums: dict[str, Column]
) -> DataFrame:
    """Running totals up to and including each row."""
    return along(df, keys, order, bucket, sums=sums)


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str
) -> DataFrame:
    """1-based position of each row within its key."""
    return running(df, keys, order, bucket, {name: F.lit(1).cast("bigint")})


def around(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    highest: dict[str, Column] | None = None,
) -> DataFrame:
    """The latest non-null value strictly before each row, the first one strictly after it, the greatest one before it.

    ``order`` names columns that tell the rows of a key apart. Only buckets that get something from others have a summary
    joined, so keys that lie in one bucket cost no more than their place.
    """
    before, after, highest = before or {}, after or {}, highest or {}
    values = {**before, **after, **highest}
    placed = place(df.withColumns({f"_v_{n}": v for n, v in values.items()}), keys, bucket)
    rank = F.struct(*order)
    held = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), rank)
    parts = [F.max_by(f"_v_{n}", held(n)).alias(n) for n in before]
    parts += [F.min_by(f"_v_{n}", held(n)).alias(n) for n in after]
    parts += [F.max(f"_v_{n}").alias(n) for n in highest]
    up = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.last(n, ignorenulls=True).over(up).alias(n) for n in before]
    carry += [F.last(n, ignorenulls=True).over(down).alias(n) for n in after]
    carry += [F.max(n).over(up).alias(n) for n in highest]
    summary = placed.groupBy(*keys, _BUCKET).agg(*parts).select(*keys, _BUCKET, F.struct(*carry).alias("_carry"))
    summary = summary.filter(_any([F.col("_carry")[n].isNotNull() for n in values]))
    here_up = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here_down = Window.partitionBy(*keys, _BUCKET).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    here = placed.withColumns({
        **{n: F.last(f"_v_{n}", ignorenulls=True).over(here_up) for n in before},
        **{n: F.last(f"_v_{n}", ignorenulls=True).over(here_down) for n in after},
        **{n: F.max(f"_v_{n}").over(here_up) for n in highest},
    }).drop(*[f"_v_{n}" for n in values])
    joined = _attach(here, summary, keys)
    found = {n: F.coalesce(n, F.col("_carry")[n]) for n in [*before, *after]}
    found |= {n: F.greatest(n, F.col("_carry")[n]) for n in highest}
    return joined.withColumns(found).drop("_carry", _BUCKET)


def _any(flags: Sequence[Column]) -> Column:
    found = F.lit(False)
    for flag in flags:
        found = found | flag
    return found

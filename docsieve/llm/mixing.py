"""Mixing of sources to target weights along a curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.llm.common import running_before, table, text_key, text_of, word_count

#: Weight of a source in the course of the training, in turn for the sources in order: (time, weight) from 0 to 1, linear
#: between. The integrals are the contract's weights 3, 1 and 2: one source fades, one grows, one stays.
SCHEDULES = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 2.0), (1.0, 2.0)))

#: Bytes of targets that are broadcast, and the parts that a source's rows are dealt to beyond that.
BROADCAST_BYTES, PARTS = 16 << 20, 64


def _segments(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(start, weight at the start, slope, integral before it) of each piece."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (w0 + w1) / 2 * (t1 - t0)
    return pieces


def integral(schedule: Sequence[tuple[float, float]]) -> float:
    return sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def _time_of(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` of the schedule's integral has gone: the demand curve, inverted piece by piece."""
    goal = share * integral(schedule)
    when = None
    for t0, w0, slope, area in reversed(_segments(schedule)):
        rest = goal - area
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        at = F.lit(t0) + F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0))
        when = at if when is None else F.when(goal < area + integral_until(schedule, t0), at).otherwise(when)
    return when


def integral_until(schedule: Sequence[tuple[float, float]], start: float) -> float:
    """Integral of the piece that begins at ``start``."""
    return next((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]) if t0 == start)


def source_targets(sources: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds rank, weight and target to (source, source_size).

    Targets share out ``share`` of all sizes by weight; none exceeds ``most`` times its source. Filling to the level L
    gives a source min(weight * L, cap). Sources are met in the order of cap / weight: the level is the first for which
    what the full ones leave, shared by the weights of the rest, doesn't fill the next. Both orders are running totals
    over ranges, so the number of sources is not bound to one task.
    """
    nulls_last = sources.select("source", F.col("source").isNull().alias("_null"), "source_size", F.lit(1).cast("bigint").alias("_one"))
    ranked = running_before(nulls_last, ["_null", "source"], {"_rank": "_one"})
    n = len(schedules)
    weight = F.element_at(F.array(*[F.lit(integral(s)) for s in schedules]), (F.pmod(F.col("_rank"), F.lit(n)) + 1).cast("int"))
    capped = ranked.select(
        "source", "source_size", (F.col("_rank") % n).cast("int").alias("schedule"), weight.alias("_weight"), (F.col("source_size") * most).alias("_cap")
    ).withColumn("_fill", F.col("_cap") / F.col("_weight"))
    filled = running_before(capped, ["_fill", "source"], {"_full": "_cap", "_gone": "_weight"})
    sums = filled.agg(F.sum("source_size").alias("all"), F.sum("_weight").alias("weights")).first()
    level = (F.lit(sums["all"] or 0) * share - F.col("_full")) / (F.lit(sums["weights"]) - F.col("_gone"))
    found = filled.withColumn("_level", level).filter("_level <= _fill").agg(F.min(F.struct("_fill", "_level")).alias("first")).first()["first"]
    at = F.lit(found["_level"] if found else float("inf"))
    return filled.select("source", "source_size", "schedule", F.least(F.col("_cap"), F.col("_weight") * at).alias("target"))


def _with_targets(rows: DataFrame, targets: DataFrame, small: int) -> DataFrame:
    """The rows with their source's target, none of them gathered by source.

    Targets are one row a source: up to ``small`` bytes they are broadcast, beyond that each goes to all parts of its source.
    """
    size = F.coalesce(F.octet_length("_source"), F.lit(0)) + 64
    same = F.col("source").eqNullSafe(F.col("_source"))
    if (targets.agg(F.sum(size)).first()[0] or 0) <= small:
        return rows.join(F.broadcast(targets), same)
    dealt = targets.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_to"))
    parts = rows.withColumn("_part", F.pmod(F.col("_draw"), F.lit(PARTS)).cast("int"))
    return parts.join(dealt, same & (F.col("_part") == F.col("_to"))).drop("_part", "_to")


def plan_mix(
    docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0, whole: bool = False, small: int = BROADCAST_BYTES
) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken, times of every row.

    ``size`` is the number of words. A source's rows lie end to end in an order drawn by hash, again and again: its
    stream. The mix takes the stream up to the source's target, so every row comes as often as any other of the source,
    give or take one. The last row gives the words that are still needed, or with ``whole`` all or none, whichever is
    nearer. ``times`` are the training positions (0 to 1) of the row's copies: where the source's cumulative demand,
    the integral of its weight schedule, reaches the copy's start.

    Offsets within a source are running totals over ranges of (source, hash), so one source may hold any share of all
    rows. Rows without words get size 0, take nothing and have one position, so that they aren't lost from sight; the
    null source is a source, last in order. Ids may be null or repeated. An empty table gives no rows. Reruns agree.
    """
    text = text_of(F.col("text"))
    rows = docs.select("doc_id", text_key(text).alias("text_key"), "source", F.col("source").isNull().alias("_null"), word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("_draw", F.xxhash64(F.lit(17), "doc_id", "text_key"))
    laid = running_before(rows, ["_null", "source", "_draw", "doc_id", "text_key"], {"_before": "size"})
    sources = laid.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_before").alias("_begin"))
    targets = source_targets(sources.select("source", "source_size"), schedules, share, most)
    starts = sources.select(F.col("source").alias("_s"), "_begin")
    targets = targets.join(starts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("source", "_source")
    placed = _with_targets(laid, targets, small).withColumn("_start", F.col("_before") - F.col("_begin"))

    size, goal = F.col("size"), F.floor("target")
    copies = F.sequence(F.lit(0), F.lit(int(most + 0.5) - 1))

    def take(c: Column) -> Column:
        left = F.col("target") - (c * F.col("source_size") + F.col("_start"))
        if whole:
            return F.when(left * 2 >= size, size).otherwise(F.lit(0).cast("bigint"))
        return F.greatest(F.lit(0).cast("bigint"), F.least(size, goal - (c * F.col("source_size") + F.col("_start"))))

    drawn = F.transform(copies, lambda c: F.struct(take(c).alias("words"), (c * F.col("source_size") + F.col("_start")).alias("at")))
    placed = placed.withColumn("_copies", F.filter(drawn, lambda x: x["words"] > 0))
    placed = placed.withColumn("_copies", F.when(F.size("_copies") > 0, F.col("_copies")).otherwise(F.slice(drawn, 1, 1)))

    def when_of(x: Column) -> Column:
        part = F.when(F.col("target") > 0, F.least(x["at"] / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
        at = _time_of(part, schedules[-1])
        for i, s in enumerate(schedules[:-1]):
            at = F.when(F.col("schedule") == i, _time_of(part, s)).otherwise(at)
        return at

    return placed.select(
        "doc_id", "text_key", "source", "size", "source_size", "target",
        F.aggregate("_copies", F.lit(0).cast("bigint"), lambda a, x: a + x["words"]).alias("taken"),
        F.transform("_copies", when_of).alias("times"),
    )


def training_order(plan: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes, range-sorted by training position."""
    copies = plan.filter("taken > 0").select("*", F.explode("times").alias("position"))
    return copies.drop("times").orderBy("position", "doc_id", "text_key")


def mix(docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it (whole), in the struct ``doc``.

    Documents without words, nulls among them, cost a source nothing and come once, at their planned position. Rows that
    repeat id, text and source have places of their own in the plan; each gets one of them, told apart by their other
    columns, and equal rows are interchangeable. Copies at one position are in the order of ids, then texts; a null id comes
    first. An empty table gives no rows. Other columns may have any name.
    """
    key = ["doc_id", "text_key", "source"]
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_id"), text_key(text_of(F.col("text"))).alias("_key"), F.col("source").alias("_source"))
    plan = plan_mix(docs, schedules, share, most, whole=True).select(*key, F.when((F.col("taken") > 0) | (F.col("size") == 0), F.col("times")).alias("times"))
    groups = plan.groupBy(*key).agg(F.first("times").alias("times"), F.count(F.lit(1)).alias("_n"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")) & F.col("_source").eqNullSafe(F.col("source"))
    met = rows.join(groups, same)
    alone = met.filter("_n = 1").select("doc", "_id", "_key", "times")

    number = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(order)).alias("_no")
    again = met.filter("_n > 1").select("doc", *key, number(F.to_json("doc")))
    places = plan.join(groups.filter("_n > 1").select(*[F.col(c).alias(f"_g_{c}") for c in key]), _all_same(key, "_g_"))
    places = places.select(*[F.col(c).alias(f"_p_{c}") for c in key], "times", F.row_number().over(Window.partitionBy(*key).orderBy("times")).alias("_p_no"))
    repeated = again.join(places, _all_same([*key, "_no"], "_p_", {"_no": "_p_no"})).select("doc", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "times")
    copies = alone.unionByName(repeated).select("doc", "_id", "_key", F.explode("times").alias("position"))
    return copies.orderBy("position", "_id", "_key").select("doc", "position")


def _all_same(columns: list[str], prefix: str, names: dict[str, str] | None = None) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & F.col(c).eqNullSafe(F.col((names or {}).get(c, prefix + c)))
    return found


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    first = plan.select("doc_id", "size", "source_size", "target", "taken", F.element_at("times", 1).alias("position"))
    return first.orderBy("position", "doc_id")

"""Joins over time: as of, per marker, in a window, nearest, consecutive versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_strict(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie: str) -> DataFrame:
    """Each left row with the values of the last right row strictly before it; no match, or no time, gives nulls.

    Both sides go through one shuffle and one sort: right rows carry their values into a running "last", and at equal
    times come after the left rows, so the same instant never matches. Among right rows of one instant the largest
    ``tie`` wins. No pair of rows is ever formed.
    """
    payload = F.struct(F.col(right_time).alias("found_time"), *[F.col(v) for v in values])
    ours = left.select(*by, F.col(left_time).alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("tie"), F.struct(*left.columns).alias("row"))
    theirs = right.filter(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("at"), F.lit(1).alias("side"), F.col(tie).cast("long").alias("tie"), payload.alias("seen"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("seen", F.last("seen", ignorenulls=True).over(before)).filter("side = 0")
    known = F.when(F.col("at").isNotNull(), F.col("seen"))
    return seen.select("row.*", known["found_time"].alias("found_time"), *[known[v].alias("found_" + v) for v in values])


def latest_per_key(df: DataFrame, by: Sequence[str | Column], time: str, tie: str, values: Sequence[str]) -> DataFrame:
    """The values of the newest row of each key, ties by ``tie``; combined before the shuffle."""
    newest = F.max_by(F.struct(*values), F.struct(time, tie)).alias("v")
    return df.groupBy(*by).agg(newest).select("*", "v.*").drop("v")


def consecutive_versions(cases: DataFrame) -> DataFrame:
    """(entity_id, case_id, next_id, objective, next_objective): each case with the following version of its entity."""
    w = Window.partitionBy("entity_id").orderBy("version")
    following = cases.select(
        "entity_id", "case_id", "objective", "version", F.lead("case_id").over(w).alias("next_id"), F.lead("objective").over(w).alias("next_objective")
    )
    return following.filter("next_id IS NOT NULL")


def readings_in_window(spans: DataFrame, readings: DataFrame, *, by: str, start: str, stop: str, time: str, value: str) -> DataFrame:
    """Per span the number of readings from ``start`` up to before ``stop``, the first and the last value.

    No reading meets a span. Both ends of every span go, with the readings, through one shuffle and one sort by time: a
    running count before each end tells how many lie between, the last reading before ``stop`` and the first from
    ``start`` on are the nearest ones in that order. Spans may overlap. A span without an end, or that is empty, has none; of
    readings of one instant the smaller value comes first."""
    order = {"r": F.col(time).alias("at"), "s": F.col(start).alias("at"), "e": F.col(stop).alias("at")}
    known = spans.filter(F.col(start).isNotNull() & F.col(stop).isNotNull() & F.col(by).isNotNull() & (F.col(start) < F.col(stop)))
    known = known.withColumn("__span", F.struct(*spans.columns))
    ends = [known.select(F.col(by).alias("key"), order[x], F.lit(0).alias("side"), F.lit(x).alias("kind"), "__span", F.lit(None).cast(readings.schema[value].dataType).alias("v")) for x in "se"]
    found = readings.filter(F.col(time).isNotNull()).select(F.col(by).alias("key"), order["r"], F.lit(1).alias("side"), F.lit("r").alias("kind"), F.lit(None).cast(known.schema["__span"].dataType).alias("__span"), F.col(value).alias("v"))
    both = ends[0].unionByName(ends[1]).unionByName(found)
    in_order = Window.partitionBy("key").orderBy("at", "side", "v")
    before, after = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow), in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    is_reading = F.col("kind") == "r"
    marked = both.select(
        "kind", "__span", F.count(F.when(is_reading, 1)).over(before).alias("before"),
        F.last(F.when(is_reading, F.struct("v")), ignorenulls=True).over(before).alias("last"), F.first(F.when(is_reading, F.struct("v")), ignorenulls=True).over(after).alias("next"),
    ).filter(~is_reading)
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    # Both rows of a span carry it whole, so spans that are equal in all columns have equal answers and are counted on the side.
    per = marked.groupBy("__span").agg((pick("e", "before") - pick("s", "before")).alias("n"), pick("s", "next").alias("first"), pick("e", "last").alias("last"))
    answers = per.select("__span", "n", F.when(F.col("n") > 0, F.col("first.v")).alias("first_value"), F.when(F.col("n") > 0, F.col("last.v")).alias("last_value"))
    named = spans.withColumn("__own", F.struct(*spans.columns)).join(answers, F.col("__own").eqNullSafe(F.col("__span")), "left")
    return named.select(*spans.columns, F.coalesce("n", F.lit(0)).alias("n"), "first_value", "last_value")


def nearest_by_time(left: DataFrame, right: DataFrame, *, by: str, left_id: str, left_time: str, right_id: str, right_time: str, k: int) -> DataFrame:
    """The ``k`` right rows of the same key nearest in time, the smaller id first among equals.

    The right rows of a key are numbered in order of time. In one sorted pass each left row gets the number of right rows
    before it, so its nearest ``k`` on either side are known by their numbers and joined by equality: 2k candidates a left row."""
    seen = right.filter(F.col(right_time).isNotNull()).select(F.col(by).alias("key"), F.col(right_id).alias("near_id"), F.col(right_time).alias("near_time"))
    w = Window.partitionBy("key")
    # Rows of one instant stand in the order in which they are wanted: rising ids after a left row, falling ids before it.
    numbered = seen.select("*", F.row_number().over(w.orderBy("near_time", "near_id")).alias("up"), F.row_number().over(w.orderBy("near_time", F.desc("near_id"))).alias("down"))
    asked = left.filter(F.col(left_time).isNotNull()).select(F.col(by).alias("key"), F.col(left_id).alias("__id"), F.col(left_time).alias("at"))
    both = asked.select("key", "__id", "at", F.lit(0).alias("side")).unionByName(
        seen.select("key", F.lit(None).cast(left.schema[left_id].dataType).alias("__id"), F.col("near_time").alias("at"), F.lit(1).alias("side"))
    )
    running = w.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("before", F.sum("side").over(running)).filter("side = 0").select("key", "__id", "at", "before")
    spots = lambda low, high: F.explode(F.sequence(F.col("before") + low, F.col("before") + high)).alias("spot")
    after = placed.select("key", "__id", "at", spots(1, k)).join(numbered.select("key", F.col("up").cast("long").alias("spot"), "near_id", "near_time"), ["key", "spot"])
    earlier = placed.select("key", "__id", "at", spots(1 - k, 0)).join(numbered.select("key", F.col("down").cast("long").alias("spot"), "near_id", "near_time"), ["key", "spot"])
    gap = F.abs(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("near_time").cast("timestamp")))
    near = after.unionByName(earlier).withColumn("gap", gap)
    nth = F.row_number().over(Window.partitionBy("__id").orderBy("gap", "near_id"))
    return near.withColumn("nth", nth).filter(F.col("nth") <= k).select(F.col("__id").alias(left_id), "near_id", "gap", "nth")


def unmatched_report(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(side, n, n_<field> ...): rows only left, only right or in both, and how many of both agree on each field."""
    x = a.select(F.col(key), F.lit(True).alias("in_a"), *[F.col(f).alias("a_" + f) for f in fields])
    y = b.select(F.col(key), F.lit(True).alias("in_b"), *[F.col(f).alias("b_" + f) for f in fields])
    side = F.when(F.col("in_b").isNull(), "left").when(F.col("in_a").isNull(), "right").otherwise("both")
    agree = [F.count_if(F.col("a_" + f) == F.col("b_" + f)).alias("n_" + f) for f in fields]
    return x.join(y, key, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"), *agree)

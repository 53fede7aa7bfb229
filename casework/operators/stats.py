"""Evaluation statistics over tables of paired values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.sources.storage import written


def md5_number(*columns: Column) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the columns only, the same in any engine."""
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def poisson_weight(u: Column) -> Column:
    """How often a row is drawn in a bootstrap replicate: a Poisson(1) count, at most 8, from a number in [0, 1)."""
    weight, below, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        below += p
        weight += (u >= below).cast("int")  # a sum, in which ``u`` is worked out once
        p /= k
    return weight


def normal_tail(z: Column) -> Column:
    """Probability that a standard normal value is farther from zero than ``z``, on both sides, to seven digits.

    Fixed values: the coefficients of the rational approximation 7.1.26 of the error function in Abramowitz and Stegun."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def binomial_two_sided(wins: Column, losses: Column) -> Column:
    """Exact two-sided probability of a split as uneven as this among wins + losses fair tosses; 1 for none. Terms are summed by their logarithms, so
    any number of tosses will do."""
    n, least = (wins + losses).cast("double"), F.least(wins, losses)
    start = F.struct((-n * math.log(2)).alias("log"), F.exp(-n * math.log(2)).alias("sum"))
    step = lambda s, k: F.struct((s["log"] + F.log((n - k + 1) / k)).alias("log"), (s["sum"] + F.exp(s["log"] + F.log((n - k + 1) / k))).alias("sum"))
    terms = F.when(least > 0, F.sequence(F.lit(1).cast("long"), least)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(terms, start, step)["sum"])


#: Values of a group that are ranked in different tasks.
PARTS = 32
#: Rows of counted ranks that are sent to every task; more are shuffled.
BROADCAST_ROWS = 50_000


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the rank of a value within its group, ties sharing their mean rank.

    A group may hold any share of the rows: its values are dealt over parts by approximate quantiles, ranked within
    their part, and raised by the rows of the parts below. Equal values are of one part, so the rank is exact."""
    shares = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    bounds = df.groupBy(*by).agg(F.percentile_approx(value, shares, F.lit(1000)).alias("__bounds"))
    on = [F.col("l." + c).eqNullSafe(F.col("r." + c)) for c in by]
    parted = df.alias("l").join(bounds.alias("r"), on).select("l.*", F.size(F.filter("__bounds", lambda b: b < F.col("l." + value))).alias("__part"))
    sizes = parted.groupBy(*by, "__part").agg(F.count("*").alias("__rows"))
    below = F.coalesce(F.sum("__rows").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select(*by, "__part", below.alias("__below"))
    inside, same = Window.partitionBy(*by, "__part"), Window.partitionBy(*by, "__part", value)
    ranked = parted.withColumn("__rank", F.rank().over(inside.orderBy(value)) + (F.count("*").over(same) - 1) / 2)
    on = [F.col("l." + c).eqNullSafe(F.col("r." + c)) for c in (*by, "__part")]
    placed = ranked.alias("l").join(before.alias("r"), on).select("l.*", "r.__below")
    return placed.withColumn(name, F.col("__rank") + F.col("__below")).drop("__rank", "__below", "__part")


def _centred_rank(counts: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds to (*by, value, __n), a row for each different value, the rank that average_rank gives its __n rows, less the group's mean rank."""
    shares = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    bounds = counts.groupBy(*by).agg(F.percentile_approx(value, shares, F.lit(1000)).alias("__bounds"))
    on = [F.col("l." + c).eqNullSafe(F.col("r." + c)) for c in by]
    parted = counts.alias("l").join(bounds.alias("r"), on).select("l.*", F.size(F.filter("__bounds", lambda b: b < F.col("l." + value))).alias("__part"))
    sizes = parted.groupBy(*by, "__part").agg(F.sum("__n").alias("__rows"))
    group = Window.partitionBy(*by)
    below = F.coalesce(F.sum("__rows").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select(*by, "__part", (below - (F.sum("__rows").over(group) + 1) / 2).alias("__below"))
    inside = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = parted.withColumn("__rank", F.coalesce(F.sum("__n").over(inside), F.lit(0)) + (F.col("__n") + 1) / 2)
    on = [F.col("l." + c).eqNullSafe(F.col("r." + c)) for c in (*by, "__part")]
    placed = ranked.alias("l").join(before.alias("r"), on).select("l.*", "r.__below")
    return placed.withColumn(name, F.col("__rank") + F.col("__below")).drop("__rank", "__below", "__part")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group, with the number of pairs; null where one side does not vary.

    Rows are counted by value before they are ranked, so a side of few different values costs rows of values, not of pairs:
    the ranks of y go to the rows, whose sums by x meet the ranks of x."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ys = written(_centred_rank(rows.groupBy(*by, "__y").agg(F.count("*").alias("__n")), by, "__y", "__ry"))
    if ys.count() <= BROADCAST_ROWS:
        ys = F.broadcast(ys)
    on = [F.col("l." + c).eqNullSafe(F.col("r." + c)) for c in (*by, "__y")]
    both = rows.alias("l").join(ys.alias("r"), on).select(*["l." + c for c in by], "__x", "__ry")
    sums = both.groupBy(*by, "__x").agg(F.count("*").alias("__n"), F.sum("__ry").alias("__s"), F.sum(F.col("__ry") * F.col("__ry")).alias("__yy"))
    ranked = _centred_rank(sums, by, "__x", "__rx")
    spread = F.sqrt(F.sum(F.col("__n") * F.col("__rx") * F.col("__rx"))) * F.sqrt(F.sum("__yy"))
    return ranked.groupBy(*by).agg(F.sum("__n").alias("n"), F.round(F.sum(F.col("__rx") * F.col("__s")) / F.nullif(spread, F.lit(0.0)), 6).alias("rho"))


def wilcoxon(df: DataFrame, difference: Column) -> DataFrame:
    """Signed-rank sums of paired differences, zeros dropped, and the normal score with continuity correction and its
    two-sided probability."""
    rows = df.select(difference.alias("d")).filter("d IS NOT NULL AND d <> 0").withColumn("size", F.abs("d")).withColumn("all", F.lit(1))
    # Ranks over distinct sizes: equal sizes are counted first, so the one ordered window has a row per size, not per pair.
    sizes = rows.groupBy("size").agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("c") + 1) / 2)
    sums = ranked.agg(F.sum("c").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum((F.col("c") - F.col("up")) * F.col("rank")).alias("w_minus"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    n = F.col("n").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = (F.greatest(F.abs(F.col("w_plus") - mean) - 0.5, F.lit(0.0))) / F.nullif(F.sqrt(var), F.lit(0.0))
    return sums.select("n", "w_plus", "w_minus", F.round(z, 6).alias("z"), F.round(normal_tail(z), 5).alias("p"))


def bootstrap_mean(df: DataFrame, value: str, key: str, *, replicates: int, seed: str = "mean") -> DataFrame:
    """(n, mean, positive, low, high): mean and 95 % percentile interval of a paired difference. Each row has a Poisson(1) weight per replicate
    from a hash of (seed, replicate, key), so resampling shuffles no rows, only a sum per replicate and task, and repeats exactly."""
    drawn = df.filter(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    weighted = drawn.withColumn("w", poisson_weight(md5_number(F.lit(seed), F.col("replicate"), F.col(key)) / F.lit(float(1 << 32))))
    means = weighted.groupBy("replicate").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    band = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("positive")).crossJoin(F.broadcast(band))


def entropy(counts: Column) -> Column:
    """Shannon entropy of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))

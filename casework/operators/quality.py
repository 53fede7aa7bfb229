"""Schema and key checks, merges and normalisation of incoming rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def schema_conformance(df: DataFrame, declared: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """(column, problem, n): declared columns that are missing, of another type, or null though required. One scan."""
    present = {f.name: f.dataType.simpleString() for f in df.schema}
    spark, found = df.sparkSession, []
    for name, (kind, _) in declared.items():
        if name not in present:
            found.append((name, "missing", 0))
        elif present[name] != kind:
            found.append((name, "type " + present[name], 0))
    shape = T.StructType([T.StructField("column", T.StringType()), T.StructField("problem", T.StringType()), T.StructField("n", T.LongType())])
    problems = spark.createDataFrame(found, shape)
    required = [c for c, (_, needed) in declared.items() if needed and c in present]
    if not required:
        return problems
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    pairs = ", ".join(f"'{c}', `{c}`" for c in required)
    nulls = counts.selectExpr(f"stack({len(required)}, {pairs}) AS (column, n)").filter("n > 0")
    return problems.unionByName(nulls.select("column", F.lit("null").alias("problem"), "n"))


def orphans(child: DataFrame, parent: DataFrame, child_key: Sequence[str], parent_key: Sequence[str], check: str) -> DataFrame:
    """One row (check, n): child rows whose key has no parent."""
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_key, child_key, strict=True)]).distinct()
    return child.join(keys, list(child_key), "left_anti").agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), "n")


def duplicates(df: DataFrame, key: Sequence[str], check: str) -> DataFrame:
    """One row (check, n): keys that occur more than once."""
    repeated = df.groupBy(*key).agg(F.count("*").alias("c")).filter("c > 1")
    return repeated.agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), "n")


def latest_wins_merge(versions: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several loads, later loads last: of each key the latest stays, whole."""
    all_rows = None
    for n, df in enumerate(versions):
        part = df.withColumn("load", F.lit(n))
        all_rows = part if all_rows is None else all_rows.unionByName(part)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("load")))
    return all_rows.withColumn("nth", newest).filter("nth = 1").drop("nth")


def idempotent_append(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of the new rows those whose natural key is unknown so far, one per key, the first in ``order``."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return new.join(old.select(*key).distinct(), list(key), "left_anti").withColumn("nth", first).filter("nth = 1").drop("nth")


def share_cells(df: DataFrame, cell: str, least: int) -> DataFrame:
    """Shares of the cells with at least ``least`` rows, which then add up to 1."""
    counts = df.groupBy(cell).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def spread_profile(df: DataFrame, by: Sequence[str], value: str, least: int = 10) -> DataFrame:
    """Count, mean, deviation, percentiles, least and greatest value of each group with at least ``least`` rows."""
    shape = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p")
    stats = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("sd"), shape, F.min(value).alias("low"), F.max(value).alias("high")
    )
    places = [F.round(F.col("p")[k], 6).alias(name) for k, name in enumerate(("p05", "p50", "p95"))]
    return stats.filter(F.col("n") >= least).select(*by, "n", "mean", "sd", *places, "low", "high")


def publication_guard(df: DataFrame, allowed: Sequence[str], pseudonym: str) -> DataFrame:
    """Per allowed string column how many values look like a pseudonym; columns outside the list never leave."""
    public = df.select(*allowed)
    texts = [f.name for f in public.schema if isinstance(f.dataType, T.StringType)]
    counts = public.agg(*[F.count_if(F.col(c).rlike(pseudonym)).alias(c) for c in texts])
    pairs = ", ".join(f"'{c}', `{c}`" for c in texts)
    return counts.selectExpr(f"stack({len(texts)}, {pairs}) AS (column, n_hits)")


def manifest_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, state): units only in one of two versions, or whose content changed, by SHA-256."""
    a = old.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("old_sha"))
    b = new.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("new_sha"))
    state = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").when(F.col("old_sha") != F.col("new_sha"), "changed")
    return a.join(b, key, "full_outer").withColumn("state", state).filter("state IS NOT NULL").select(key, "state")

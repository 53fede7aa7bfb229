"""Proposals as printable lines, groups split by role, and labels from the first source that has one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def render_lines(proposal: DataFrame) -> DataFrame:
    """(query_id, slot, line): one line for each slot, its products in order of position as ``quantity unit product``, joined
    by slashes. A quantity is written without a fraction where it has none; one that is unknown is left out."""
    amount = F.when(F.col("quantity") == F.floor("quantity"), F.floor("quantity").cast("string")).otherwise(F.col("quantity").cast("string"))
    said = F.concat_ws(" ", amount, F.when(F.col("quantity").isNotNull(), F.col("unit")), "family")
    ordered = F.sort_array(F.collect_list(F.struct("position", said.alias("said"))))
    return proposal.groupBy("query_id", "slot").agg(F.array_join(F.transform(ordered, lambda x: x["said"]), " / ").alias("line"))


def split_mixed_groups(items: DataFrame, group: Sequence[str], role: str) -> DataFrame:
    """The items with ``part``: within a group each role gets a number of its own, in order of the role."""
    return items.withColumn("part", F.dense_rank().over(Window.partitionBy(*group).orderBy(role)))


def label_fallback_chain(sources: Sequence[tuple[str, Column]]) -> tuple[Column, Column, Column]:
    """Of named label columns, in order of trust: the first label that is there (not null, not empty), where it comes from,
    and whether it was inferred, that is, does not come from the first source."""
    present = [(name, F.nullif(label, F.lit(""))) for name, label in sources]
    label = F.coalesce(*[x for _, x in present])
    source = F.coalesce(*[F.when(x.isNotNull(), F.lit(name)) for name, x in present])
    return label, source, label.isNotNull() & (source != F.lit(sources[0][0]))

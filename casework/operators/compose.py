"""The parts of composition whose steps depend on each other, in order, within one query: grouped functions over the few
products of a neighbourhood, with everything that can be counted beforehand joined on by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.sources.storage import cut


def alternative_groups(products: DataFrame, pairs: DataFrame, *, product: str = "family", most: int = 4, share: float = 0.5) -> DataFrame:
    """(query_id, slot, product, group_no): products in order of support join the first group that has room and enough
    interchangeable members, else they lead a new one. A slot has at most as many products as the catalogue has families,
    so a group is small whatever the table's size."""
    linked = pairs.groupBy(F.col("a").alias(product)).agg(F.sort_array(F.collect_set("b")).alias("linked"))
    rows = products.join(linked, product, "left").select("query_id", "slot", product, "support", "linked")

    def lead(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["support", product], ascending=[False, True])
        groups: list[list[str]] = []
        numbers = []
        for name, linked in zip(frame[product], frame["linked"], strict=True):
            known = set(linked) if linked is not None else set()
            for n, group in enumerate(groups):
                if len(group) < most and len(known & set(group)) >= share * len(group):
                    group.append(name)
                    numbers.append(n)
                    break
            else:
                groups.append([name])
                numbers.append(len(groups) - 1)
        return frame[["query_id", "slot", product]].assign(group_no=numbers)

    return rows.groupBy("query_id", "slot").applyInPandas(lead, f"query_id long, slot string, {product} string, group_no int")


def rotate(current: DataFrame, repertoire: DataFrame, habits: DataFrame, refused: DataFrame, *, budgets: dict[str, float], least_n: int = 1) -> DataFrame:
    """(query_id, slot, line_no, old, new, fate): which products of a plan give way to others of their family and role, least persistent first.

    ``current``: query_id, slot, line_no, product, family, role, kind; ``repertoire``: product, family, role, place (its rank); ``habits``: product,
    persistence, n, anchor; ``refused``: query_id, product that are not to be proposed. Each ``kind`` has a budget of its own, its share of the plan's products of that kind, rounded. A substitute is
    the best placed of the same family and role that is neither in the plan nor refused nor used already for this plan; so line-mates, which share a role,
    keep sharing it. ``fate``: renewed, anchor, rare (fewer than ``least_n`` cases known), budget, or none (no substitute).

    The order matters within a plan, so a plan's rows are read in order by one task, each with as many candidates as it can need: of a family and
    role the products in the plan, those refused and those used together are fewer than twice the plan's size plus the refusals, so the best of one
    more than that always hold the choice. They are listed once for each family and role, and a row takes the beginning of its list."""
    sizes = current.groupBy("query_id").agg(F.count("*").alias("size"))
    turned_down = refused.filter("product IS NOT NULL").groupBy("query_id").agg(F.collect_set("product").alias("turned_down"))
    plans = sizes.join(turned_down, "query_id", "left").withColumn("turned_down", F.coalesce("turned_down", F.array().cast(turned_down.schema["turned_down"].dataType)))
    plans = plans.select("query_id", "turned_down", (2 * F.col("size") + F.size("turned_down") + 1).cast("int").alias("need"))
    asked = current.join(plans.select("query_id", "need"), "query_id")
    most = asked.groupBy("family", "role").agg(F.max("need").alias("most"))
    w = Window.partitionBy("family", "role").orderBy("place", "product")
    ranked = repertoire.select("family", "role", "product", F.row_number().over(w).alias("nth")).join(most, ["family", "role"]).filter("nth <= most")
    listed = ranked.groupBy("family", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "product"))), lambda x: x["product"]).alias("listed"))
    free = F.filter(F.slice("listed", F.lit(1), F.col("need")), lambda p: ~F.array_contains("turned_down", p))
    known = habits.select("product", F.col("persistence").alias("kept"), F.col("n").alias("cases"), "anchor")
    rows = current.join(known, "product", "left").join(plans, "query_id").join(listed, ["family", "role"], "left").select(
        "query_id", "slot", "line_no", "product", "kind", F.coalesce(F.col("kept").cast("double"), F.lit(0.0)).alias("persistence"), (F.coalesce("cases", F.lit(0)) < least_n).alias("rare"), F.coalesce("anchor", F.lit(False)).alias("anchor"), free.alias("options")
    )
    last = [F.asc_nulls_last(c) for c in ("slot", "line_no", "product")]
    dealt = rows.repartition("query_id").sortWithinPartitions("query_id", "persistence", *last)
    shares = dict(budgets)

    def turn(plan: list[tuple]) -> Iterator[tuple]:
        kinds = [kind for _, _, _, _, kind, *_ in plan]
        left = {kind: round(share * kinds.count(kind)) for kind, share in shares.items()}
        present = {product for _, _, _, product, *_ in plan}
        for query, slot, line_no, product, kind, _, rare, anchor, options in plan:
            new, fate = None, "none"
            if anchor:
                fate = "anchor"
            elif rare:
                fate = "rare"
            elif left.get(kind, 0) <= 0:
                fate = "budget"
            else:
                new = next((p for p in (options if options is not None else ()) if p not in present), None)
                if new is not None:
                    fate = "renewed"
                    left[kind] -= 1
                    present.add(new)
            yield query, slot, line_no, product, new, fate

    def plans_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        changed = (change for _, plan in groupby(read, key=lambda row: row[0]) for change in turn(list(plan)))
        while part := list(islice(changed, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds_out, strict=True)], names_out)

    names_out = ["query_id", "slot", "line_no", "old", "new", "fate"]
    kinds_out = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return dealt.mapInArrow(plans_in_order, "query_id long, slot string, line_no int, old long, new long, fate string")


def compound_partition(joined: DataFrame, *, share: float = 0.5, least: int = 1, alternatives: DataFrame | None = None) -> DataFrame:
    """(node, component) of the products that stand joined in at least ``share`` of the cases they share and in ``least`` cases at least.
    ``joined``: a, b, together, shared; pairs in ``alternatives`` (a, b, in either order) are a choice and join nothing.

    Every node takes the smallest label around it and then the label of its label, so rounds grow with the logarithm of the longest chain; it
    ends when no label moves. The catalogue bounds nodes and links; each round is cut in the checkpoint folder."""
    links = joined.filter((F.col("together") >= share * F.col("shared")) & (F.col("together") >= least)).select("a", "b")
    both = links.union(links.select("b", "a")).distinct()
    if alternatives is not None:
        pairs = alternatives.select("a", "b")
        both = both.join(pairs.union(pairs.select("b", "a")).distinct(), ["a", "b"], "left_anti")
    both = cut(both)
    labels = cut(joined.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = cut(labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component")))
        onward = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = cut(lower.join(onward, "component").select("node", F.col("further").alias("component"), "was"))
        if labels.filter("component <> was").isEmpty():
            return labels.select("node", "component")
        labels = labels.drop("was")

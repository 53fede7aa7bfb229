"""A whole plan from a neighbourhood: consensus, repeats, required and missing parts, amounts, in the order in which they are delivered."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.functions.columns import clamp, grid_round
from casework.operators import consensus as C


def settle_loose(rows: DataFrame, loose: str, *, least: int = 2, lead: int = 2) -> DataFrame:
    """The neighbours' items, those of the slot ``loose`` moved to where the same query's neighbours otherwise place their family: the slot of
    most cases, if ``least`` cases have it there and ``lead`` more than in the next. Where votes are fewer or closer, items stay."""
    votes = rows.filter(F.col("slot") != loose).groupBy("query_id", "family", "slot").agg(F.count_distinct("case_id").alias("c"))
    order = Window.partitionBy("query_id", "family").orderBy(F.desc("c"), "slot")
    first = votes.select("*", F.row_number().over(order).alias("r"), F.coalesce(F.lead("c").over(order), F.lit(0)).alias("next")).filter(F.col("r") == 1)
    target = first.filter((F.col("c") >= least) & (F.col("c") - F.col("next") >= lead)).select("query_id", "family", F.col("slot").alias("target"))
    settled = F.when(F.col("slot") == loose, F.coalesce("target", "slot")).otherwise(F.col("slot"))
    return rows.join(target, ["query_id", "family"], "left").withColumn("slot", settled).select(*rows.columns)


def attached_rules(chosen: DataFrame, rules: DataFrame) -> DataFrame:
    """``chosen`` with ``rules``, the sorted names of the rules that ask for the family in its slot; ``rules``: rule, family, slot (null: any)."""
    of_family = rules.groupBy("family").agg(F.array_sort(F.collect_set(F.struct("rule", F.col("slot").alias("where")))).alias("known"))
    fits = F.filter("known", lambda r: r["where"].isNull() | (r["where"] == F.col("slot")))
    names = F.array_distinct(F.transform(fits, lambda r: r["rule"]))
    return chosen.join(of_family, "family", "left").withColumn("rules", F.coalesce(names, F.array().cast("array<string>"))).drop("known")


def chosen_products(rows: DataFrame, near: DataFrame, *, share: float, floor: int, penalty: float, required: Sequence[tuple[str | None, str]]) -> DataFrame:
    """(query_id, slot, family, cases, support, reason): what a plan holds, each with the neighbours' cases behind it.

    ``consensus``: in a slot that a ``share`` of the neighbours has, what that share of those holds, and ``floor`` cases at least; a family that is
    placed already needs ``penalty`` more for each slot before. ``required``: a family that a slot of the plan must have (any slot where it is
    null) and lacks, if a neighbour holds it there. ``topped up``: further families of ``floor`` cases, the best supported first, until the slot has as
    many as the median neighbour with that slot."""
    slots = C.slot_consensus(rows, near, share, floor)
    products = C.product_consensus(rows, slots, "family", share, floor)
    ordered = products.groupBy("query_id", "family").agg(F.array_sort(F.collect_list(F.struct("slot", "support"))).alias("supports"))
    placed = ordered.select("query_id", "family", F.explode(C.accepted_slots(F.col("supports"), F.lit(share), penalty)).alias("slot"))
    key = ["query_id", "slot", "family"]
    held = rows.groupBy(*key).agg(F.count_distinct("case_id").alias("cases")).join(slots.select("query_id", "slot", "slot_cases"), ["query_id", "slot"])
    held = held.withColumn("support", F.round(F.col("cases") / F.col("slot_cases"), 6)).drop("slot_cases")
    agreed = held.join(placed, key).withColumn("reason", F.lit("consensus"))

    wanted = reduce(lambda a, b: a | b, [(F.col("family") == family) & (F.lit(True) if slot is None else F.col("slot") == slot) for slot, family in required], F.lit(False))
    lacking = held.filter(wanted).join(agreed.select(*key), key, "left_anti").withColumn("reason", F.lit("required"))
    have = agreed.unionByName(lacking)

    per_case = rows.groupBy("query_id", "slot", "case_id").agg(F.count_distinct("family").alias("n"))
    need = per_case.groupBy("query_id", "slot").agg(F.floor(F.percentile("n", F.lit(0.5))).alias("need"))
    so_far = have.groupBy("query_id", "slot").agg(F.count("*").alias("have"))
    rest = held.filter(F.col("cases") >= floor).join(have.select(*key), key, "left_anti").join(need, ["query_id", "slot"]).join(so_far, ["query_id", "slot"], "left")
    nth = F.row_number().over(Window.partitionBy("query_id", "slot").orderBy(F.desc("cases"), "family"))
    more = rest.withColumn("nth", nth).filter(F.coalesce("have", F.lit(0)) + F.col("nth") <= F.col("need"))
    return have.unionByName(more.select(*have.columns[:-1], F.lit("topped up").alias("reason")))


def amounts(rows: DataFrame, chosen: DataFrame, bands: DataFrame, ceilings: DataFrame, *, base_unit: str, step: float, least_ratio: float = 0.0) -> DataFrame:
    """``chosen`` with unit, quantity and change: the median of the neighbours' most frequent unit; a count above its unit's ceiling is read
    in ``base_unit`` or, above that too, unknown; then drawn into the band of its family and unit (p05, p95), raised to ``least_ratio`` of the
    largest quantity of its unit in the slot, and put on the grid. ``change`` names what was done, the last step that did anything."""
    key = ["query_id", "slot", "family"]
    median = C.modal_unit_median(rows, key).select(*key, "unit", "quantity").withColumn("said", F.struct("unit", "quantity"))
    repaired = C.impossible_quantity_repair(median, ceilings, base_unit)
    banded = repaired.join(bands.select("family", "unit", "p05", "p95"), ["family", "unit"], "left")
    inside = F.when(F.col("p05").isNotNull() & F.col("quantity").isNotNull(), clamp(F.col("quantity"), F.col("p05"), F.col("p95"))).otherwise(F.col("quantity"))
    change = F.when(F.col("quantity").isNull(), "unknown").when(F.col("unit") != F.col("said.unit"), "other unit").when(inside != F.col("quantity"), "clamped").otherwise("kept")
    out = chosen.join(banded.select(*key, "unit", inside.alias("quantity"), change.alias("change")), key, "left")
    floor = F.lit(least_ratio) * F.max("quantity").over(Window.partitionBy("query_id", "slot", "unit"))
    small = F.col("quantity") < F.col("floor")
    raised = F.when(small, F.col("floor")).otherwise(F.col("quantity"))
    out = out.withColumn("floor", floor).withColumn("change", F.when(small, "raised").otherwise(F.col("change")))
    return out.withColumn("quantity", grid_round(raised, step)).drop("floor")


def compose_plan(
    rows: DataFrame, near: DataFrame, bands: DataFrame, ceilings: DataFrame, *, share: float, floor: int = 2, penalty: float = 0.0,
    required: Sequence[tuple[str | None, str]] = (), never: Sequence[tuple[str, str]] = (), base_unit: str, step: float = 5.0,
    loose: str | None = None, least_ratio: float = 0.0, rules: DataFrame | None = None,
) -> DataFrame:
    """(query_id, slot, position, family, cases, support, reason, unit, quantity, change, and rules if given) of every query's plan.

    ``rows``: query_id, case_id, slot, family, unit, quantity, the neighbours' items; ``near``: query_id, case_id; ``never``: slots with a family that goes from
    them before anything is counted; ``loose``: a slot whose items go where votes place them, before that. See settle_loose,
    chosen_products, amounts and attached_rules. Everything is grouped by query and slot, whose
    size the neighbourhood bounds."""
    if loose is not None:
        rows = settle_loose(rows, loose)
    for slot, family in never:
        rows = rows.filter(~((F.col("slot") == slot) & (F.col("family") == family)))
    chosen = chosen_products(rows, near, share=share, floor=floor, penalty=penalty, required=required)
    out = amounts(rows, chosen, bands, ceilings, base_unit=base_unit, step=step, least_ratio=least_ratio)
    if rules is not None:
        out = attached_rules(out, rules)
    rank = F.when(F.col("reason") == "consensus", 0).when(F.col("reason") == "required", 1).otherwise(2)
    position = F.row_number().over(Window.partitionBy("query_id", "slot").orderBy(rank, F.desc("support"), "family"))
    columns = ["query_id", "slot", "position", "family", "cases", "support", "reason", "unit", "quantity", "change"]
    return out.withColumn("position", position).select(*columns, *([] if rules is None else ["rules"]))

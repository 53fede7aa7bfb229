"""Queries of the order-dependent parts of composition, rotation and the evaluation over real cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators import compose
from casework.operators import consensus as C
from casework.operators import mining as M
from casework.operators import proposal
from casework.plans import q_mining, q_retrieval
from casework.plans.registry import query
from casework.sources.tables import Tables


@query()
def alternative_grouping(t: Tables) -> DataFrame:
    _, _, products = q_retrieval.consensus_rows(t)
    pairs = C.alternative_pairs(t.named_items, "family", ["case_id", "slot", "line_group"]).filter("n_cases >= 2")
    return compose.alternative_groups(products, pairs)


@query()
def compose_plan(t: Tables) -> DataFrame:
    """Every stated query's whole plan: what its neighbours agree on, what rules ask for, what fills a slot, and how much of it."""
    near = q_retrieval.neighbourhood(t)
    rows = t.once("neighbour_items", lambda: C.neighbour_items(near.select("query_id", "case_id"), t.named_items.select("case_id", "slot", "family", "unit", "quantity")))
    bands = M.quantity_bands(t.named_items, ["family", "unit"], least=30)
    ceilings = t.spark.createDataFrame([("u0", 50.0), ("u1", 30.0), ("u2", 28.0)], "unit string, ceiling double")
    rules = t.spark.createDataFrame([("promo in RF", "PROMO", "RF"), ("standard", "STANDARD", None), ("economy in NO", "ECONOMY", "NO"), ("economy", "ECONOMY", None)], "rule string, family string, slot string")
    return proposal.compose_plan(
        rows, near, bands, ceilings, share=0.3, penalty=0.1, required=[(None, "STANDARD"), ("AF", "ECONOMY")], never=[("RF", "PROMO")], base_unit="u0",
        loose="NO", least_ratio=0.25, rules=rules,
    )


@query()
def rotate(t: Tables) -> DataFrame:
    """The latest version of every entity, renewed: three tenths of its products, one tenth of the bulky ones; nothing that the entity sent back before."""
    latest = q_mining.latest_version(t).select("entity_id", "case_id")
    parts = t.catalogue.select("product_id", "family", F.col("grp").alias("role"), F.when(F.col("bulky"), "slow").otherwise("main").alias("kind"))
    lines = latest.join(t.items, "case_id").groupBy(F.col("case_id").alias("query_id"), F.col("product_id")).agg(F.min("slot").alias("slot"), F.min("line").cast("int").alias("line_no"))
    current = lines.join(parts, "product_id").withColumnRenamed("product_id", "product")
    counts = t.items.groupBy("product_id").agg(F.count_distinct("case_id").alias("n"))
    place = counts.join(parts, "product_id").select(F.col("product_id").alias("product"), "family", "role", (-F.col("n")).alias("place"))
    habits = counts.join(t.catalogue.select("product_id", "grp"), "product_id").join(q_mining.anchor_products(t).select("grp", "persistence", "anchor"), "grp", "left")
    back = t.items.filter("slot LIKE 'R%'").join(t.headers.select("case_id", "entity_id"), "case_id").join(latest.withColumnRenamed("case_id", "query_id"), "entity_id")
    refused = back.select("query_id", F.col("product_id").alias("product"))
    return compose.rotate(current, place, habits.withColumnRenamed("product_id", "product"), refused, budgets={"main": 0.3, "slow": 0.1}, least_n=2)


_STEP = "SELECT DISTINCT x.a, y.b FROM {0} x JOIN {0} y ON x.b = y.a"


@query(
    f""", g AS (SELECT DISTINCT case_id, line_group, family FROM named_items), h AS (SELECT DISTINCT case_id, family FROM named_items),
    together AS (SELECT x.family AS a, y.family AS b, count(DISTINCT x.case_id) AS n FROM g x JOIN g y ON x.case_id = y.case_id AND x.line_group = y.line_group AND x.family < y.family GROUP BY 1, 2),
    shared AS (SELECT x.family AS a, y.family AS b, count(*) AS n FROM h x JOIN h y ON x.case_id = y.case_id AND x.family < y.family GROUP BY 1, 2),
    links AS (SELECT a, b FROM together t JOIN shared s USING (a, b) WHERE t.n >= 0.5 * s.n AND t.n >= 2), nodes AS (SELECT a FROM shared UNION SELECT b FROM shared),
    s0 AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT a, a FROM nodes), s1 AS ({_STEP.format('s0')}), s2 AS ({_STEP.format('s1')}), s3 AS ({_STEP.format('s2')})
    SELECT a AS node, min(b) AS component FROM s3 GROUP BY 1"""
)
def compound_partition(t: Tables) -> DataFrame:
    groups = t.named_items.select("case_id", "line_group", "family").distinct()
    one, other = groups.withColumnRenamed("family", "a"), groups.withColumnRenamed("family", "b")
    together = one.join(other, ["case_id", "line_group"]).filter("a < b").groupBy("a", "b").agg(F.count_distinct("case_id").alias("together"))
    held = t.named_items.select("case_id", "family").distinct()
    shared = held.withColumnRenamed("family", "a").join(held.withColumnRenamed("family", "b"), "case_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return compose.compound_partition(together.join(shared, ["a", "b"]), least=2)

"""Queries of corpus mining and rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.operators import consensus as C
from casework.operators import joins as J
from casework.operators import mining as M
from casework.operators.retrieve import best
from casework.plans.q_joins import SQL_CONSECUTIVE
from casework.plans.q_linkage import FOLD
from casework.plans.registry import query
from casework.sources.tables import Tables

P = "round(quantile_cont(CAST({0} AS DOUBLE), 0.05), 6) AS p05, round(quantile_cont(CAST({0} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({0} AS DOUBLE), 0.95), 6) AS p95"


@query(f"SELECT family, unit, count(quantity) AS n, {P.format('quantity')}, min(quantity) AS low, max(quantity) AS high FROM named_items GROUP BY 1, 2 HAVING count(quantity) >= 10")
def quantity_bands(t: Tables) -> DataFrame:
    return M.quantity_bands(t.named_items, ["family", "unit"])


@query(f"SELECT slot, count(*) AS n, {P.format('m')} FROM (SELECT case_id, slot, count(DISTINCT product_id) AS m FROM items GROUP BY 1, 2) GROUP BY 1")
def items_per_slot_bands(t: Tables) -> DataFrame:
    return M.two_level_bands(t.items, ["case_id", "slot"], ["slot"], F.count_distinct("product_id"))


@query(f"SELECT count(*) AS n, {P.format('m')} FROM (SELECT case_id, count(DISTINCT slot) AS m FROM items GROUP BY 1)")
def slots_per_case_bands(t: Tables) -> DataFrame:
    return M.two_level_bands(t.items, ["case_id"], [], F.count_distinct("slot"))


@query(f"""SELECT coalesce(objective, 'all') AS objective, slot, count(*) AS n, {P.format('m')}, round(avg(CAST(m > 0 AS DOUBLE)), 6) AS share FROM
    (SELECT case_id, objective, slot, count(*) - count(DISTINCT family) AS m FROM named_items JOIN cases USING (case_id) GROUP BY ALL) GROUP BY GROUPING SETS ((slot), (objective, slot))""")
def repeat_bands(t: Tables) -> DataFrame:
    rows = t.named_items.join(t.headers.select("case_id", "objective"), "case_id")
    per = rows.groupBy("case_id", "objective", "slot").agg((F.count("*") - F.count_distinct("family")).alias("m"))
    sets = per.groupingSets([[F.col("slot")], [F.col("objective"), F.col("slot")]], "objective", "slot")
    out = sets.agg(F.count("*").alias("n"), *M.percentiles("m"), F.round(F.avg((F.col("m") > 0).cast("double")), 6).alias("share"))
    return out.withColumn("objective", F.coalesce("objective", F.lit("all")))


@query("""SELECT objective, count(*) AS n_groups, round(avg(CAST(mixed AS DOUBLE)), 6) AS mixed_share FROM
    (SELECT case_id, line_group, count(DISTINCT family) > 1 AS mixed FROM named_items GROUP BY 1, 2 HAVING count(DISTINCT product_id) > 1) JOIN cases USING (case_id) GROUP BY 1""")
def mixed_group_share(t: Tables) -> DataFrame:
    groups = t.named_items.groupBy("case_id", "line_group").agg(F.count_distinct("family").alias("f"), F.count_distinct("product_id").alias("p")).filter("p > 1")
    rows = groups.join(t.headers.select("case_id", "objective"), "case_id")
    return rows.groupBy("objective").agg(F.count("*").alias("n_groups"), F.round(F.avg((F.col("f") > 1).cast("double")), 6).alias("mixed_share"))


@query("SELECT product_id, unit, count(*) AS n FROM items GROUP BY 1, 2")
def units_per_product(t: Tables) -> DataFrame:
    return t.items.groupBy("product_id", "unit").agg(F.count("*").alias("n"))


SQL_PREVALENCE = """, held AS (SELECT DISTINCT case_id, grp FROM named_items), totals AS (SELECT objective, count(*) AS "of" FROM cases GROUP BY 1),
    prevalence AS (SELECT objective, grp, count(*) AS n, any_value("of") AS "of", round(count(*) / any_value("of"), 6) AS share FROM held JOIN cases USING (case_id) JOIN totals USING (objective) GROUP BY 1, 2)
"""


@query(SQL_PREVALENCE + 'SELECT objective, grp, n, "of", share FROM prevalence')
def prevalence_by_objective(t: Tables) -> DataFrame:
    return M.prevalence(t.headers, t.named_items, "objective", "grp")


def _persistence_sql(key: str, source: str = "named_items") -> str:
    return SQL_CONSECUTIVE + f""", held AS (SELECT DISTINCT case_id, {key} FROM {source}),
    kept AS (SELECT {", ".join("a." + k for k in key.split(", "))}, count(*) AS n, count(b.case_id) AS n_kept FROM consecutive c JOIN held a ON a.case_id = c.case_id
             LEFT JOIN held b ON b.case_id = c.next_id AND {" AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))} GROUP BY ALL),
    expected AS (SELECT {key}, count(*) AS n_next FROM consecutive c JOIN held b ON b.case_id = c.next_id GROUP BY ALL),
    persistence AS (SELECT {key}, n, round(n_kept / n, 6) AS persistence, round(coalesce(n_next, 0) / (SELECT count(*) FROM consecutive), 6) AS expected,
           round((n_kept / n) / nullif(coalesce(n_next, 0) / (SELECT count(*) FROM consecutive), 0), 6) AS lift FROM kept LEFT JOIN expected USING ({key}))
"""


@query(_persistence_sql("grp") + "SELECT grp, n, persistence, expected, lift FROM persistence")
def persistence(t: Tables) -> DataFrame:
    return M.persistence(J.consecutive_versions(t.cases), t.named_items, "grp")


@query(_persistence_sql("family") + "SELECT family, n, persistence, expected, lift FROM persistence")
def family_persistence(t: Tables) -> DataFrame:
    return M.persistence(J.consecutive_versions(t.cases), t.named_items, "family")


@query(_persistence_sql("slot") + "SELECT slot, n, persistence, expected, lift FROM persistence")
def slot_persistence(t: Tables) -> DataFrame:
    return M.persistence(J.consecutive_versions(t.cases), t.items, "slot")


@query(_persistence_sql("grp, slot") + "SELECT grp, slot, n, persistence, expected, lift FROM persistence")
def slot_product_persistence(t: Tables) -> DataFrame:
    return M.persistence(J.consecutive_versions(t.cases), t.named_items, "grp", ["slot"])


@query(_persistence_sql("grp") + "SELECT grp, n, persistence, lift, n >= 10 AND (persistence >= 0.2 OR lift >= 1.05) AS anchor FROM persistence")
def anchor_products(t: Tables) -> DataFrame:
    table = persistence(t)
    anchor = (F.col("n") >= 10) & ((F.col("persistence") >= 0.2) | (F.col("lift") >= 1.05))
    return table.select("grp", "n", "persistence", "lift", anchor.alias("anchor"))


def _overlap_sql(key: str = "grp") -> str:
    return SQL_CONSECUTIVE + f""", sets AS (SELECT DISTINCT case_id, {key} FROM named_items), sizes AS (SELECT case_id, count(*) AS size FROM sets GROUP BY 1),
    common AS (SELECT c.case_id, c.next_id, count(*) AS common FROM consecutive c JOIN sets a ON a.case_id = c.case_id JOIN sets b ON b.case_id = c.next_id AND a.{key} = b.{key} GROUP BY 1, 2),
    overlap AS (SELECT c.case_id, c.next_id, c.objective, c.next_objective, coalesce(common, 0) AS common, coalesce(x.size, 0) AS size_a, coalesce(y.size, 0) AS size_b,
            CASE WHEN coalesce(x.size, 0) + coalesce(y.size, 0) - coalesce(common, 0) = 0 THEN 0 ELSE round(coalesce(common, 0) / (coalesce(x.size, 0) + coalesce(y.size, 0) - coalesce(common, 0)), 6) END AS jaccard
        FROM consecutive c LEFT JOIN common m ON m.case_id = c.case_id AND m.next_id = c.next_id LEFT JOIN sizes x ON x.case_id = c.case_id LEFT JOIN sizes y ON y.case_id = c.next_id)
"""


def _overlap(t: Tables, key: str = "grp") -> DataFrame:
    pairs = J.consecutive_versions(t.cases).select("case_id", "next_id", "objective", "next_objective")
    return M.pair_overlap(pairs, t.named_items, key)


@query(_overlap_sql() + f"""SELECT objective = next_objective AS same, count(*) AS n, round(avg(size_a - common), 6) AS dropped, round(avg(size_b - common), 6) AS added, {P.format('jaccard')}
    FROM overlap WHERE size_a > 0 AND size_b > 0 GROUP BY 1""")
def renewal_summary(t: Tables) -> DataFrame:
    rows = _overlap(t).filter("size_a > 0 AND size_b > 0")
    a, b = F.col("size_a") - F.col("common"), F.col("size_b") - F.col("common")
    return rows.groupBy((F.col("objective") == F.col("next_objective")).alias("same")).agg(
        F.count("*").alias("n"), F.round(F.avg(a), 6).alias("dropped"), F.round(F.avg(b), 6).alias("added"), *M.percentiles("jaccard")
    )


@query(_overlap_sql() + "SELECT case_id, next_id, common, size_a, size_b, jaccard FROM overlap")
def set_jaccard(t: Tables) -> DataFrame:
    return _overlap(t).select("case_id", "next_id", "common", "size_a", "size_b", "jaccard")


@query(_overlap_sql() + "SELECT case_id, next_id, round(1 - jaccard, 6) AS novelty, 1 - jaccard BETWEEN 0.15 AND 0.95 AS in_band FROM overlap")
def novelty(t: Tables) -> DataFrame:
    fresh = 1 - F.col("jaccard")
    return _overlap(t).select("case_id", "next_id", F.round(fresh, 6).alias("novelty"), fresh.between(0.15, 0.95).alias("in_band"))


@query(_overlap_sql() + """SELECT case_id, next_id, CASE WHEN size_b = 0 THEN NULL ELSE round(common / size_b, 6) END AS "precision", CASE WHEN size_a = 0 THEN NULL ELSE round(common / size_a, 6) END AS recall,
    CASE WHEN size_a = 0 THEN NULL ELSE round(size_b / size_a, 6) END AS size_ratio FROM overlap""")
def precision_recall_size(t: Tables) -> DataFrame:
    a, b, c = (F.col(x).cast("double") for x in ("size_a", "size_b", "common"))
    zero = F.lit(0.0)
    return _overlap(t).select(
        "case_id", "next_id", F.round(c / F.nullif(b, zero), 6).alias("precision"), F.round(c / F.nullif(a, zero), 6).alias("recall"), F.round(b / F.nullif(a, zero), 6).alias("size_ratio")
    )


@query(_overlap_sql() + f"""SELECT coalesce(objective, 'all') AS objective, count(*) AS n, round(avg(jaccard), 6) AS mean, count(*) >= 30 AS conclusive FROM overlap GROUP BY GROUPING SETS ((objective), ())""")
def stratified_means(t: Tables) -> DataFrame:
    out = _overlap(t).groupingSets([[F.col("objective")], []], "objective").agg(F.count("*").alias("n"), F.round(F.avg("jaccard"), 6).alias("mean"))
    return out.select(F.coalesce("objective", F.lit("all")).alias("objective"), "n", "mean", (F.col("n") >= 30).alias("conclusive"))


@query(_overlap_sql() + """, per AS (SELECT objective, sum(jaccard) AS s, max(jaccard) AS m, count(*) AS n FROM overlap GROUP BY 1)
    SELECT objective, round(s / n, 6) AS ceiling, round((s - m) / nullif(n - 1, 0), 6) AS ceiling_without_best FROM per""")
def floor_ceiling(t: Tables) -> DataFrame:
    """The ceiling of an objective: the next version of the same entity, with and without the best pair."""
    per = _overlap(t).groupBy("objective").agg(F.sum("jaccard").alias("s"), F.max("jaccard").alias("m"), F.count("*").alias("n"))
    return per.select("objective", F.round(F.col("s") / F.col("n"), 6).alias("ceiling"), F.round((F.col("s") - F.col("m")) / F.nullif(F.col("n") - 1, F.lit(0)), 6).alias("ceiling_without_best"))


@query("""SELECT a.family AS a, b.family AS b, count(*) AS n FROM (SELECT DISTINCT case_id, line_group, family FROM named_items) a JOIN (SELECT DISTINCT case_id, line_group, family FROM named_items) b
    ON a.case_id = b.case_id AND a.line_group = b.line_group AND a.family < b.family GROUP BY 1, 2 HAVING count(*) >= 2""")
def interchangeable_pairs(t: Tables) -> DataFrame:
    return M.interchangeable_pairs(t.named_items, "family", ["case_id", "line_group"])


@query("""SELECT a.family AS a, b.family AS b, count(DISTINCT a.case_id) AS n_cases FROM (SELECT DISTINCT case_id, slot, line_group, family FROM named_items) a
    JOIN (SELECT DISTINCT case_id, slot, line_group, family FROM named_items) b USING (case_id, slot, line_group) WHERE a.family <> b.family GROUP BY 1, 2""")
def alternative_cooccurrence(t: Tables) -> DataFrame:
    return C.alternative_pairs(t.named_items, "family", ["case_id", "slot", "line_group"])


@query("""SELECT family, slot, unit, n, quantity FROM (SELECT family, slot, unit, count(*) AS n, median(quantity) AS quantity FROM named_items GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY family, slot ORDER BY n DESC, unit) = 1""")
def modal_unit_median(t: Tables) -> DataFrame:
    return C.modal_unit_median(t.named_items, ["family", "slot"])


@query("""SELECT case_id, line, CASE WHEN (unit = 'u1' AND quantity > 30) OR (unit = 'u2' AND quantity > 40) THEN 'u0' ELSE unit END AS unit,
    CASE WHEN ((unit = 'u1' AND quantity > 30) OR (unit = 'u2' AND quantity > 40)) AND quantity > 48 THEN NULL ELSE quantity END AS quantity FROM items""")
def impossible_quantity_repair(t: Tables) -> DataFrame:
    ceilings = t.spark.createDataFrame([("u0", 48.0), ("u1", 30.0), ("u2", 40.0)], "unit string, ceiling double")
    rows = t.items.select("case_id", "line", "unit", "quantity")
    u0 = C.impossible_quantity_repair(rows.filter("unit <> 'u0'"), ceilings, "u0")
    return u0.unionByName(rows.filter("unit = 'u0'"))


@query("SELECT case_id, line, CASE WHEN quantity > 5 THEN round_even(quantity / 5, 0) * 5 ELSE quantity END AS quantity FROM items")
def grid_round(t: Tables) -> DataFrame:
    from casework.functions.columns import grid_round as grid

    return t.items.select("case_id", "line", grid(F.col("quantity")).alias("quantity"))


RULES = """SELECT 'urgent_high' AS rule, count(*) FILTER (WHERE objective = '1-URGENT') AS n_group, count(*) FILTER (WHERE objective = '1-URGENT' AND total > 250000) AS n_support,
        round(count(*) FILTER (WHERE objective = '1-URGENT' AND total > 250000) / nullif(count(*) FILTER (WHERE objective = '1-URGENT'), 0), 6) AS prevalence FROM cases
    UNION ALL SELECT 'any_high', count(*), count(*) FILTER (WHERE total > 250000), round(count(*) FILTER (WHERE total > 250000) / nullif(count(*), 0), 6) FROM cases"""


def _rules() -> dict:
    return {"urgent_high": (F.col("objective") == "1-URGENT", F.col("total") > 250000), "any_high": (F.lit(True), F.col("total") > 250000)}


@query(RULES)
def rule_prevalence(t: Tables) -> DataFrame:
    return M.rule_prevalence(t.headers, _rules())


@query(f"SELECT round(max(CASE WHEN rule = 'urgent_high' THEN n_support / n_group END) / nullif(max(CASE WHEN rule = 'any_high' THEN n_support / n_group END), 0), 6) AS lift FROM ({RULES})")
def conditional_lift(t: Tables) -> DataFrame:
    rows = M.rule_prevalence(t.headers, _rules()).withColumn("p", F.col("n_support") / F.col("n_group"))
    part = {r: F.max(F.when(F.col("rule") == r, F.col("p"))) for r in ("urgent_high", "any_high")}
    return rows.agg(F.round(part["urgent_high"] / F.nullif(part["any_high"], F.lit(0.0)), 6).alias("lift"))


@query("""SELECT round(sum(a * n_out / n), 6) AS top, round(sum(b * n_in / n), 6) AS bottom, round(sum(a * n_out / n) / nullif(sum(b * n_in / n), 0), 6) AS ratio FROM (
    SELECT segment, count(*) FILTER (WHERE objective = '1-URGENT') AS n_in, count(*) FILTER (WHERE objective <> '1-URGENT') AS n_out,
        count(*) FILTER (WHERE objective = '1-URGENT' AND total > 250000) AS a, count(*) FILTER (WHERE objective <> '1-URGENT' AND total > 250000) AS b, count(*) AS n
    FROM cases JOIN profiles USING (entity_id) GROUP BY 1)""")
def mantel_haenszel(t: Tables) -> DataFrame:
    rows = t.headers.join(t.profiles.select("entity_id", "segment"), "entity_id")
    return M.mantel_haenszel(rows, "segment", F.col("objective") == "1-URGENT", F.col("total") > 250000)


@query("""SELECT round(avg(CAST(total > 250000 AS DOUBLE)) FILTER (WHERE objective = '1-URGENT') / nullif(avg(CAST(total > 250000 AS DOUBLE)), 0), 6) AS lift, count(*) AS n
    FROM (SELECT *, count(*) OVER (PARTITION BY entity_id) AS k FROM cases) WHERE k >= 5""")
def tenured_adjustment(t: Tables) -> DataFrame:
    rows = t.headers.withColumn("k", F.count("*").over(Window.partitionBy("entity_id"))).filter("k >= 5")
    hit = (F.col("total") > 250000).cast("double")
    return rows.agg(F.round(F.avg(F.when(F.col("objective") == "1-URGENT", hit)) / F.nullif(F.avg(hit), F.lit(0.0)), 6).alias("lift"), F.count("*").alias("n"))


@query("""SELECT objective, n, round(p, 6) AS p, round(p / base, 6) AS lift, CASE WHEN n < 30 THEN 'low' WHEN abs(p / base - 1) < 0.02 THEN 'low' WHEN abs(p / base - 1) < 0.05 THEN 'medium' ELSE 'high' END AS confidence,
        CASE WHEN n < 30 THEN 'few cases' WHEN abs(p / base - 1) < 0.02 THEN 'no effect' WHEN abs(p / base - 1) < 0.05 THEN 'weak band' ELSE '' END AS reasons, p > 0.5 AS prescriptive
    FROM (SELECT objective, count(*) AS n, avg(CAST(total > 250000 AS DOUBLE)) AS p FROM cases GROUP BY 1), (SELECT avg(CAST(total > 250000 AS DOUBLE)) AS base FROM cases)""")
def rule_confidence(t: Tables) -> DataFrame:
    hit = (F.col("total") > 250000).cast("double")
    per = t.headers.groupBy("objective").agg(F.count("*").alias("n"), F.avg(hit).alias("p"))
    rows = per.crossJoin(F.broadcast(t.headers.agg(F.avg(hit).alias("base"))))
    effect = F.abs(F.col("p") / F.col("base") - 1)
    level = F.when((F.col("n") < 30) | (effect < 0.02), "low").when(effect < 0.05, "medium").otherwise("high")
    reason = F.when(F.col("n") < 30, "few cases").when(effect < 0.02, "no effect").when(effect < 0.05, "weak band").otherwise("")
    return rows.select(
        "objective", "n", F.round("p", 6).alias("p"), F.round(F.col("p") / F.col("base"), 6).alias("lift"), level.alias("confidence"), reason.alias("reasons"), (F.col("p") > 0.5).alias("prescriptive")
    )


@query("""SELECT dimension, level, n, hits, round(hits / n, 6) AS pct, round((hits / n) / nullif(sum(hits) OVER w / sum(n) OVER w, 0), 6) AS lift FROM (
        SELECT 'objective' AS dimension, objective AS level, count(*) AS n, count(*) FILTER (WHERE total > 250000) AS hits FROM cases JOIN profiles USING (entity_id) GROUP BY 2
        UNION ALL SELECT 'segment', segment, count(*), count(*) FILTER (WHERE total > 250000) FROM cases JOIN profiles USING (entity_id) GROUP BY 2
        UNION ALL SELECT 'region', CAST(region AS VARCHAR), count(*), count(*) FILTER (WHERE total > 250000) FROM cases JOIN profiles USING (entity_id) GROUP BY 2) WINDOW w AS (PARTITION BY dimension)""")
def lift_by_dimension(t: Tables) -> DataFrame:
    rows = t.headers.join(t.profiles, "entity_id").select("objective", "segment", "region", "total")
    return M.lift_by_dimension(rows, ["objective", "segment", "region"], F.col("total") > 250000)


@query("SELECT case_id, CASE WHEN version = 1 THEN 'v1' WHEN version <= 4 THEN 'v2-4' ELSE 'v5+' END AS phase FROM cases")
def phase_bucket(t: Tables) -> DataFrame:
    from casework.functions.columns import bucket_of

    return t.cases.select("case_id", bucket_of(F.col("version"), [(2, "v1"), (5, "v2-4")], "v5+").alias("phase"))


@query("""SELECT segment, nation, objective, count(*) AS n_cases, count(DISTINCT entity_id) AS n_entities, md5(string_agg(DISTINCT CAST(entity_id AS VARCHAR), ',' ORDER BY CAST(entity_id AS VARCHAR))) AS entities_md5
    FROM cases JOIN profiles USING (entity_id) GROUP BY 1, 2, 3""")
def archetypes(t: Tables) -> DataFrame:
    return M.archetypes(t.headers.join(t.profiles, "entity_id"), ["segment", "nation", "objective"])


@query("""SELECT product_id, slot AS modal, n, round(c / n, 6) AS concentration, distribution FROM (SELECT *, sum(c) OVER w AS n, row_number() OVER (PARTITION BY product_id ORDER BY c DESC, slot) AS r,
        array_to_string(list_sort(list(slot || '=' || CAST(c AS VARCHAR)) OVER w), ',') AS distribution FROM (SELECT product_id, slot, count(*) AS c FROM items GROUP BY 1, 2) WINDOW w AS (PARTITION BY product_id))
    WHERE r = 1 AND n >= 10""")
def modal_slot(t: Tables) -> DataFrame:
    return M.modal_value(t.items, "product_id", "slot")


@query(f"SELECT grp, count(*) AS n, {P.format('m')} FROM (SELECT case_id, grp, sum(quantity) AS m FROM named_items GROUP BY 1, 2) GROUP BY 1")
def group_daily_totals(t: Tables) -> DataFrame:
    return M.two_level_bands(t.named_items, ["case_id", "grp"], ["grp"], F.sum("quantity"))


SQL_MEDIANS = ", medians AS (SELECT slot, family, median(quantity) AS m FROM named_items GROUP BY 1, 2)"


@query(SQL_MEDIANS + f"SELECT a.family AS a, b.family AS b, count(*) AS n, {P.format('a.m / b.m')} FROM medians a JOIN medians b ON a.slot = b.slot AND a.family <> b.family GROUP BY 1, 2")
def ration_ratio_bands(t: Tables) -> DataFrame:
    m = t.named_items.groupBy("slot", "family").agg(F.median("quantity").alias("m"))
    a, b = m.select("slot", F.col("family").alias("a"), F.col("m").alias("ma")), m.select("slot", F.col("family").alias("b"), F.col("m").alias("mb"))
    rows = a.join(b, "slot").filter("a <> b").withColumn("ratio", F.col("ma") / F.col("mb"))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), *M.percentiles("ratio"))


@query(f"""SELECT count(*) AS n, {P.format('ratio')} FROM (SELECT greatest(a.m, b.m) / least(a.m, b.m) AS ratio FROM (SELECT case_id, line_group, family, median(quantity) AS m FROM named_items GROUP BY 1, 2, 3) a
    JOIN (SELECT case_id, line_group, family, median(quantity) AS m FROM named_items GROUP BY 1, 2, 3) b USING (case_id, line_group) WHERE a.family < b.family)""")
def scale_tolerance(t: Tables) -> DataFrame:
    m = t.named_items.groupBy("case_id", "line_group", "family").agg(F.median("quantity").alias("m"))
    other = m.select("case_id", "line_group", F.col("family").alias("f"), F.col("m").alias("o"))
    rows = m.join(other, ["case_id", "line_group"]).filter("family < f").withColumn("ratio", F.greatest("m", "o") / F.least("m", "o"))
    return rows.agg(F.count("*").alias("n"), *M.percentiles("ratio"))


@query("""SELECT product_id, coalesce(CASE WHEN name LIKE 'red %' THEN 'override' END, CASE WHEN scale > 45 THEN 'oversize' END, CASE WHEN family = 'ECONOMY' THEN 'cheap' END, 'default') AS class,
        CASE WHEN name LIKE 'red %' THEN 'override' WHEN scale > 45 THEN 'rule' WHEN family = 'ECONOMY' THEN 'family' ELSE 'default' END AS source FROM catalogue""")
def attribute_enrichment(t: Tables) -> DataFrame:
    steps = [("override", F.col("name").like("red %"), "override"), ("rule", F.col("scale") > 45, "oversize"), ("family", F.col("family") == "ECONOMY", "cheap")]
    value = F.coalesce(*[F.when(test, F.lit(v)) for _, test, v in steps], F.lit("default"))
    source = F.coalesce(*[F.when(test, F.lit(s)) for s, test, _ in steps], F.lit("default"))
    return t.catalogue.select("product_id", value.alias("class"), source.alias("source"))


@query("""SELECT family, count(DISTINCT entity_id) AS n_all, count(DISTINCT CASE WHEN segment = 'BUILDING' THEN entity_id END) AS n_flagged,
        round((count(DISTINCT CASE WHEN segment = 'BUILDING' THEN entity_id END) / (SELECT count(*) FROM profiles WHERE segment = 'BUILDING')) / (count(DISTINCT entity_id) / (SELECT count(*) FROM profiles)), 6) AS ratio
    FROM named_items JOIN cases USING (case_id) JOIN profiles USING (entity_id) GROUP BY 1""")
def subgroup_exposure(t: Tables) -> DataFrame:
    rows = t.named_items.join(t.headers.select("case_id", "entity_id"), "case_id").select("family", "entity_id").distinct().join(t.profiles.select("entity_id", "segment"), "entity_id")
    flagged = F.col("segment") == "BUILDING"
    totals = t.profiles.agg(F.count("*").alias("total"), F.count_if(flagged).alias("total_flagged"))
    per = rows.groupBy("family").agg(F.count("*").alias("n_all"), F.count_if(flagged).alias("n_flagged")).crossJoin(F.broadcast(totals))
    ratio = (F.col("n_flagged") / F.col("total_flagged")) / (F.col("n_all") / F.col("total"))
    return per.select("family", "n_all", "n_flagged", F.round(ratio, 6).alias("ratio"))


@query("""SELECT field, count(v) AS n, round(count(v) / count(*), 6) AS pct, count(v) * (count(v) - 1) AS pairs FROM (
        SELECT 'segment' AS field, CASE WHEN segment <> 'BUILDING' THEN segment END AS v FROM profiles UNION ALL SELECT 'nation', nation FROM profiles UNION ALL SELECT 'balance', CASE WHEN balance >= 0 THEN CAST(balance AS VARCHAR) END FROM profiles) GROUP BY 1""")
def coverage_report(t: Tables) -> DataFrame:
    fields = {"segment": F.when(F.col("segment") != "BUILDING", F.col("segment")), "nation": F.col("nation"), "balance": F.when(F.col("balance") >= 0, F.col("balance"))}
    counts = t.profiles.agg(F.count("*").alias("total"), *[F.count(c).alias(n) for n, c in fields.items()])
    long = counts.selectExpr("total", f"stack({len(fields)}, " + ", ".join(f"'{n}', {n}" for n in fields) + ") AS (field, n)")
    return long.select("field", "n", F.round(F.col("n") / F.col("total"), 6).alias("pct"), (F.col("n") * (F.col("n") - 1)).alias("pairs"))


@query("""SELECT entity_id, count(*) AS n, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS span, count(*) >= 2 AND date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) >= 21 AS trajectory,
        arg_max(value, (ts, event_id)) AS latest, round(avg(CAST(value IS NOT NULL AS DOUBLE)), 6) AS coverage FROM series GROUP BY 1""")
def series_profile(t: Tables) -> DataFrame:
    span = F.datediff(F.max("ts"), F.min("ts")).cast("long")
    out = t.series.groupBy("entity_id").agg(
        F.count("*").alias("n"), span.alias("span"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.round(F.avg(F.col("value").isNotNull().cast("double")), 6).alias("coverage")
    )
    return out.withColumn("trajectory", (F.col("n") >= 2) & (F.col("span") >= 21))


# Rotation.
@query("SELECT entity_id, arg_max(case_id, (version, case_id)) AS case_id, max(version) AS version FROM cases GROUP BY 1")
def latest_version(t: Tables) -> DataFrame:
    return t.cases.groupBy("entity_id").agg(F.max_by("case_id", F.struct("version", "case_id")).alias("case_id"), F.max("version").alias("version"))


@query("SELECT c.case_id, CASE WHEN p.case_id IS NULL THEN 'cold' WHEN p.objective = c.objective THEN 'rotate' ELSE 'consensus' END AS route FROM cases c LEFT JOIN cases p ON p.entity_id = c.entity_id AND p.version = c.version - 1")
def strategy_routing(t: Tables) -> DataFrame:
    before = F.lag("objective").over(Window.partitionBy("entity_id").orderBy("version"))
    route = F.when(F.col("version") == 1, "cold").when(before == F.col("objective"), "rotate").otherwise("consensus")
    return t.cases.select("case_id", route.alias("route"))


#: What no substitute is, whatever stands in the plan, and the words that say nothing of what a product is.
PREPARATIONS, EMPTY_WORDS = ("old plate",), ("de", "del", "la", "el", "los", "las", "al", "con", "sin", "en", "y", "o", "a", "para")
SINGULAR = "CASE WHEN {0} LIKE '%es' AND length({0}) > 4 THEN left({0}, length({0}) - 2) WHEN {0} LIKE '%s' AND length({0}) > 3 THEN left({0}, length({0}) - 1) ELSE {0} END"


@query(f""", folded AS (SELECT product_id, family, grp, {FOLD.format('name')} AS name, replace({FOLD.format('name')}, ' ', '_') AS joined, {FOLD.format('family')} AS kin FROM catalogue),
    words AS (SELECT product_id, family, grp, name IN {str(PREPARATIONS).replace(',)', ')')} AS preparation, kin <> '' AND {SINGULAR.format('joined')} = {SINGULAR.format('kin')} AS generic,
        list_filter(list_distinct(regexp_split_to_array(name, '[\\s/(),.-]+')), lambda x: x NOT IN {('', *EMPTY_WORDS)}) AS w FROM folded),
    medians AS (SELECT product_id, unit, median(quantity) AS m FROM items GROUP BY 1, 2 HAVING median(quantity) > 0),
    scales AS (SELECT a.product_id AS a, b.product_id AS b, bool_or(greatest(x.m, y.m) <= 3 * least(x.m, y.m)) AS near FROM words a JOIN words b ON a.grp IS NOT DISTINCT FROM b.grp AND a.family IS NOT DISTINCT FROM b.family
        JOIN medians x ON x.product_id = a.product_id JOIN medians y ON y.product_id = b.product_id AND y.unit = x.unit GROUP BY 1, 2),
    grouped AS (SELECT DISTINCT case_id, line_group, product_id FROM items),
    written AS (SELECT a.product_id AS a, b.product_id AS b FROM grouped a JOIN grouped b ON a.case_id = b.case_id AND a.line_group = b.line_group AND a.product_id <> b.product_id GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN a.product_id = b.product_id THEN 'same' WHEN b.preparation THEN 'preparation' WHEN a.grp IS DISTINCT FROM b.grp THEN 'group' WHEN a.family IS DISTINCT FROM b.family THEN 'family'
            WHEN b.generic AND NOT a.generic THEN 'generic' WHEN len(a.w) > 0 AND len(b.w) > 0 AND (list_has_all(a.w, b.w) OR list_has_all(b.w, a.w)) THEN 'shared head' WHEN NOT coalesce(s.near, true) THEN 'scale'
            WHEN r.a IS NULL AND EXISTS (SELECT 1 FROM written) THEN 'never written' ELSE 'allowed' END AS reason
        FROM words a CROSS JOIN words b LEFT JOIN scales s ON s.a = a.product_id AND s.b = b.product_id LEFT JOIN written r ON r.a = a.product_id AND r.b = b.product_id) GROUP BY 1""")
def may_substitute(t: Tables) -> DataFrame:
    """By the first of eight refusals the ordered pairs of products of which one might take the other's place, and those that nothing speaks against."""
    medians = t.items.groupBy("product_id", "unit").agg(F.median("quantity").alias("median"))
    written = M.interchangeable_pairs(t.items, "product_id", ["case_id", "line_group"])
    return M.refusals(t.catalogue, medians, written, preparations=PREPARATIONS, empty_words=EMPTY_WORDS)


def substitutes(catalogue: DataFrame) -> DataFrame:
    """(reason, n) of all ordered pairs of products of a family and group. What decides is the same for all products of one
    scale and head, so these kinds are paired with their counts; pairs of a product with itself are taken off again."""
    of, kind = ["family", "grp"], ["scale", "head"]
    words = catalogue.filter("product_id IS NOT NULL").select("product_id", *of, "scale", F.split_part("name", F.lit(" "), F.lit(2)).alias("head"))

    def paired(rows: DataFrame, on: list[str]) -> DataFrame:
        other = rows.select(*on, *[F.col(c).alias("o_" + c) for c in (*kind, "n")])
        return rows.join(other, on).withColumn("n", F.col("n") * F.col("o_n"))

    each = words.groupBy("product_id", *of, *kind).agg(F.count("*").alias("n"))
    all_pairs = paired(each.groupBy(*of, *kind).agg(F.sum("n").alias("n")), of).select(*kind, "o_scale", "o_head", "n")
    itself = paired(each, ["product_id", *of]).select(*kind, "o_scale", "o_head", (-F.col("n")).alias("n"))
    apart = F.greatest("scale", "o_scale") > 3 * F.least("scale", "o_scale")
    reason = F.when(F.col("head") == F.col("o_head"), "shared head").when(apart, "scale").otherwise("allowed")
    return all_pairs.unionByName(itself).groupBy(reason.alias("reason")).agg(F.sum("n").alias("n")).filter("n > 0")


@query(""", held AS (SELECT DISTINCT case_id, family, grp FROM named_items) SELECT objective, family, grp, count(*) AS n, row_number() OVER (PARTITION BY objective, family ORDER BY count(*) DESC, grp) AS place FROM held JOIN cases USING (case_id) GROUP BY 1, 2, 3""")
def repertoire(t: Tables) -> DataFrame:
    held = t.named_items.select("case_id", "family", "grp").distinct().join(t.headers.select("case_id", "objective"), "case_id")
    counts = held.groupBy("objective", "family", "grp").agg(F.count("*").alias("n"))
    return best(counts, ["objective", "family"], [F.desc("n"), F.asc("grp")], 1 << 30, "place")


@query("SELECT case_id, CASE WHEN version = 1 THEN 0.424 WHEN version <= 4 THEN 0.272 ELSE 0.15 END AS target FROM cases")
def renewal_target(t: Tables) -> DataFrame:
    return t.cases.select("case_id", F.when(F.col("version") == 1, 0.424).when(F.col("version") <= 4, 0.272).otherwise(0.15).alias("target"))


@query(SQL_CONSECUTIVE + """, sums AS (SELECT case_id, slot, grp, sum(quantity) AS q, min(unit) AS u FROM named_items GROUP BY 1, 2, 3),
    d AS (SELECT coalesce(a.cid, b.cid) AS case_id, CASE WHEN b.grp IS NULL THEN 'removed' WHEN a.grp IS NULL THEN 'added' WHEN a.u <> b.u THEN 'unit' WHEN a.q <> b.q THEN 'quantity' ELSE 'kept' END AS kind
          FROM (SELECT c.case_id AS cid, slot, grp, q, u FROM consecutive c JOIN sums s ON s.case_id = c.case_id) a
          FULL JOIN (SELECT c.case_id AS cid, slot, grp, q, u FROM consecutive c JOIN sums s ON s.case_id = c.next_id) b ON a.cid = b.cid AND a.slot = b.slot AND a.grp = b.grp)
    SELECT case_id, count(*) FILTER (WHERE kind = 'removed') AS removed, count(*) FILTER (WHERE kind = 'added') AS added, count(*) FILTER (WHERE kind = 'unit') AS unit, count(*) FILTER (WHERE kind = 'quantity') AS quantity,
           count(*) FILTER (WHERE kind = 'kept') AS kept, round(count(*) FILTER (WHERE kind <> 'kept') / count(*), 6) AS edit_ratio FROM d GROUP BY 1""")
def proposal_diff(t: Tables) -> DataFrame:
    pairs = J.consecutive_versions(t.cases).select("case_id", "next_id")
    sums = t.named_items.groupBy("case_id", "slot", "grp").agg(F.sum("quantity").alias("q"), F.min("unit").alias("u"))
    key = ["case_id", "slot", "grp"]
    old = pairs.select("case_id").join(sums, "case_id").select(*key, F.col("q").alias("old_q"), F.col("u").alias("old_u"))
    new = pairs.join(sums.withColumnRenamed("case_id", "next_id"), "next_id").select(*key, F.col("q").alias("new_q"), F.col("u").alias("new_u"))
    kind = F.when(F.col("new_u").isNull(), "removed").when(F.col("old_u").isNull(), "added").when(F.col("old_u") != F.col("new_u"), "unit").when(F.col("old_q") != F.col("new_q"), "quantity").otherwise("kept")
    rows = old.join(new, key, "full_outer").select("case_id", kind.alias("kind"))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("removed", "added", "unit", "quantity", "kept")]
    return rows.groupBy("case_id").agg(*counts, F.round(F.count_if(F.col("kind") != "kept") / F.count("*"), 6).alias("edit_ratio"))


@query(_persistence_sql("grp") + """, own AS (SELECT c.entity_id, a.grp, count(*) AS n, count(b.case_id) AS n_kept FROM consecutive c JOIN held a ON a.case_id = c.case_id LEFT JOIN held b ON b.case_id = c.next_id AND a.grp = b.grp GROUP BY 1, 2)
    SELECT o.entity_id, o.grp, k.n - o.n AS n, round((k.n_kept - o.n_kept) / nullif(k.n - o.n, 0), 6) AS persistence FROM own o JOIN kept k USING (grp)""")
def leave_one_entity_out_stats(t: Tables) -> DataFrame:
    held = t.named_items.select("case_id", "grp").distinct()
    pairs = J.consecutive_versions(t.cases).select("entity_id", "case_id", "next_id")
    following = held.select(F.col("case_id").alias("next_id"), "grp", F.lit(1).alias("again"))
    own = pairs.join(held, "case_id").join(following, ["next_id", "grp"], "left").groupBy("entity_id", "grp").agg(F.count("*").alias("own_n"), F.count("again").alias("own_kept"))
    total = own.groupBy("grp").agg(F.sum("own_n").alias("all_n"), F.sum("own_kept").alias("all_kept"))
    n = F.col("all_n") - F.col("own_n")
    return own.join(total, "grp").select("entity_id", "grp", n.alias("n"), F.round((F.col("all_kept") - F.col("own_kept")) / F.nullif(n, F.lit(0)), 6).alias("persistence"))

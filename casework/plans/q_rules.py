"""Queries of validation: restrictions, rules, plausibility and conformance over real cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.operators import mining as M
from casework.operators import rules as R
from casework.operators.retrieve import best
from casework.plans.registry import query
from casework.sources.tables import Tables

SQL_DECLARED = """, declared AS (SELECT entity_id, 'bulky' AS flag FROM profiles WHERE segment = 'BUILDING' UNION ALL SELECT entity_id, 'costly' FROM profiles WHERE balance < 0),
    carried AS (SELECT product_id, 'bulky' AS flag FROM catalogue WHERE bulky UNION ALL SELECT product_id, 'costly' FROM catalogue WHERE costly)
"""


def _declared(t: Tables) -> DataFrame:
    one = t.profiles.filter("segment = 'BUILDING'").select("entity_id", F.lit("bulky").alias("flag"))
    return one.unionByName(t.profiles.filter("balance < 0").select("entity_id", F.lit("costly").alias("flag")))


def _owned(t: Tables) -> DataFrame:
    return t.items.join(t.headers.select("case_id", "entity_id", "objective"), "case_id")


@query(SQL_DECLARED + "SELECT case_id, line, product_id, flag, 'veto' AS outcome FROM items JOIN cases USING (case_id) JOIN carried USING (product_id) JOIN declared USING (entity_id, flag)")
def restriction_veto(t: Tables) -> DataFrame:
    return R.restriction_veto(_owned(t), t.catalogue, _declared(t), ["bulky", "costly"])


SQL_DISLIKED = """, counts AS (SELECT entity_id, family, count(*) AS n FROM named_items JOIN cases USING (case_id) GROUP BY 1, 2),
    disliked AS (SELECT entity_id, family FROM counts QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n, family) = 1)
"""


def _disliked(t: Tables) -> DataFrame:
    counts = t.named_items.join(t.headers.select("case_id", "entity_id"), "case_id").groupBy("entity_id", "family").agg(F.count("*").alias("n"))
    return best(counts, ["entity_id"], [F.asc("n"), F.asc("family")], 1).select("entity_id", "family")


@query(SQL_DISLIKED + "SELECT case_id, line, family, CASE WHEN d.family IS NOT NULL THEN 'disliked' ELSE 'kept' END AS outcome FROM named_items JOIN cases USING (case_id) LEFT JOIN disliked d USING (entity_id, family)")
def dislike_filter(t: Tables) -> DataFrame:
    rows = t.named_items.join(t.headers.select("case_id", "entity_id"), "case_id")
    marked = rows.join(_disliked(t).withColumn("d", F.lit(True)), ["entity_id", "family"], "left")
    return marked.select("case_id", "line", "family", F.when(F.col("d"), "disliked").otherwise("kept").alias("outcome"))


FORBID = "CASE WHEN slot = 'RF' AND family = 'PROMO' THEN 'no promo in RF' WHEN quantity > 48 THEN 'too much' END"


@query(f"SELECT case_id, line, {FORBID} AS reason FROM named_items WHERE {FORBID} IS NOT NULL")
def forbid_filter(t: Tables) -> DataFrame:
    reason = R.forbidden(t.named_items, {"no promo in RF": ("RF", F.col("family") == "PROMO"), "too much": (None, F.col("quantity") > 48)})
    return t.named_items.select("case_id", "line", reason.alias("reason")).filter("reason IS NOT NULL")


@query("""SELECT case_id, rule FROM cases JOIN profiles USING (entity_id), (VALUES ('all', NULL, NULL), ('urgent', '1-URGENT', NULL), ('first', NULL, 1), ('urgent first', '1-URGENT', 1)) r(rule, goal, phase)
    WHERE (goal IS NULL OR goal = objective) AND (phase IS NULL OR phase = version)""")
def rule_applicability(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("all", None, None), ("urgent", "1-URGENT", None), ("first", None, 1), ("urgent first", "1-URGENT", 1)], "rule string, goal string, phase int")
    on = (F.col("goal").isNull() | (F.col("goal") == F.col("objective"))) & (F.col("phase").isNull() | (F.col("phase") == F.col("version")))
    return t.cases.join(F.broadcast(rules), on).select("case_id", "rule")


SQL_RULES = """, facts AS (SELECT case_id, bool_or(slot = 'AF') AS af, bool_or(slot = 'AF' AND family = 'PROMO') AS af_promo, bool_or(family = 'STANDARD') AS std, bool_or(slot = 'NO') AS no_, bool_or(slot IN ('NO', 'RF')) AS any_slot,
        bool_or(quantity > 40) AS much FROM named_items GROUP BY 1),
    evaluated AS (SELECT case_id, 'no_promo_in_af' AS rule, CASE WHEN af THEN NOT af_promo END AS satisfied FROM facts UNION ALL SELECT case_id, 'has_standard', std FROM facts
        UNION ALL SELECT case_id, 'any_of_slots', any_slot FROM facts UNION ALL SELECT case_id, 'much_needs_standard', CASE WHEN much THEN std END FROM facts)
"""


def _evaluated(t: Tables) -> DataFrame:
    af, promo = F.col("slot") == "AF", F.col("family") == "PROMO"
    standard = F.bool_or(F.col("family") == "STANDARD")
    return R.item_rules(
        t.named_items,
        {
            "no_promo_in_af": (F.bool_or(af), ~F.bool_or(af & promo)),
            "has_standard": (None, standard),
            "any_of_slots": (None, F.bool_or(F.col("slot").isin("NO", "RF"))),
            "much_needs_standard": (F.bool_or(F.col("quantity") > 40), standard),
        },
    )


@query(SQL_RULES + "SELECT case_id, rule, satisfied FROM evaluated")
def rule_eval_item(t: Tables) -> DataFrame:
    return _evaluated(t)


@query(SQL_RULES + "SELECT rule, count(satisfied) AS n, round(avg(CAST(satisfied AS DOUBLE)), 6) AS compliance FROM evaluated GROUP BY 1")
def compliance(t: Tables) -> DataFrame:
    return R.compliance(_evaluated(t), "rule")


@query("SELECT conv_id, CASE WHEN count(text) = 0 THEN NULL ELSE bool_or(regexp_matches(text, '[0-9]{2,}')) END AS satisfied FROM conversations GROUP BY 1")
def rule_eval_note(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.when(F.count("text") > 0, F.bool_or(F.col("text").rlike("[0-9]{2,}"))).alias("satisfied"))


@query("SELECT product_id, family = 'PROMO' AS primary_hit, (family = 'PROMO' OR grp = 'Brand#1') AS any_hit FROM catalogue")
def group_presence_primary(t: Tables) -> DataFrame:
    first = F.col("family") == "PROMO"
    return t.catalogue.select("product_id", first.alias("primary_hit"), (first | (F.col("grp") == "Brand#1")).alias("any_hit"))


PCT = "quantile_cont(CAST({0} AS DOUBLE), 0.05) AS p05, quantile_cont(CAST({0} AS DOUBLE), 0.95) AS p95"
SQL_CHECKS = f""", bands AS (SELECT family, unit, round(p05, 6) AS p05, round(p95, 6) AS p95 FROM (SELECT family, unit, {PCT.format('quantity')} FROM named_items GROUP BY 1, 2)),
    per_slot AS (SELECT case_id, slot, count(DISTINCT product_id) AS n, count(*) - count(DISTINCT family) AS repeats FROM named_items GROUP BY 1, 2),
    slot_bands AS (SELECT slot, round(p05, 6) AS p05, round(p95, 6) AS p95 FROM (SELECT slot, {PCT.format('n')} FROM per_slot GROUP BY 1)),
    repeat_bands AS (SELECT slot, round(p05, 6) AS p05, round(p95, 6) AS p95 FROM (SELECT slot, {PCT.format('repeats')} FROM per_slot GROUP BY 1)),
    per_case AS (SELECT case_id, count(DISTINCT slot) AS n FROM items GROUP BY 1), case_band AS (SELECT round(p05, 6) AS p05, round(p95, 6) AS p95 FROM (SELECT {PCT.format('n')} FROM per_case)),
    violations AS (
        SELECT case_id, 'quantity_out_of_range' AS kind, slot, family AS subject, CAST(quantity AS DOUBLE) AS value, p05 AS low, p95 AS high FROM named_items JOIN bands USING (family, unit) WHERE quantity < p05 OR quantity > p95
        UNION ALL SELECT case_id, 'items_per_slot', slot, NULL, CAST(n AS DOUBLE), p05, p95 FROM per_slot JOIN slot_bands USING (slot) WHERE n < p05 OR n > p95
        UNION ALL SELECT case_id, 'repeated_product', slot, NULL, CAST(repeats AS DOUBLE), p05, p95 FROM per_slot JOIN repeat_bands USING (slot) WHERE repeats < p05 OR repeats > p95
        UNION ALL SELECT case_id, 'slot_count', NULL, NULL, CAST(n AS DOUBLE), p05, p95 FROM per_case, case_band WHERE n < p05 OR n > p95
        UNION ALL SELECT case_id, 'alternative_groups_mixed', NULL, line_group, CAST(count(DISTINCT family) AS DOUBLE), NULL, 4 FROM named_items GROUP BY case_id, line_group HAVING count(DISTINCT family) > 4
        UNION ALL SELECT case_id, 'quantities_differ', slot, grp, CAST(count(DISTINCT quantity) AS DOUBLE), NULL, 1 FROM named_items GROUP BY case_id, slot, grp HAVING count(DISTINCT quantity) > 1)
"""


def violations(t: Tables) -> DataFrame:
    """All checks of real cases against the bands mined from them, in one form."""
    rows = t.named_items
    mixed = rows.groupBy("case_id", "line_group").agg(F.count_distinct("family").alias("n")).filter("n > 4").withColumn("most", F.lit(4))
    differ = rows.groupBy("case_id", "slot", "grp").agg(F.count_distinct("quantity").alias("n")).filter("n > 1").withColumn("most", F.lit(1))
    return (
        R.plausibility(rows, rows)
        .unionByName(R.violation(mixed, "alternative_groups_mixed", subject="line_group", value="n", high="most"))
        .unionByName(R.violation(differ, "quantities_differ", slot="slot", subject="grp", value="n", high="most"))
    )


@query(SQL_CHECKS + "SELECT case_id, kind, slot, subject, value, low, high FROM violations")
def plausibility_check(t: Tables) -> DataFrame:
    return violations(t)


@query(SQL_CHECKS + """SELECT kind, count(*) AS n, count(DISTINCT case_id) AS cases, round(count(DISTINCT case_id) / (SELECT count(*) FROM cases), 6) AS rate,
    CASE WHEN count(DISTINCT case_id) / (SELECT count(*) FROM cases) > 0.1 THEN 'calibration' ELSE 'violation' END AS class FROM violations GROUP BY 1""")
def conformance_checks(t: Tables) -> DataFrame:
    return R.rates(violations(t), t.headers.agg(F.count("*").alias("total")))


@query("SELECT a.case_id, a.slot AS slot_a, b.slot AS slot_b, a.family FROM (SELECT DISTINCT case_id, slot, family FROM named_items) a JOIN (SELECT DISTINCT case_id, slot, family FROM named_items) b ON a.case_id = b.case_id AND a.family = b.family AND a.slot < b.slot")
def repeats_across_slots(t: Tables) -> DataFrame:
    one = t.named_items.select("case_id", "family", F.col("slot").alias("slot_a")).distinct()
    other = t.named_items.select("case_id", "family", F.col("slot").alias("slot_b")).distinct()
    return one.join(other, ["case_id", "family"]).filter("slot_a < slot_b").select("case_id", "slot_a", "slot_b", "family")


@query("SELECT case_id FROM items GROUP BY 1 HAVING bool_or(slot = 'AF') AND NOT bool_or(slot = 'NO')")
def empty_required_slot(t: Tables) -> DataFrame:
    has, lacks = t.items.filter("slot = 'AF'").select("case_id").distinct(), t.items.filter("slot = 'NO'").select("case_id")
    return has.join(lacks, "case_id", "left_anti")


@query(f""", totals AS (SELECT case_id, grp, sum(quantity) AS q FROM named_items GROUP BY 1, 2), tb AS (SELECT grp, round(p05, 6) AS p05, round(p95, 6) AS p95 FROM (SELECT grp, {PCT.format('q')} FROM totals GROUP BY 1))
    SELECT case_id, grp, q, CASE WHEN q < p05 THEN 'low' ELSE 'high' END AS side FROM totals JOIN tb USING (grp) WHERE q < p05 OR q > p95""")
def daily_totals_outside(t: Tables) -> DataFrame:
    totals = t.named_items.groupBy("case_id", "grp").agg(F.sum("quantity").alias("q"))
    out = R.outside(totals, totals.groupBy("grp").agg(*M.percentiles("q")), ["grp"], "q")
    return out.select("case_id", "grp", "q", F.when(F.col("q") < F.col("p05"), "low").otherwise("high").alias("side"))


@query(""", pairs AS (SELECT a.family AS a, b.family AS b, count(*) AS n FROM (SELECT DISTINCT case_id, line_group, family FROM named_items) a JOIN (SELECT DISTINCT case_id, line_group, family FROM named_items) b USING (case_id, line_group) WHERE a.family < b.family GROUP BY 1, 2),
    common AS (SELECT a, b FROM pairs WHERE n >= (SELECT avg(n) FROM pairs))
    SELECT x.case_id, x.line_group, x.family AS a, y.family AS b FROM (SELECT DISTINCT case_id, line_group, family FROM named_items) x JOIN (SELECT DISTINCT case_id, line_group, family FROM named_items) y
        ON x.case_id = y.case_id AND x.line_group = y.line_group AND x.family < y.family WHERE NOT EXISTS (SELECT 1 FROM common WHERE common.a = x.family AND common.b = y.family)""")
def non_interchangeable_pairs(t: Tables) -> DataFrame:
    sets = t.named_items.select("case_id", "line_group", "family").distinct()
    other = sets.withColumnRenamed("family", "b")
    inside = sets.withColumnRenamed("family", "a").join(other, ["case_id", "line_group"]).filter("a < b")
    pairs = inside.groupBy("a", "b").agg(F.count("*").alias("n"))
    common = pairs.crossJoin(F.broadcast(pairs.agg(F.avg("n").alias("mean")))).filter("n >= mean").select("a", "b")
    return inside.join(common, ["a", "b"], "left_anti")


@query("SELECT slot, count(*) AS n, count(*) FILTER (WHERE quantity > 45) AS n_absurd, round(avg(CAST(unit = 'u0' AS DOUBLE)), 6) AS unit_mix FROM items GROUP BY 1")
def unit_mix(t: Tables) -> DataFrame:
    return t.items.groupBy("slot").agg(F.count("*").alias("n"), F.count_if(F.col("quantity") > 45).alias("n_absurd"), F.round(F.avg((F.col("unit") == "u0").cast("double")), 6).alias("unit_mix"))


@query("""SELECT case_id, line, CASE WHEN family = 'PROMO' AND NOT bool_or(family = 'STANDARD') OVER w THEN 'drop' ELSE 'keep' END AS outcome FROM named_items WINDOW w AS (PARTITION BY case_id)""")
def drop_inapplicable(t: Tables) -> DataFrame:
    has = F.bool_or(F.col("family") == "STANDARD").over(Window.partitionBy("case_id"))
    return t.named_items.select("case_id", "line", F.when((F.col("family") == "PROMO") & ~has, "drop").otherwise("keep").alias("outcome"))


SQL_MISSING = """, present AS (SELECT DISTINCT case_id, slot, family FROM named_items), support AS (SELECT slot, grp, count(DISTINCT case_id) AS n FROM named_items WHERE family = 'STANDARD' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY slot ORDER BY count(DISTINCT case_id) DESC, grp) = 1)"""


@query(SQL_MISSING + "SELECT s.case_id, s.slot, u.grp AS added FROM (SELECT DISTINCT case_id, slot FROM present) s JOIN support u USING (slot) WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.case_id = s.case_id AND p.slot = s.slot AND p.family = 'STANDARD')")
def complete_required_groups(t: Tables) -> DataFrame:
    counts = t.named_items.filter("family = 'STANDARD'").groupBy("slot", "grp").agg(F.count_distinct("case_id").alias("n"))
    support = best(counts, ["slot"], [F.desc("n"), F.asc("grp")], 1).select("slot", F.col("grp").alias("added"))
    held = t.items.select("case_id", "slot").distinct()
    have = t.named_items.filter("family = 'STANDARD'").select("case_id", "slot")
    return held.join(have, ["case_id", "slot"], "left_anti").join(support, "slot").select("case_id", "slot", "added")


@query(f""", n AS (SELECT case_id, slot, count(DISTINCT grp) AS n FROM named_items GROUP BY 1, 2), b AS (SELECT slot, quantile_cont(n, 0.95) AS need FROM n GROUP BY 1),
    ranked AS (SELECT slot, grp, row_number() OVER (PARTITION BY slot ORDER BY count(DISTINCT case_id) DESC, grp) AS place FROM named_items GROUP BY 1, 2), present AS (SELECT DISTINCT case_id, slot, grp FROM named_items)
    SELECT case_id, slot, grp FROM (SELECT n.case_id, n.slot, r.grp, row_number() OVER (PARTITION BY n.case_id, n.slot ORDER BY r.place) AS k, need - n.n AS short FROM n JOIN b USING (slot) JOIN ranked r ON r.slot = n.slot AND r.place <= 6
        LEFT JOIN present p ON p.case_id = n.case_id AND p.slot = n.slot AND p.grp = r.grp WHERE p.grp IS NULL) WHERE k <= short""")
def top_up_slot(t: Tables) -> DataFrame:
    """Groups added, best supported first, until a slot has as many as a full slot (95th percentile); from the slot's first six."""
    n = t.named_items.groupBy("case_id", "slot").agg(F.count_distinct("grp").alias("n"))
    need = n.groupBy("slot").agg(F.percentile("n", F.lit(0.95)).alias("need"))
    counts = t.named_items.groupBy("slot", "grp").agg(F.count_distinct("case_id").alias("c"))
    ranked = best(counts, ["slot"], [F.desc("c"), F.asc("grp")], 6, "place").select("slot", "grp", "place")
    missing = n.join(need, "slot").join(ranked, "slot").join(t.named_items.select("case_id", "slot", "grp"), ["case_id", "slot", "grp"], "left_anti")
    k = F.row_number().over(Window.partitionBy("case_id", "slot").orderBy("place"))
    return missing.withColumn("k", k).filter(F.col("k") <= F.col("need") - F.col("n")).select("case_id", "slot", "grp")


SQL_UNIT_BANDS = f""", b AS (SELECT family, unit, count(*) AS n, round(quantile_cont(CAST(quantity AS DOUBLE), 0.05), 6) AS p05, round(quantile_cont(CAST(quantity AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(quantity AS DOUBLE), 0.95), 6) AS p95
    FROM named_items WHERE unit <> 'u2' OR family <> 'PROMO' GROUP BY 1, 2), m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, unit) = 1)"""


@query(SQL_UNIT_BANDS + """SELECT i.case_id, i.line, CASE WHEN b.unit IS NULL THEN m.unit ELSE i.unit END AS unit, CASE WHEN b.unit IS NULL THEN m.p50 ELSE least(greatest(i.quantity, b.p05), b.p95) END AS quantity,
    CASE WHEN b.unit IS NULL THEN 'unseen unit' WHEN i.quantity < b.p05 OR i.quantity > b.p95 THEN 'clamped' ELSE 'kept' END AS change FROM named_items i LEFT JOIN b USING (family, unit) JOIN m ON m.family = i.family""")
def normalise_quantities(t: Tables) -> DataFrame:
    from casework.functions.columns import clamp

    seen = M.quantity_bands(t.named_items.filter("unit <> 'u2' OR family <> 'PROMO'"), ["family", "unit"], least=1)
    modal = best(seen, ["family"], [F.desc("n"), F.asc("unit")], 1).select("family", F.col("unit").alias("m_unit"), F.col("p50").alias("m_p50"))
    rows = t.named_items.join(seen.select("family", "unit", "p05", "p95"), ["family", "unit"], "left").join(modal, "family")
    new, off = F.col("p05").isNull(), (F.col("quantity") < F.col("p05")) | (F.col("quantity") > F.col("p95"))
    quantity = F.when(new, F.col("m_p50")).otherwise(clamp(F.col("quantity"), F.col("p05"), F.col("p95")))
    change = F.when(new, "unseen unit").when(off, "clamped").otherwise("kept")
    return rows.select("case_id", "line", F.when(new, F.col("m_unit")).otherwise(F.col("unit")).alias("unit"), quantity.alias("quantity"), change.alias("change"))


@query(""", med AS (SELECT case_id, slot, grp, median(quantity) AS m FROM named_items GROUP BY 1, 2, 3), a AS (SELECT *, first_value(m) OVER (PARTITION BY case_id, slot ORDER BY m DESC, grp) AS anchor FROM med)
    SELECT case_id, slot, grp, m, anchor, round(m / anchor, 6) AS ratio, CASE WHEN m / anchor < 0.25 THEN anchor * 0.25 ELSE m END AS moved FROM a""")
def harmonise_rations(t: Tables) -> DataFrame:
    med = t.named_items.groupBy("case_id", "slot", "grp").agg(F.median("quantity").alias("m"))
    anchor = F.first("m").over(Window.partitionBy("case_id", "slot").orderBy(F.desc("m"), "grp"))
    ratio = F.col("m") / F.col("anchor")
    rows = med.withColumn("anchor", anchor)
    return rows.select("case_id", "slot", "grp", "m", "anchor", F.round(ratio, 6).alias("ratio"), F.when(ratio < 0.25, F.col("anchor") * 0.25).otherwise(F.col("m")).alias("moved"))


@query(""", votes AS (SELECT family, slot, count(*) AS c FROM named_items WHERE slot <> 'NO' GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER w AS r, lead(c) OVER w AS next FROM votes WINDOW w AS (PARTITION BY family ORDER BY c DESC, slot)),
    target AS (SELECT family, CASE WHEN c >= 2 AND c - coalesce(next, 0) >= 2 THEN slot ELSE 'RF' END AS slot FROM ranked WHERE r = 1), held AS (SELECT DISTINCT case_id, slot FROM items)
    SELECT i.case_id, i.line, CASE WHEN i.slot = 'NO' AND h.case_id IS NOT NULL THEN t.slot ELSE i.slot END AS slot FROM named_items i LEFT JOIN target t USING (family) LEFT JOIN held h ON h.case_id = i.case_id AND h.slot = t.slot""")
def slot_vote_placement(t: Tables) -> DataFrame:
    votes = t.named_items.filter("slot <> 'NO'").groupBy("family", "slot").agg(F.count("*").alias("c"))
    w = Window.partitionBy("family").orderBy(F.desc("c"), "slot")
    ranked = votes.withColumn("r", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("c").over(w), F.lit(0))).filter("r = 1")
    target = ranked.select("family", F.when((F.col("c") >= 2) & (F.col("c") - F.col("next") >= 2), F.col("slot")).otherwise("RF").alias("target"))
    held = t.items.select("case_id", F.col("slot").alias("target")).distinct().withColumn("there", F.lit(True))
    rows = t.named_items.join(target, "family", "left").join(held, ["case_id", "target"], "left")
    return rows.select("case_id", "line", F.when((F.col("slot") == "NO") & F.col("there"), F.col("target")).otherwise(F.col("slot")).alias("slot"))


@query(""", liked AS (SELECT entity_id, family, count(*) AS n FROM named_items JOIN cases USING (case_id) GROUP BY 1, 2), support AS (SELECT family, count(DISTINCT entity_id) AS backers FROM liked WHERE n >= 10 GROUP BY 1)
    SELECT case_id, slot, i.family, string_agg(DISTINCT r.rule, ',' ORDER BY r.rule) AS rules, coalesce(any_value(u.backers), 0) AS backers FROM named_items i LEFT JOIN support u ON u.family = i.family JOIN (VALUES ('promo in RF', 'PROMO', 'RF'), ('standard', 'STANDARD', NULL), ('economy in NO', 'ECONOMY', 'NO')) r(rule, family, rule_slot)
        ON r.family = i.family AND (rule_slot IS NULL OR rule_slot = slot) GROUP BY 1, 2, 3""")
def rule_support_attach(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("promo in RF", "PROMO", "RF"), ("standard", "STANDARD", None), ("economy in NO", "ECONOMY", "NO")], "rule string, family string, rule_slot string")
    rows = t.named_items.join(F.broadcast(rules), "family").filter("rule_slot IS NULL OR rule_slot = slot")
    liked = t.named_items.join(t.headers.select("case_id", "entity_id"), "case_id").groupBy("entity_id", "family").agg(F.count("*").alias("n"))
    support = liked.filter("n >= 10").groupBy("family").agg(F.count("*").alias("backers"))
    attached = rows.groupBy("case_id", "slot", "family").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    return attached.join(support, "family", "left").select("case_id", "slot", "family", "rules", F.coalesce("backers", F.lit(0)).alias("backers"))

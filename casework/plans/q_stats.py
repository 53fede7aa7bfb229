"""Queries of evaluation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.operators import joins as J
from casework.operators import mining as M
from casework.operators import stats as S
from casework.plans.q_joins import purchase_spans
from casework.plans.registry import query
from casework.sources.tables import Tables

SQL_RHO = "round(corr(rx, ry), 6)"


def _rank_sql(source: str, by: str, x: str, y: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    same = f"PARTITION BY {by}, " if by else "PARTITION BY "
    return f"""(SELECT {by + ', ' if by else ''}rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({same}{x}) - 1) / 2 AS rx,
        rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({same}{y}) - 1) / 2 AS ry FROM {source})"""


SIZES = "(SELECT case_id, count(*) AS n, sum(quantity) AS q FROM items GROUP BY 1) JOIN cases USING (case_id)"


@query(f"SELECT objective, count(*) AS n, {SQL_RHO} AS rho FROM {_rank_sql(SIZES, 'objective', 'total', 'q')} GROUP BY 1")
def spearman(t: Tables) -> DataFrame:
    sizes = t.items.groupBy("case_id").agg(F.sum("quantity").alias("q")).join(t.headers.select("case_id", "objective", "total"), "case_id")
    return S.spearman(sizes, ["objective"], "total", "q")


@query(f"SELECT family, slot, count(*) AS n, {SQL_RHO} AS rho, count(*) >= 30 AS enough FROM {_rank_sql('named_items JOIN cases USING (case_id)', 'family, slot', 'total', 'quantity')} GROUP BY 1, 2")
def cell_scaling(t: Tables) -> DataFrame:
    rows = t.named_items.join(t.headers.select("case_id", "total"), "case_id").select("family", "slot", "total", "quantity")
    return S.spearman(rows, ["family", "slot"], "total", "quantity").withColumn("enough", F.col("n") >= 30)


SQL_SLOTS = """, pairs AS (SELECT case_id, next_id FROM (SELECT case_id, lead(case_id) OVER (PARTITION BY entity_id ORDER BY version) AS next_id FROM cases) WHERE next_id IS NOT NULL),
    f AS (SELECT DISTINCT case_id, slot, family FROM named_items), n AS (SELECT case_id, slot, count(*) AS n FROM f GROUP BY 1, 2),
    common AS (SELECT p.case_id, a.slot, count(*) AS c FROM pairs p JOIN f a ON a.case_id = p.case_id JOIN f b ON b.case_id = p.next_id AND a.slot = b.slot AND a.family = b.family GROUP BY 1, 2),
    slots AS (SELECT p.case_id, p.next_id, x.slot, x.n AS n_a, coalesce(y.n, 0) AS n_b, coalesce(c, 0) AS c FROM pairs p JOIN n x ON x.case_id = p.case_id LEFT JOIN n y ON y.case_id = p.next_id AND y.slot = x.slot LEFT JOIN common m ON m.case_id = p.case_id AND m.slot = x.slot)
"""


def _slots(t: Tables) -> DataFrame:
    pairs = J.consecutive_versions(t.cases).select("case_id", "next_id")
    f = t.named_items.select("case_id", "slot", "family").distinct()
    n = f.groupBy("case_id", "slot").agg(F.count("*").alias("n"))
    following = f.withColumnRenamed("case_id", "next_id")
    common = pairs.join(f, "case_id").join(following, ["next_id", "slot", "family"]).groupBy("case_id", "slot").agg(F.count("*").alias("c"))
    out = pairs.join(n.withColumnRenamed("n", "n_a"), "case_id").join(n.select(F.col("case_id").alias("next_id"), "slot", F.col("n").alias("n_b")), ["next_id", "slot"], "left").join(common, ["case_id", "slot"], "left")
    return out.select("case_id", "next_id", "slot", "n_a", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_b", "c")])


@query(SQL_SLOTS + "SELECT case_id, round(avg(c / (n_a + n_b - c)), 6) AS jaccard FROM slots GROUP BY 1")
def per_slot_jaccard(t: Tables) -> DataFrame:
    return _slots(t).groupBy("case_id").agg(F.round(F.avg(F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c"))), 6).alias("jaccard"))


@query(SQL_SLOTS + """SELECT case_id, count(*) AS n_slots, count(*) FILTER (WHERE n_b > 0) AS n_shared, round(avg(abs(n_a - n_b)), 6) AS items_mae, round(sum(c) / sum(n_a), 6) AS placement FROM slots GROUP BY 1""")
def structure_similarity(t: Tables) -> DataFrame:
    a, b = F.col("n_a"), F.col("n_b")
    return _slots(t).groupBy("case_id").agg(
        F.count("*").alias("n_slots"), F.count_if(b > 0).alias("n_shared"), F.round(F.avg(F.abs(a - b)), 6).alias("items_mae"), F.round(F.sum("c") / F.sum(a), 6).alias("placement")
    )


@query("""SELECT entity_id, n, n_unique, slots, q_mean, q_sd, q_iqr, round_share, slot_entropy FROM (
        SELECT entity_id, sum(c) AS n, sum(c) FILTER (WHERE slot = 'NO') AS no_, round(-sum(c / t * ln(c / t)), 6) AS slot_entropy, count(*) AS slots FROM (SELECT case_id AS entity_id, slot, count(*) AS c, sum(count(*)) OVER (PARTITION BY case_id) AS t FROM items GROUP BY 1, 2) GROUP BY 1)
    JOIN (SELECT case_id AS entity_id, count(DISTINCT product_id) AS n_unique, round(avg(quantity), 6) AS q_mean, round(stddev_pop(quantity), 6) AS q_sd, round(quantile_cont(CAST(quantity AS DOUBLE), 0.75) - quantile_cont(CAST(quantity AS DOUBLE), 0.25), 6) AS q_iqr,
        round(avg(CAST(quantity % 5 = 0 AS DOUBLE)), 6) AS round_share FROM items GROUP BY 1) USING (entity_id)""")
def structural_features(t: Tables) -> DataFrame:
    slots = t.items.groupBy("case_id", "slot").agg(F.count("*").alias("c")).groupBy("case_id").agg(F.collect_list(F.col("c").cast("double")).alias("counts"))
    shape = slots.select("case_id", F.size("counts").cast("long").alias("slots"), F.round(S.entropy(F.col("counts")), 6).alias("slot_entropy"))
    rows = t.items.groupBy("case_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("product_id").alias("n_unique"),
        F.round(F.avg("quantity"), 6).alias("q_mean"),
        F.round(F.stddev_pop("quantity"), 6).alias("q_sd"),
        F.round(F.percentile("quantity", F.lit(0.75)) - F.percentile("quantity", F.lit(0.25)), 6).alias("q_iqr"),
        F.round(F.avg((F.col("quantity") % 5 == 0).cast("double")), 6).alias("round_share"),
    )
    return rows.join(shape, "case_id").withColumnRenamed("case_id", "entity_id")


@query(""", liked AS (SELECT entity_id, family FROM (SELECT entity_id, family, count(*) AS n FROM named_items JOIN cases USING (case_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, family) = 1),
    held AS (SELECT DISTINCT case_id, family FROM named_items), own AS (SELECT l.family, c.entity_id, count(*) AS n, count(h.case_id) AS k FROM liked l JOIN cases c USING (entity_id) LEFT JOIN held h ON h.case_id = c.case_id AND h.family = l.family GROUP BY 1, 2),
    base AS (SELECT family, count(*) AS k FROM held JOIN cases USING (case_id) GROUP BY 1)
    SELECT family, count(*) AS entities, round(sum(own.k) / sum(own.n), 6) AS observed, round(avg((base.k - own.k) / ((SELECT count(*) FROM cases) - own.n)), 6) AS base FROM own JOIN base USING (family) GROUP BY 1""")
def preference_uplift(t: Tables) -> DataFrame:
    from casework.operators.retrieve import best

    heads = t.headers.select("case_id", "entity_id")
    rows = t.named_items.select("case_id", "family").join(heads, "case_id")
    counts = rows.groupBy("entity_id", "family").agg(F.count("*").alias("n"))
    liked = best(counts, ["entity_id"], [F.desc("n"), F.asc("family")], 1).select("entity_id", "family")
    held = rows.select("case_id", "family").distinct().withColumn("has", F.lit(1))
    own = liked.join(heads, "entity_id").join(held, ["case_id", "family"], "left").groupBy("family", "entity_id").agg(F.count("*").alias("own_n"), F.count("has").alias("own_k"))
    base = held.groupBy("family").agg(F.count("*").alias("all_k")).crossJoin(F.broadcast(t.headers.agg(F.count("*").alias("all_n"))))
    rest = (F.col("all_k") - F.col("own_k")) / (F.col("all_n") - F.col("own_n"))
    return own.join(base, "family").groupBy("family").agg(F.count("*").alias("entities"), F.round(F.sum("own_k") / F.sum("own_n"), 6).alias("observed"), F.round(F.avg(rest), 6).alias("base"))


@query(""", spans AS (SELECT * FROM (SELECT event_id, entity_id, ts AS start, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS stop FROM series WHERE marker = 'purchase') WHERE stop IS NOT NULL),
    w AS (SELECT s.event_id, count(v.ts) AS n, arg_max(v.value, v.ts) - arg_min(v.value, v.ts) AS change FROM spans s LEFT JOIN series v ON v.marker = 'view' AND v.entity_id = s.entity_id AND v.ts >= s.start AND v.ts < s.stop GROUP BY 1)
    SELECT event_id, CASE WHEN n < 2 THEN 'unknown' WHEN change > 1 THEN 'up' WHEN change < -1 THEN 'down' ELSE 'flat' END AS trend FROM w""")
def trend_contradiction(t: Tables) -> DataFrame:
    views = t.series.filter("marker = 'view'")
    out = J.readings_in_window(purchase_spans(t), views, by="entity_id", start="start", stop="stop", time="ts", value="value")
    change = F.col("last_value") - F.col("first_value")
    trend = F.when(F.col("n") < 2, "unknown").when(change > 1, "up").when(change < -1, "down").otherwise("flat")
    return out.select("event_id", trend.alias("trend"))


@query("""SELECT product_id, CASE WHEN price > 0 AND scale > 0 THEN round(86.01 * log10(price) - 70.041 * log10(scale) + 36.76, 6) END AS share, CASE WHEN scale > 0 THEN round(price / (scale * scale), 6) END AS index_ FROM catalogue""")
def body_estimates(t: Tables) -> DataFrame:
    price, scale = F.col("price"), F.col("scale")
    share = F.when((price > 0) & (scale > 0), F.round(F.lit(86.01) * F.log10(price) - F.lit(70.041) * F.log10(scale) + F.lit(36.76), 6))
    return t.catalogue.select("product_id", share.alias("share"), F.when(scale > 0, F.round(price / (scale * scale), 6)).alias("index_"))


SAID_JACCARD = "len(list_intersect({0}, said)) / CAST(len({0}) + len(said) - len(list_intersect({0}, said)) AS DOUBLE)"


@query(f""", wide AS (SELECT case_id, list(DISTINCT grp) AS groups FROM named_items GROUP BY 1),
    shares AS (SELECT objective, grp, round(count(DISTINCT case_id) / max(n), 6) AS share FROM named_items JOIN cases USING (case_id) JOIN (SELECT objective, count(*) AS n FROM cases GROUP BY 1) USING (objective) GROUP BY 1, 2),
    tops AS (SELECT objective, list(grp) AS top FROM (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY objective ORDER BY share DESC, grp) <= 4) GROUP BY 1),
    rows_ AS (SELECT c.objective, w.groups AS copy, f.groups AS oldest, n.groups AS truth, top FROM cases c JOIN cases x ON x.entity_id = c.entity_id AND x.version = c.version + 1 JOIN cases o ON o.entity_id = c.entity_id AND o.version = 1
        JOIN wide w ON w.case_id = c.case_id JOIN wide f ON f.case_id = o.case_id JOIN wide n ON n.case_id = x.case_id JOIN tops ON tops.objective = c.objective),
    said AS (SELECT objective, truth, copy, 'copy' AS variant, copy AS said FROM rows_ UNION ALL SELECT objective, truth, copy, 'oldest', oldest FROM rows_ UNION ALL SELECT objective, truth, copy, 'prevalent', top FROM rows_)
    SELECT variant, objective, count(*) AS n, round(avg({SAID_JACCARD.format('truth')}), 4) AS jaccard, round(avg(len(list_intersect(truth, said)) / CAST(len(truth) AS DOUBLE)), 4) AS recall, round(avg(1 - {SAID_JACCARD.format('copy')}), 4) AS novelty FROM said GROUP BY 1, 2""")
def loo_report(t: Tables) -> DataFrame:
    """Three predictions of every case's next version - itself, its entity's first version, the most prevalent groups of
    its objective - by mean Jaccard, recall and novelty per objective."""
    pairs = J.consecutive_versions(t.cases).select("entity_id", "case_id", "next_id", "objective")
    first = t.cases.filter("version = 1").select("entity_id", F.col("case_id").alias("first_id"))
    sets = t.named_items.select("case_id", "grp").distinct()
    wide = sets.groupBy("case_id").agg(F.collect_set("grp").alias("groups"))
    shares = M.prevalence(t.headers, t.named_items, "objective", "grp")
    from casework.operators.retrieve import best

    top = best(shares, ["objective"], [F.desc("share"), F.asc("grp")], 4).groupBy("objective").agg(F.collect_set("grp").alias("top"))
    rows = (
        pairs.join(first, "entity_id")
        .join(wide.withColumnRenamed("groups", "copy"), "case_id")
        .join(wide.select(F.col("case_id").alias("first_id"), F.col("groups").alias("oldest")), "first_id")
        .join(wide.select(F.col("case_id").alias("next_id"), F.col("groups").alias("truth")), "next_id")
        .join(top, "objective")
    )
    from casework.functions.columns import set_jaccard

    variants = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("said")) for n, c in (("copy", "copy"), ("oldest", "oldest"), ("prevalent", "top"))]))
    scored = rows.select("objective", "truth", "copy", variants.alias("v")).select("objective", "truth", "copy", "v.*")
    recall = F.size(F.array_intersect("truth", "said")) / F.size("truth")
    return scored.groupBy("variant", "objective").agg(
        F.count("*").alias("n"), F.round(F.avg(set_jaccard(F.col("truth"), F.col("said"))), 4).alias("jaccard"), F.round(F.avg(recall), 4).alias("recall"), F.round(F.avg(1 - set_jaccard(F.col("copy"), F.col("said"))), 4).alias("novelty")
    )

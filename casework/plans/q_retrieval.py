"""Queries of retrieval and consensus. The stated query set: every case whose id is divisible by 50, against all cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators import consensus as C
from casework.operators import retrieve as R
from casework.plans.registry import query
from casework.sources.tables import Tables

K, POOL = 20, 160


def candidates(t: Tables) -> DataFrame:
    return t.headers.join(t.profiles, "entity_id").select("case_id", "entity_id", "objective", "segment", "nation", "region", "balance")


def known_cases(t: Tables) -> DataFrame:
    """The candidates, written once a query: counts of cells, the queries and what they meet all begin with them."""
    return t.once("candidates", lambda: candidates(t))


def stated_queries(t: Tables) -> DataFrame:
    rows = known_cases(t).filter(F.col("case_id") % 50 == 0)
    return rows.select(F.col("case_id").alias("query_id"), *[F.col(c).alias("q_" + c) for c in ("entity_id", "objective", "segment", "nation", "region", "balance")])


def pool(t: Tables) -> DataFrame:
    return t.once("pool", lambda: R.attribute_pool(stated_queries(t), known_cases(t), POOL))


def neighbourhood(t: Tables) -> DataFrame:
    """The neighbourhood of every stated query, written once a query, as several steps begin with it."""
    return t.once("neighbourhood", lambda: R.diverse_neighbourhood(R.attribute_pool(stated_queries(t), known_cases(t), POOL), K))


SQL_QUERIES = """
, candidates AS (SELECT case_id, entity_id, objective, segment, nation, region, balance FROM cases JOIN profiles USING (entity_id)),
stated AS (
    SELECT case_id AS query_id, entity_id AS q_entity_id, objective AS q_objective, segment AS q_segment, nation AS q_nation,
           region AS q_region, balance AS q_balance
    FROM cases JOIN profiles USING (entity_id) WHERE case_id % 50 = 0)
"""


def score_sql(weights: tuple[float, ...] = R.WEIGHTS) -> str:
    """The score of a row that holds a case's traits and a query's."""
    matches = [f"coalesce(CAST({c} = q_{c} AS DOUBLE), 0.5)" for c in R.TRAITS] + [f"coalesce(1.0 - least(abs(balance - q_balance), {R.SPAN}) / {R.SPAN}, 0.5)"]
    return f"round(({' + '.join(f'{m} * {w}' for m, w in zip(matches, weights, strict=True))}) / {float(round(sum(weights), 9))}, 6)"


SQL_SCORED = SQL_QUERIES + f"""
, scored AS (
    SELECT query_id, case_id, entity_id, objective = q_objective AS same, segment = q_segment AS same_segment, {score_sql()} AS score
    FROM candidates JOIN stated ON entity_id <> q_entity_id)
"""
SQL_POOL = SQL_SCORED + """
, pool AS (SELECT query_id, case_id, entity_id, same, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank
           FROM scored QUALIFY rank <= 160)
"""
SQL_NEAR = SQL_POOL + """
, staged AS (SELECT *, CASE WHEN NOT same THEN 2 WHEN row_number() OVER (PARTITION BY query_id, entity_id, same ORDER BY rank) = 1 THEN 0 ELSE 1 END AS stage
             FROM pool),
near AS (SELECT query_id, case_id, entity_id, same, score, stage, row_number() OVER (PARTITION BY query_id ORDER BY stage, rank) AS rank
         FROM (SELECT query_id, case_id, entity_id, same, score, stage, rank FROM staged) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY stage, staged_rank) <= 20)
""".replace("SELECT query_id, case_id, entity_id, same, score, stage, rank FROM staged", "SELECT query_id, case_id, entity_id, same, score, stage, rank AS staged_rank FROM staged").replace("ORDER BY stage, rank) AS rank", "ORDER BY stage, staged_rank) AS rank")
SQL_ROWS = SQL_NEAR + """
, rows_ AS (SELECT n.query_id, n.case_id, n.score, n.rank, i.slot, i.family, i.grp, i.quantity, i.unit FROM near n JOIN named_items i USING (case_id)),
ks AS (SELECT query_id, count(*) AS k FROM near GROUP BY 1),
slots AS (SELECT query_id, slot, slot_cases, k, round(slot_cases / k, 6) AS slot_support
          FROM (SELECT query_id, slot, count(DISTINCT case_id) AS slot_cases FROM rows_ GROUP BY 1, 2) JOIN ks USING (query_id)
          WHERE round(slot_cases / k, 6) >= 0.35 AND slot_cases >= least(2, k)),
products AS (SELECT query_id, slot, family, product_cases, case_ids, slot_cases, k, round(product_cases / slot_cases, 6) AS support
             FROM (SELECT query_id, slot, family, count(DISTINCT case_id) AS product_cases, string_agg(DISTINCT CAST(case_id AS VARCHAR), ',' ORDER BY CAST(case_id AS VARCHAR)) AS case_ids
                   FROM rows_ GROUP BY 1, 2, 3) JOIN slots USING (query_id, slot)
             WHERE round(product_cases / slot_cases, 6) >= 0.35 AND product_cases >= least(2, k))
"""


@query(SQL_QUERIES + "SELECT case_id, entity_id, objective, segment, nation, region, balance FROM candidates")
def candidate_projection(t: Tables) -> DataFrame:
    return candidates(t)


@query(SQL_POOL + "SELECT query_id, case_id, score, rank FROM pool WHERE rank <= 20")
def attribute_topk(t: Tables) -> DataFrame:
    return R.attribute_pool(stated_queries(t), known_cases(t), K).select("query_id", "case_id", "score", "rank")


@query(SQL_NEAR + "SELECT query_id, case_id, entity_id, same, score, stage, rank FROM near")
def diverse_neighbourhood(t: Tables) -> DataFrame:
    return neighbourhood(t)


@query(SQL_POOL + """SELECT query_id, case_id, entity_id, score, row_number() OVER (PARTITION BY query_id ORDER BY pr) AS rank
    FROM (SELECT query_id, case_id, entity_id, score, rank AS pr FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY rank) = 1)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pr) <= 20""")
def neighbourhood_one_per_entity(t: Tables) -> DataFrame:
    return R.one_per_entity(pool(t), K)


@query(SQL_POOL + """SELECT query_id, case_id, entity_id, score, row_number() OVER (PARTITION BY query_id ORDER BY pr) AS rank
    FROM (SELECT query_id, case_id, entity_id, score, rank AS pr FROM pool WHERE same QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY rank) = 1)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pr) <= 20""")
def neighbourhood_same_objective(t: Tables) -> DataFrame:
    return R.one_per_entity(pool(t), K, same_only=True)


@query(SQL_NEAR + """SELECT query_id, entities, purity, CASE WHEN entities >= 10 AND purity >= 0.8 THEN 'serve' WHEN entities >= 3 THEN 'declare' ELSE 'refuse' END AS band
    FROM (SELECT query_id, count(DISTINCT CASE WHEN same THEN entity_id END) AS entities, round(avg(CAST(same AS DOUBLE)), 6) AS purity FROM near GROUP BY 1)""")
def service_band(t: Tables) -> DataFrame:
    return R.service_band(neighbourhood(t))


@query(SQL_NEAR + "SELECT query_id, case_id, rank, round(power(greatest(1e-6, coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0), 0)), 2), 6) AS weight FROM near")
def vote_weights(t: Tables) -> DataFrame:
    return R.vote_weights(neighbourhood(t), 2).select("query_id", "case_id", "rank", "weight")


@query(SQL_NEAR + """SELECT query_id, case_id, same, rank FROM near
    QUALIFY rank <= CASE WHEN avg(CAST(same AS DOUBLE)) OVER (PARTITION BY query_id) = 0 THEN 1 WHEN avg(CAST(same AS DOUBLE)) OVER (PARTITION BY query_id) < 0.9 THEN 5 ELSE 1000000 END""")
def degrade_neighbourhood(t: Tables) -> DataFrame:
    return R.degrade(neighbourhood(t), least_purity=0.9, k_small=5).select("query_id", "case_id", "same", "rank")


@query(SQL_SCORED + """, marked AS (SELECT s.*, count(*) FILTER (WHERE same AND same_segment) OVER w AS n0, count(*) FILTER (WHERE same) OVER w AS n1 FROM scored s WINDOW w AS (PARTITION BY query_id)),
    tiered AS (SELECT *, CASE WHEN n0 >= 60 THEN 0 WHEN n1 >= 60 THEN 1 ELSE 2 END AS tier FROM marked)
    SELECT query_id, case_id, score, tier, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank
    FROM tiered WHERE tier = 2 OR (same AND (tier = 1 OR same_segment)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) <= 60""")
def progressive_relaxation(t: Tables) -> DataFrame:
    return R.progressive_relaxation(stated_queries(t), known_cases(t), ["segment"], 60)


@query(SQL_SCORED + """SELECT s.query_id, count(*) AS n, count(*) FILTER (WHERE same) AS n_same, count(*) FILTER (WHERE same AND v.case_id IS NULL) AS n_same_free,
        count(*) FILTER (WHERE same AND same_segment) AS n_archetype, count(*) FILTER (WHERE v.case_id IS NULL) AS n_free
    FROM scored s LEFT JOIN (SELECT DISTINCT case_id FROM items JOIN catalogue USING (product_id) WHERE bulky) v USING (case_id) GROUP BY 1""")
def candidate_counts(t: Tables) -> DataFrame:
    vetoed = t.items.join(t.catalogue.filter("bulky").select("product_id"), "product_id", "left_semi").select("case_id").distinct()
    flagged = candidates(t).join(vetoed.withColumn("vetoed", F.lit(True)), "case_id", "left").withColumn("free", F.col("vetoed").isNull())
    return R.candidate_counts(stated_queries(t), flagged)


@query(SQL_NEAR + """, f AS (SELECT query_id, count(DISTINCT CASE WHEN same THEN entity_id END) AS entities, max(score) AS top, count(*) FILTER (WHERE same) AS n_same FROM near GROUP BY 1)
    SELECT query_id, entities < 10 AS scarcity, n_same < 20 AS poor_archetype, top < 0.9 AS low_score,
           CASE WHEN entities < 10 THEN 'scarcity' WHEN n_same < 20 THEN 'poor_archetype' WHEN top < 0.9 THEN 'low_score' END AS kind FROM f""")
def gap_assessment(t: Tables) -> DataFrame:
    facts = neighbourhood(t).groupBy("query_id").agg(
        F.count_distinct(F.when(F.col("same"), F.col("entity_id"))).alias("entities"), F.max("score").alias("top"), F.count_if("same").alias("n_same")
    )
    gaps = {"scarcity": F.col("entities") < 10, "poor_archetype": F.col("n_same") < K, "low_score": F.col("top") < 0.9}
    kind = F.coalesce(*[F.when(test, F.lit(name)) for name, test in gaps.items()])
    return facts.select("query_id", *[test.alias(name) for name, test in gaps.items()], kind.alias("kind"))


@query(SQL_ROWS + "SELECT query_id, slot, slot_cases, slot_support FROM slots")
def slot_consensus(t: Tables) -> DataFrame:
    near = neighbourhood(t)
    return C.slot_consensus(C.neighbour_items(near, t.named_items), near, 0.35).select("query_id", "slot", "slot_cases", "slot_support")


def consensus_rows(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    near = neighbourhood(t)
    rows = C.neighbour_items(near, t.named_items)
    slots = C.slot_consensus(rows, near, 0.35)
    return rows, slots, C.product_consensus(rows, slots, "family", 0.35)


@query(SQL_ROWS + "SELECT query_id, slot, family, product_cases, support, case_ids FROM products")
def product_consensus(t: Tables) -> DataFrame:
    _, _, products = consensus_rows(t)
    ids = F.array_join(F.array_sort(F.transform("case_ids", lambda x: x.cast("string"))), ",")
    return products.select("query_id", "slot", "family", "product_cases", "support", ids.alias("case_ids"))


@query(SQL_ROWS + """, liked AS (SELECT entity_id AS liked_by, family FROM cases JOIN named_items USING (case_id) WHERE entity_id IN (SELECT q_entity_id FROM stated) GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, family) = 1)
    SELECT p.query_id, p.slot, p.family, p.support, l.family IS NOT NULL AS liked,
           row_number() OVER (PARTITION BY p.query_id, p.slot ORDER BY p.support DESC, p.product_cases DESC, l.family IS NULL, p.family) AS place
    FROM products p JOIN stated s USING (query_id) LEFT JOIN liked l ON l.liked_by = s.q_entity_id AND l.family = p.family""")
def preference_tiebreak(t: Tables) -> DataFrame:
    _, _, products = consensus_rows(t)
    stated = stated_queries(t).select("query_id", F.col("q_entity_id").alias("entity_id"))
    own = t.headers.select("case_id", "entity_id").join(stated.select("entity_id"), "entity_id", "left_semi").join(t.named_items, "case_id")
    counts = own.groupBy("entity_id", "family").agg(F.count("*").alias("n"))
    liked = R.best(counts, ["entity_id"], [F.desc("n"), F.asc("family")], 1).select("entity_id", "family", F.lit(True).alias("liked"))
    rows = products.join(stated, "query_id").join(liked, ["entity_id", "family"], "left").withColumn("liked", F.coalesce("liked", F.lit(False)))
    order = [F.desc("support"), F.desc("product_cases"), F.desc("liked"), F.asc("family")]
    return R.best(rows, ["query_id", "slot"], order, 1 << 30, "place").select("query_id", "slot", "family", "support", "liked", "place")


@query(SQL_ROWS + """, units AS (SELECT query_id, slot, family, unit, count(*) AS n, median(quantity) AS quantity FROM rows_ GROUP BY 1, 2, 3, 4),
    modal AS (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY query_id, slot, family ORDER BY n DESC, unit) = 1)
    SELECT p.query_id, p.slot, p.family, p.support, m.unit, CASE WHEN m.quantity > 5 THEN round_even(m.quantity / 5, 0) * 5 ELSE m.quantity END AS quantity,
           row_number() OVER (PARTITION BY p.query_id, p.slot ORDER BY p.support DESC, p.product_cases DESC, p.family) AS position
    FROM products p JOIN modal m USING (query_id, slot, family)""")
def compose_proposal(t: Tables) -> DataFrame:
    from casework.functions.columns import grid_round

    rows, _, products = consensus_rows(t)
    amounts = C.modal_unit_median(rows, ["query_id", "slot", "family"]).drop("n")
    out = products.join(amounts, ["query_id", "slot", "family"])
    placed = R.best(out, ["query_id", "slot"], [F.desc("support"), F.desc("product_cases"), F.asc("family")], 1 << 30, "position")
    return placed.select("query_id", "slot", "family", "support", "unit", grid_round(F.col("quantity")).alias("quantity"), "position")


@query()
def repeat_penalty(t: Tables) -> DataFrame:
    """Slots where a product is placed when each earlier placement raises the threshold."""
    _, _, products = consensus_rows(t)
    ordered = products.groupBy("query_id", "family").agg(F.sort_array(F.collect_list(F.struct("slot", "support"))).alias("supports"))
    return ordered.select("query_id", "family", F.array_join(C.accepted_slots(F.col("supports"), F.lit(0.35), 0.1), ",").alias("slots"))


# Vectors: the stated queries are every vector whose id is divisible by 50.
SQL_VECTORS = """
, q AS (SELECT vec_id AS query_id, label AS q_label, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 50 = 0),
scored AS (SELECT query_id, vec_id, label = q_label AS same, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe), 6) AS cosine
           FROM embeddings JOIN q ON vec_id <> query_id)
"""


def _vector_scores(t: Tables) -> DataFrame:
    v = t.embeddings
    queries = v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"), F.col("embedding").alias("q_embedding"))
    return R.vector_scores(queries, v, 10)


@query(SQL_VECTORS + "SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM scored QUALIFY rank <= 10")
def vector_topk(t: Tables) -> DataFrame:
    return R.best(_vector_scores(t), ["query_id"], [F.desc("cosine"), F.asc("vec_id")], 10).select("query_id", "vec_id", "cosine", "rank")


@query(SQL_VECTORS + "SELECT query_id, vec_id, same, cosine, row_number() OVER (PARTITION BY query_id ORDER BY same DESC, cosine DESC, vec_id) AS rank FROM scored QUALIFY rank <= 10")
def objective_filtered_vector_topk(t: Tables) -> DataFrame:
    return R.best(_vector_scores(t), ["query_id"], [F.desc("same"), F.desc("cosine"), F.asc("vec_id")], 10).select("query_id", "vec_id", "same", "cosine", "rank")


@query(SQL_VECTORS + """, n AS (SELECT *, min(cosine) OVER w AS lo, max(cosine) OVER w AS hi FROM scored WINDOW w AS (PARTITION BY query_id)),
    m AS (SELECT query_id, vec_id, round(0.6 * CASE WHEN hi > lo THEN (cosine - lo) / (hi - lo) ELSE 0 END + 0.4 * CAST(same AS DOUBLE), 6) AS score FROM n)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM m QUALIFY rank <= 10""")
def hybrid_topk(t: Tables) -> DataFrame:
    return R.hybrid_topk(_vector_scores(t), 10, 0.6)

"""Queries of the leave-one-out evaluation over the stated queries: groups that a query's own case holds against those that
are said from its neighbours, which never belong to its entity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators import evaluate as E
from casework.operators import retrieve as R
from casework.operators import stats as S
from casework.plans import q_linkage, q_retrieval, q_rules
from casework.plans.registry import query
from casework.sources.tables import Tables

THRESHOLD = 0.15

#: Weights that are compared: of objective, segment, nation, region and balance.
GRID = {
    "delivered": R.WEIGHTS,
    "flat": (0.2, 0.2, 0.2, 0.2, 0.2),
    "no objective": (0.0, 0.3, 0.3, 0.2, 0.2),
    "objective alone": (1.0, 0.0, 0.0, 0.0, 0.0),
    "place": (0.3, 0.1, 0.3, 0.2, 0.1),
    "balance": (0.3, 0.1, 0.1, 0.1, 0.4),
}


def _sets(t: Tables) -> DataFrame:
    return t.named_items.select("case_id", F.col("grp").alias("element")).distinct()


def _held(t: Tables) -> DataFrame:
    queries = q_retrieval.stated_queries(t).select("query_id")
    return _sets(t).join(queries, F.col("case_id") == F.col("query_id")).select("query_id", "element")


H = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
SQL_EVAL = q_retrieval.SQL_NEAR + f"""
, sets AS (SELECT DISTINCT case_id, grp AS element FROM named_items),
held AS (SELECT query_id, element FROM stated JOIN sets ON case_id = query_id), n_held AS (SELECT query_id, count(*) AS n_held FROM held GROUP BY 1),
dealt AS (SELECT case_id, entity_id, objective, {H.format("'floor|' || case_id")} % greatest(1, (SELECT count(*) FROM cases) // 64) AS block FROM cases),
met AS (SELECT s.query_id, d.case_id, {H.format("'floor2|' || s.query_id || '|' || d.case_id")} AS ord, d.objective = s.q_objective AS same FROM (SELECT *, {H.format("'floor3|' || query_id")} % greatest(1, (SELECT count(*) FROM cases) // 64) AS block FROM stated) s JOIN dealt d ON d.block = s.block AND d.entity_id <> s.q_entity_id),
strange AS (SELECT query_id, kind, arg_min(case_id, (ord, case_id)) AS case_id FROM (SELECT query_id, case_id, ord, unnest(['floor', CASE WHEN same THEN 'floor_same' ELSE 'floor_other' END]) AS kind FROM met) GROUP BY 1, 2),
rows_e AS (SELECT n.query_id, n.case_id, n.rank, n.score, s.element, count(*) OVER (PARTITION BY n.query_id, s.element) AS c, k FROM near n JOIN sets s USING (case_id) JOIN (SELECT query_id, count(*) AS k FROM near GROUP BY 1) USING (query_id)),
each AS (SELECT query_id, case_id, round(common / CAST(n_said + n_held - common AS DOUBLE), 6) AS jaccard
    FROM (SELECT r.query_id, r.case_id, count(h.element) AS common, count(*) AS n_said FROM rows_e r LEFT JOIN held h ON h.query_id = r.query_id AND h.element = r.element GROUP BY 1, 2) JOIN n_held USING (query_id)),
top_case AS (SELECT query_id, case_id FROM each QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, case_id) = 1),
said AS (SELECT query_id, 'copy' AS variant, element FROM rows_e WHERE rank = 1
    UNION ALL SELECT DISTINCT query_id, 'composed', element FROM rows_e WHERE round(c / k, 6) >= {THRESHOLD}
    UNION ALL SELECT query_id, 'ceiling', element FROM rows_e JOIN top_case USING (query_id, case_id)
    UNION ALL SELECT query_id, kind, element FROM strange JOIN sets USING (case_id)),
scores AS (SELECT query_id, variant, common, n_said, n_held, round(common / CAST(n_said + n_held - common AS DOUBLE), 6) AS jaccard, round(common / CAST(n_said AS DOUBLE), 6) AS "precision", round(common / CAST(n_held AS DOUBLE), 6) AS recall
    FROM (SELECT s.query_id, s.variant, count(h.element) AS common, count(*) AS n_said FROM said s LEFT JOIN held h ON h.query_id = s.query_id AND h.element = s.element GROUP BY 1, 2) JOIN n_held USING (query_id))
"""


def _scores(t: Tables) -> DataFrame:
    strange = E.strangers(q_retrieval.stated_queries(t), t.headers)
    said = E.variants(q_retrieval.neighbourhood(t), _sets(t), strange, _held(t), THRESHOLD)
    return E.said_against_held(said, _held(t), ["query_id", "variant"])


@query(SQL_EVAL + 'SELECT query_id, variant, common, n_said, n_held, jaccard, "precision", recall FROM scores')
def loo_scores(t: Tables) -> DataFrame:
    return _scores(t)


@query(SQL_EVAL + """SELECT variant, coalesce(q_objective, 'all') AS objective, count(*) AS n, round(avg(jaccard), 5) AS jaccard, round(avg("precision"), 5) AS "precision", round(avg(recall), 5) AS recall
    FROM scores JOIN stated USING (query_id) GROUP BY GROUPING SETS ((variant, q_objective), (variant))""")
def loo_summary(t: Tables) -> DataFrame:
    rows = _scores(t).join(q_retrieval.stated_queries(t).select("query_id", F.col("q_objective").alias("objective")), "query_id")
    out = rows.groupingSets([[F.col("variant"), F.col("objective")], [F.col("variant")]], "variant", "objective").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in ("jaccard", "precision", "recall")]
    )
    return out.withColumn("objective", F.coalesce("objective", F.lit("all")))


SQL_WIDE = SQL_EVAL + """, wide AS (SELECT query_id, max(jaccard) FILTER (WHERE variant = 'floor') AS low, max(jaccard) FILTER (WHERE variant = 'floor_same') AS low_same, max(jaccard) FILTER (WHERE variant = 'floor_other') AS low_other,
    coalesce(max(jaccard) FILTER (WHERE variant = 'composed'), 0) AS system, max(jaccard) FILTER (WHERE variant = 'copy') AS copy, max(jaccard) FILTER (WHERE variant = 'ceiling') AS high FROM scores GROUP BY 1)
"""


def _wide(t: Tables) -> DataFrame:
    """A row per query: what the floors, the nearest case, the system (nothing said counts 0) and the best neighbour reach."""
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col("jaccard")))
    names = {"low": "floor", "low_same": "floor_same", "low_other": "floor_other", "copy": "copy", "high": "ceiling"}
    return _scores(t).groupBy("query_id").agg(*[pick(v).alias(n) for n, v in names.items()], F.coalesce(pick("composed"), F.lit(0.0)).alias("system"))


@query(SQL_WIDE + """SELECT q_objective AS objective, count(*) AS n, round(avg(low), 5) AS floor_, round(avg(low_same), 5) AS floor_same, round(avg(low_other), 5) AS floor_other, round(avg(system), 5) AS system, round(avg(high), 5) AS ceiling
    FROM wide JOIN stated USING (query_id) GROUP BY 1""")
def loo_floor_ceiling(t: Tables) -> DataFrame:
    """By objective: a stranger's case of any, of the same and of another objective, the system, and the best single neighbour."""
    rows = _wide(t).join(q_retrieval.stated_queries(t).select("query_id", F.col("q_objective").alias("objective")), "query_id")
    means = {"floor_": "low", "floor_same": "low_same", "floor_other": "low_other", "system": "system", "ceiling": "high"}
    return rows.groupBy("objective").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(n) for n, c in means.items()])


@query(SQL_WIDE + """SELECT q_objective AS objective, count(*) AS n, round((avg(system) - avg(low_other)) / nullif(avg(high) - avg(low_other), 0), 5) AS over_other, round((avg(system) - avg(low_same)) / nullif(avg(high) - avg(low_same), 0), 5) AS over_same
    FROM wide JOIN stated USING (query_id) WHERE low_same IS NOT NULL AND low_other IS NOT NULL AND high IS NOT NULL GROUP BY 1""")
def normalised_score(t: Tables) -> DataFrame:
    """Where the system stands between a stranger's case (0) and the best single neighbour (1), for both kinds of strangers."""
    rows = _wide(t).dropna(subset=["low_same", "low_other", "high"]).join(q_retrieval.stated_queries(t).select("query_id", F.col("q_objective").alias("objective")), "query_id")
    share = lambda low: F.round((F.avg("system") - F.avg(low)) / F.nullif(F.avg("high") - F.avg(low), F.lit(0.0)), 5)
    return rows.groupBy("objective").agg(F.count("*").alias("n"), share("low_other").alias("over_other"), share("low_same").alias("over_same"))


def _gains(t: Tables) -> DataFrame:
    """The system against the nearest case copied, paired by query."""
    return _wide(t).dropna(subset=["copy"]).withColumn("gain", F.round(F.col("system") - F.col("copy"), 6))


SQL_GAINS = SQL_WIDE + ", gains AS (SELECT query_id, round(system - copy, 6) AS gain FROM wide WHERE copy IS NOT NULL)"
TAIL = "(0.254829592 * t - 0.284496736 * t ** 2 + 1.421413741 * t ** 3 - 1.453152027 * t ** 4 + 1.061405429 * t ** 5) * exp(-z * z / 2)"


@query(SQL_GAINS + f""", s AS (SELECT abs(gain) AS size, count(*) AS c, count(*) FILTER (WHERE gain > 0) AS up FROM gains WHERE gain <> 0 GROUP BY 1),
    r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rank FROM s),
    sums AS (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(up * rank) AS DOUBLE) AS w_plus, CAST(sum((c - up) * rank) AS DOUBLE) AS w_minus, CAST(sum(CAST(c AS DOUBLE) ** 3 - c) AS DOUBLE) AS ties FROM r),
    zs AS (SELECT *, greatest(abs(w_plus - CAST(n AS DOUBLE) * (n + 1) / 4) - 0.5, 0) / nullif(sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * CAST(n AS DOUBLE) + 1) / 24 - ties / 48), 0) AS z FROM sums),
    ts AS (SELECT *, 1 / (1 + 0.3275911 * z / sqrt(2)) AS t FROM zs)
    SELECT n, w_plus, w_minus, round(z, 6) AS z, round({TAIL}, 5) AS p FROM ts""")
def wilcoxon_signed_rank(t: Tables) -> DataFrame:
    """Is the consensus another thing than the nearest case copied? Signed ranks of the paired differences."""
    return S.wilcoxon(_gains(t), F.col("gain"))


WEIGHTS_SQL = "CASE " + " ".join(f"WHEN u >= 0.36787944117144233 * ({' + '.join(f'1 / {math.factorial(i)}.0' for i in range(k))}) THEN {k}" for k in range(8, 0, -1)) + " ELSE 0 END"


@query(SQL_GAINS + f""", drawn AS (SELECT g.*, r.replicate, {H.format("'mean|' || r.replicate || '|' || query_id")} / 4294967296.0 AS u FROM gains g, (SELECT unnest(range(1, 201)) AS replicate) r),
    means AS (SELECT replicate, sum(w * gain) / nullif(sum(w), 0) AS m FROM (SELECT *, {WEIGHTS_SQL} AS w FROM drawn) GROUP BY 1)
    SELECT (SELECT count(*) FROM gains) AS n, (SELECT round(avg(gain), 4) FROM gains) AS mean, (SELECT round(avg(CAST(gain > 0 AS DOUBLE)), 4) FROM gains) AS positive, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM means""")
def paired_bootstrap(t: Tables) -> DataFrame:
    """The same difference's mean with a 95 % interval from 200 resamplings of the queries."""
    found = S.bootstrap_mean(_gains(t).select("query_id", "gain"), "gain", "query_id", replicates=200)
    return found.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "positive", "low", "high")])


@query(SQL_GAINS + """, c AS (SELECT q_objective AS objective, count(*) AS n, count(*) FILTER (WHERE gain > 0) AS wins, count(*) FILTER (WHERE gain < 0) AS losses, avg(gain) AS gain FROM gains JOIN stated USING (query_id) GROUP BY 1)
    SELECT objective, n, wins, losses, round(gain, 5) AS gain, round(least(1, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))) FROM (SELECT unnest(range(0, least(wins, losses) + 1)) AS k))), 5) AS p,
        round(greatest(wins, losses, n - wins - losses) / n, 5) AS majority FROM c""")
def sign_and_mcnemar(t: Tables) -> DataFrame:
    """By objective how often either wins, the exact probability of such a split, and the share of the commonest outcome."""
    rows = _gains(t).join(q_retrieval.stated_queries(t).select("query_id", F.col("q_objective").alias("objective")), "query_id")
    counted = rows.groupBy("objective").agg(F.count("*").alias("n"), F.count_if(F.col("gain") > 0).alias("wins"), F.count_if(F.col("gain") < 0).alias("losses"), F.round(F.avg("gain"), 5).alias("gain"))
    majority = F.greatest("wins", "losses", F.col("n") - F.col("wins") - F.col("losses")) / F.col("n")
    return counted.select("objective", "n", "wins", "losses", "gain", F.round(S.binomial_two_sided(F.col("wins"), F.col("losses")), 5).alias("p"), F.round(majority, 5).alias("majority"))


@query(SQL_EVAL + """, grid AS (SELECT k_max, least FROM (VALUES (5), (10), (20)) a(k_max), (VALUES (0.1), (0.15), (0.2)) b(least)),
    counts AS (SELECT g.k_max, g.least, r.query_id, r.element, count(*) AS c FROM rows_e r, grid g WHERE r.rank <= g.k_max GROUP BY 1, 2, 3, 4),
    kept AS (SELECT * FROM counts JOIN (SELECT DISTINCT query_id, k FROM rows_e) USING (query_id) WHERE round(c / CAST(least(k, k_max) AS DOUBLE), 6) >= least),
    s AS (SELECT p.k_max, p.least, p.query_id, count(h.element) AS common, count(*) AS n_said FROM kept p LEFT JOIN held h ON h.query_id = p.query_id AND h.element = p.element GROUP BY 1, 2, 3)
    SELECT k_max, CAST(least AS DOUBLE) AS least, count(*) AS n, round(avg(round(common / CAST(n_said + n_held - common AS DOUBLE), 6)), 5) AS jaccard FROM s JOIN n_held USING (query_id) GROUP BY 1, 2""")
def grid_search(t: Tables) -> DataFrame:
    """Mean Jaccard of the consensus for several sizes of neighbourhood and thresholds; neighbours are found once, for the largest."""
    grid = t.spark.createDataFrame([(k, x) for k in (5, 10, 20) for x in (0.1, 0.15, 0.2)], "k_max int, least double")
    near = q_retrieval.neighbourhood(t).select("query_id", "case_id", "rank")
    k = near.groupBy("query_id").agg(F.count("*").alias("k"))
    rows = near.join(_sets(t), "case_id").join(k, "query_id").join(F.broadcast(grid), F.col("rank") <= F.col("k_max"))
    said = E.composed(rows, ["k_max", "least", "query_id"], F.count("*") / F.max(F.least("k", "k_max")), F.col("least"))
    scored = E.said_against_held(said, _held(t), ["k_max", "least", "query_id"])
    return scored.groupBy("k_max", "least").agg(F.count("*").alias("n"), F.round(F.avg("jaccard"), 5).alias("jaccard"))


@query(SQL_EVAL + """, powers AS (SELECT CAST(p AS DOUBLE) AS power FROM (VALUES (0), (1), (2), (4)) v(p)),
    weighted AS (SELECT n.query_id, n.case_id, p.power, round(power(greatest(1e-6, coalesce(score / nullif(max(score) OVER (PARTITION BY n.query_id), 0), 0)), p.power), 6) AS weight FROM near n, powers p),
    total AS (SELECT query_id, power, sum(weight) AS total FROM weighted GROUP BY 1, 2),
    kept AS (SELECT w.query_id, w.power, s.element FROM weighted w JOIN sets s USING (case_id) JOIN total USING (query_id, power) GROUP BY 1, 2, 3 HAVING round(sum(weight) / max(total), 6) >= 0.15),
    s AS (SELECT p.power, p.query_id, count(h.element) AS common, count(*) AS n_said FROM kept p LEFT JOIN held h ON h.query_id = p.query_id AND h.element = p.element GROUP BY 1, 2)
    SELECT power, count(*) AS n, round(avg(round(common / CAST(n_said + n_held - common AS DOUBLE), 6)), 4) AS jaccard FROM s JOIN n_held USING (query_id) GROUP BY 1""")
def power_sweep(t: Tables) -> DataFrame:
    """Mean Jaccard of the consensus when neighbours vote with their score to several powers."""
    rows = None
    for power in (0, 1, 2, 4):
        part = R.vote_weights(q_retrieval.neighbourhood(t), power).select("query_id", "case_id", F.lit(float(power)).alias("power"), "weight")
        rows = part if rows is None else rows.unionByName(part)
    total = rows.groupBy("query_id", "power").agg(F.sum("weight").alias("total"))
    said = E.composed(rows.join(total, ["query_id", "power"]).join(_sets(t), "case_id"), ["power", "query_id"], F.sum("weight") / F.max("total"), F.lit(THRESHOLD))
    scored = E.said_against_held(said, _held(t), ["power", "query_id"])
    return scored.groupBy("power").agg(F.count("*").alias("n"), F.round(F.avg("jaccard"), 4).alias("jaccard"))


SQL_FREE = q_retrieval.SQL_POOL + q_linkage.SQL_SETS + """
, twin AS (SELECT a AS query_id, b AS case_id FROM alike UNION ALL SELECT b, a FROM alike),
free AS (SELECT p.query_id, p.case_id, p.entity_id, p.same, p.score, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank) AS rank
    FROM pool p LEFT JOIN twin t ON t.query_id = p.query_id AND t.case_id = p.case_id WHERE t.case_id IS NULL)
"""


def _twins(t: Tables) -> DataFrame:
    """Near-duplicates of the stated queries' own cases, written once: pairs of two other cases say nothing about a query."""
    asked = q_retrieval.stated_queries(t).select(F.col("query_id").alias("case_id"))
    return t.once("twins", lambda: q_linkage._alike(t, asked).select("a", "b"))


@query(SQL_FREE + """, staged AS (SELECT *, CASE WHEN NOT same THEN 2 WHEN row_number() OVER (PARTITION BY query_id, entity_id, same ORDER BY rank) = 1 THEN 0 ELSE 1 END AS stage FROM free)
    SELECT query_id, case_id, entity_id, score, stage, row_number() OVER (PARTITION BY query_id ORDER BY stage, r) AS rank FROM (SELECT query_id, case_id, entity_id, score, stage, rank AS r FROM staged)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY stage, r) <= 20""")
def loo_retrieval(t: Tables) -> DataFrame:
    """The neighbourhood of every stated query without its own entity and without near-duplicates of its own case."""
    free = E.without_twins(q_retrieval.pool(t), _twins(t))
    return R.diverse_neighbourhood(free, q_retrieval.K).select("query_id", "case_id", "entity_id", "score", "stage", "rank")


@query(SQL_FREE + """, sets_e AS (SELECT DISTINCT case_id, grp AS element FROM named_items), held AS (SELECT query_id, element FROM stated JOIN sets_e ON case_id = query_id), n_held AS (SELECT query_id, count(*) AS n_held FROM held GROUP BY 1),
    tops AS (SELECT query_id, case_id, 'all' AS arm FROM pool WHERE rank = 1 UNION ALL SELECT query_id, case_id, 'free' FROM free WHERE rank = 1),
    s AS (SELECT t.query_id, t.arm, round(count(h.element) / CAST(count(*) + max(n_held) - count(h.element) AS DOUBLE), 6) AS jaccard FROM tops t JOIN sets_e x USING (case_id) LEFT JOIN held h ON h.query_id = t.query_id AND h.element = x.element JOIN n_held n ON n.query_id = t.query_id GROUP BY 1, 2),
    w AS (SELECT query_id, max(jaccard) FILTER (WHERE arm = 'all') AS with_twins, max(jaccard) FILTER (WHERE arm = 'free') AS without_twins FROM s GROUP BY 1),
    e AS (SELECT w.*, query_id IN (SELECT query_id FROM twin) AS exposed FROM w WHERE with_twins IS NOT NULL AND without_twins IS NOT NULL),
    scopes AS (SELECT 'all' AS scope, * FROM e UNION ALL SELECT 'exposed', * FROM e WHERE exposed)
    SELECT scope, count(*) AS n, round(avg(with_twins), 5) AS with_twins, round(avg(without_twins), 5) AS without_twins, round(avg(with_twins - without_twins), 5) AS effect,
        round(1.96 * stddev_samp(with_twins - without_twins) / sqrt(count(*)), 4) AS half_width FROM scopes GROUP BY 1""")
def leak_effect(t: Tables) -> DataFrame:
    """How much better the nearest case looks when near-duplicates of the query's case may be it: all queries, and those that
    have one; the half width is that of a 95 % interval of the mean paired difference."""
    twins = _twins(t)
    pool = q_retrieval.pool(t)
    tops = pool.filter("rank = 1").select("query_id", "case_id", F.lit("all").alias("arm")).unionByName(
        E.without_twins(pool, twins).filter("rank = 1").select("query_id", "case_id", F.lit("free").alias("arm"))
    )
    scored = E.said_against_held(tops.join(_sets(t), "case_id").select("query_id", "arm", "element"), _held(t), ["query_id", "arm"])
    wide = scored.groupBy("query_id").agg(*[F.max(F.when(F.col("arm") == a, F.col("jaccard"))).alias(n) for a, n in (("all", "with_twins"), ("free", "without_twins"))]).dropna()
    exposed = twins.select(F.explode(F.array("a", "b")).alias("query_id")).distinct()
    scopes = wide.withColumn("scope", F.lit("all")).unionByName(wide.join(exposed, "query_id", "left_semi").withColumn("scope", F.lit("exposed")))
    gain = F.col("with_twins") - F.col("without_twins")
    return scopes.groupBy("scope").agg(
        F.count("*").alias("n"), F.round(F.avg("with_twins"), 5).alias("with_twins"), F.round(F.avg("without_twins"), 5).alias("without_twins"), F.round(F.avg(gain), 5).alias("effect"), F.round(F.lit(1.96) * F.stddev_samp(gain) / F.sqrt(F.count("*")), 4).alias("half_width")
    )


STRANGE = f"""dealt AS (SELECT case_id, entity_id, {H.format("'floor|' || case_id")} % greatest(1, (SELECT count(*) FROM cases) // 64) AS block FROM cases),
    strange AS (SELECT s.query_id, arg_min(d.case_id, ({H.format("'floor2|' || s.query_id || '|' || d.case_id")}, d.case_id)) AS case_id FROM (SELECT *, {H.format("'floor3|' || query_id")} % greatest(1, (SELECT count(*) FROM cases) // 64) AS block FROM stated) s JOIN dealt d ON d.block = s.block AND d.entity_id <> s.q_entity_id GROUP BY 1)"""


@query(q_retrieval.SQL_QUERIES + q_rules.SQL_RULES + """, """ + STRANGE + """
    SELECT o.rule, count(*) AS n, round(avg(CAST(o.satisfied AS DOUBLE)), 5) AS own, round(avg(CAST(f.satisfied AS DOUBLE)), 5) AS stranger, round(avg(CAST(o.satisfied AS DOUBLE)) - avg(CAST(f.satisfied AS DOUBLE)), 5) AS gap
    FROM strange x JOIN evaluated o ON o.case_id = x.query_id JOIN evaluated f ON f.case_id = x.case_id AND f.rule = o.rule WHERE o.satisfied IS NOT NULL AND f.satisfied IS NOT NULL AND o.rule IN ('no_promo_in_af', 'much_needs_standard') GROUP BY 1""")
def rule_compliance_floor(t: Tables) -> DataFrame:
    """Conditional rules in the queries' own cases against a stranger's, where both can be judged."""
    judged = q_rules._evaluated(t).filter("satisfied IS NOT NULL AND rule IN ('no_promo_in_af', 'much_needs_standard')").withColumn("held", F.col("satisfied").cast("double"))
    pairs = E.strangers(q_retrieval.stated_queries(t), t.headers).filter("kind = 'any'").drop("kind")
    own = judged.select(F.col("case_id").alias("query_id"), "rule", F.col("held").alias("o"))
    rows = pairs.join(own, "query_id").join(judged.select("case_id", "rule", F.col("held").alias("s")), ["case_id", "rule"])
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("o"), 5).alias("own"), F.round(F.avg("s"), 5).alias("stranger"), F.round(F.avg("o") - F.avg("s"), 5).alias("gap"))


JACCARD = "round(common / CAST(n_said + n_held - common AS DOUBLE), 6)"
SQL_ARMS = f"""
, arm_rows AS (SELECT a.arm, a.query_id, a.rank, s.element, count(DISTINCT a.case_id) OVER (PARTITION BY a.arm, a.query_id) AS seen, k FROM arms_ a JOIN sets s USING (case_id) JOIN (SELECT arm, query_id, count(*) AS k FROM arms_ GROUP BY 1, 2 HAVING count(*) >= 3) USING (arm, query_id)),
arm_said AS (SELECT arm, query_id, 'composed' AS variant, element FROM arm_rows GROUP BY 1, 2, 4 HAVING round(count(*) / max(k), 6) >= {THRESHOLD} UNION ALL SELECT arm, query_id, 'copied', element FROM arm_rows WHERE rank = 1),
arm_each AS (SELECT arm, query_id, variant, {JACCARD} AS j FROM (SELECT s.arm, s.query_id, s.variant, count(h.element) AS common, count(*) AS n_said FROM arm_said s LEFT JOIN held h ON h.query_id = s.query_id AND h.element = s.element GROUP BY 1, 2, 3) JOIN n_held USING (query_id)),
arm_scores AS (SELECT k.arm, k.query_id, coalesce(max(j) FILTER (WHERE variant = 'composed'), 0) AS composed, coalesce(max(j) FILTER (WHERE variant = 'copied'), 0) AS copied
    FROM (SELECT arm, query_id FROM arms_ GROUP BY 1, 2 HAVING count(*) >= 3) k JOIN n_held USING (query_id) LEFT JOIN arm_each e ON e.arm = k.arm AND e.query_id = k.query_id GROUP BY 1, 2)
"""
SQL_SETS_HELD = ", sets AS (SELECT DISTINCT case_id, grp AS element FROM named_items), held AS (SELECT query_id, element FROM stated JOIN sets ON case_id = query_id), n_held AS (SELECT query_id, count(*) AS n_held FROM held GROUP BY 1)"
SQL_GRID = " UNION ALL ".join(f"SELECT '{name}' AS arm, query_id, case_id, entity_id, objective = q_objective AS same, {q_retrieval.score_sql(w)} AS score FROM candidates JOIN stated ON entity_id <> q_entity_id" for name, w in GRID.items())


@query(q_retrieval.SQL_QUERIES + SQL_SETS_HELD + f""", grid_pool AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY score DESC, case_id) AS pr FROM ({SQL_GRID}) QUALIFY pr <= {q_retrieval.POOL}),
    grid_staged AS (SELECT *, CASE WHEN NOT same THEN 2 WHEN row_number() OVER (PARTITION BY arm, query_id, entity_id, same ORDER BY pr) = 1 THEN 0 ELSE 1 END AS stage FROM grid_pool),
    arms_ AS (SELECT arm, query_id, case_id, row_number() OVER (PARTITION BY arm, query_id ORDER BY stage, pr) AS rank FROM grid_staged QUALIFY rank <= {q_retrieval.K})
    """ + SQL_ARMS + f""", grid_means AS (SELECT arm AS weights, CASE WHEN {H.format("'half|' || q_entity_id")} % 10 < 6 THEN 'dev' ELSE 'holdout' END AS half, count(*) AS n, round(avg(composed), 5) AS composed, round(avg(copied), 5) AS copied FROM arm_scores JOIN stated USING (query_id) GROUP BY 1, 2)
    SELECT *, coalesce(weights = (SELECT weights FROM grid_means WHERE half = 'dev' ORDER BY composed DESC, weights LIMIT 1), false) AS chosen FROM grid_means""")
def weight_sweep(t: Tables) -> DataFrame:
    """Each of several weightings of the traits by the consensus of the neighbourhood it retrieves, on a development and a
    held-out part of the entities; ``chosen`` is the best of the development part."""
    asked = q_retrieval.stated_queries(t)
    near = None
    for name, weights in E.distinct_grid(GRID).items():
        found = t.once(f"near {name}", lambda w=weights: R.diverse_neighbourhood(R.attribute_pool(asked, q_retrieval.known_cases(t), q_retrieval.POOL, weights=w), q_retrieval.K).select("query_id", "case_id", "rank"))
        part = found.withColumn("weights", F.lit(name))
        near = part if near is None else near.unionByName(part)
    scores = E.arms(near, _sets(t), _held(t), THRESHOLD, by="weights", least=3)
    return E.sweep_table(scores, asked.select("query_id", E.half_of(F.col("q_entity_id")).alias("half")))


@query(q_retrieval.SQL_NEAR + SQL_SETS_HELD + f""", firsts AS (SELECT query_id, case_id, same, rank AS pr FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY rank) = 1),
    firsts_same AS (SELECT query_id, case_id, rank AS pr FROM pool WHERE same QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY rank) = 1),
    arms_ AS (SELECT 'delivered' AS arm, query_id, case_id, rank FROM near UNION ALL SELECT 'nearest', query_id, case_id, rank FROM pool WHERE rank <= {q_retrieval.K}
        UNION ALL SELECT 'one per entity', query_id, case_id, row_number() OVER (PARTITION BY query_id ORDER BY pr) AS rank FROM firsts QUALIFY rank <= {q_retrieval.K}
        UNION ALL SELECT 'same objective', query_id, case_id, row_number() OVER (PARTITION BY query_id ORDER BY pr) AS rank FROM firsts_same QUALIFY rank <= {q_retrieval.K}
        UNION ALL (SELECT 'degraded', query_id, case_id, rank FROM near QUALIFY rank <= CASE WHEN avg(CAST(same AS DOUBLE)) OVER (PARTITION BY query_id) = 0 THEN 1 WHEN avg(CAST(same AS DOUBLE)) OVER (PARTITION BY query_id) < 0.9 THEN 5 ELSE 1000000 END))
    """ + SQL_ARMS + """SELECT a.arm, count(*) AS n, round(avg(a.composed), 5) AS mean, round(avg(round(a.composed - b.composed, 6)), 5) AS difference, count(*) FILTER (WHERE round(a.composed - b.composed, 6) > 0) AS wins, count(*) FILTER (WHERE round(a.composed - b.composed, 6) < 0) AS losses
    FROM arm_scores a JOIN arm_scores b ON b.query_id = a.query_id AND b.arm = 'delivered' GROUP BY 1""")
def loo_ablation(t: Tables) -> DataFrame:
    """What each step of choosing neighbours is worth: the consensus of other neighbourhoods against the delivered one, paired by query."""
    near, pool = q_retrieval.neighbourhood(t), q_retrieval.pool(t)
    parts = {
        "delivered": near, "nearest": pool.filter(F.col("rank") <= q_retrieval.K), "one per entity": R.one_per_entity(pool, q_retrieval.K),
        "same objective": R.one_per_entity(pool, q_retrieval.K, same_only=True), "degraded": R.degrade(near, least_purity=0.9, k_small=5),
    }
    every = None
    for name, part in parts.items():
        part = part.select("query_id", "case_id", "rank", F.lit(name).alias("arm"))
        every = part if every is None else every.unionByName(part)
    return E.against_arm(E.arms(every, _sets(t), _held(t), THRESHOLD, least=3), "delivered")


@query(SQL_EVAL + f""", slot_sets AS (SELECT DISTINCT case_id, slot, grp AS element FROM named_items), held_s AS (SELECT query_id, slot, element FROM stated JOIN slot_sets ON case_id = query_id), n_held_s AS (SELECT query_id, slot, count(*) AS n_held FROM held_s GROUP BY 1, 2),
    slot_rows AS (SELECT n.query_id, n.rank, s.slot, s.element, k FROM near n JOIN slot_sets s USING (case_id) JOIN (SELECT query_id, count(*) AS k FROM near GROUP BY 1) USING (query_id)),
    slot_said AS (SELECT query_id, 'composed' AS variant, slot, element FROM slot_rows GROUP BY 1, 3, 4 HAVING round(count(*) / max(k), 6) >= {THRESHOLD} UNION ALL SELECT query_id, 'copy', slot, element FROM slot_rows WHERE rank = 1
        UNION ALL SELECT query_id, 'ceiling', slot, element FROM top_case JOIN slot_sets USING (case_id)),
    slot_scores AS (SELECT query_id, slot, variant, {JACCARD} AS j FROM (SELECT s.query_id, s.slot, s.variant, count(h.element) AS common, count(*) AS n_said FROM slot_said s LEFT JOIN held_s h ON h.query_id = s.query_id AND h.slot = s.slot AND h.element = s.element GROUP BY 1, 2, 3) JOIN n_held_s USING (query_id, slot))
    SELECT v.variant, h.slot, count(*) AS n, round(count(j) / count(*), 5) AS present, round(avg(coalesce(j, 0)), 5) AS jaccard FROM n_held_s h CROSS JOIN (VALUES ('composed'), ('copy'), ('ceiling')) v(variant)
        LEFT JOIN slot_scores s ON s.query_id = h.query_id AND s.slot = h.slot AND s.variant = v.variant GROUP BY 1, 2""")
def loo_per_slot(t: Tables) -> DataFrame:
    """The consensus, the nearest case copied and the best single neighbour, slot by slot."""
    sets = t.named_items.select("case_id", "slot", F.col("grp").alias("element")).distinct()
    near = q_retrieval.neighbourhood(t).select("query_id", "case_id", "rank")
    rows = near.join(near.groupBy("query_id").agg(F.count("*").alias("k")), "query_id").join(sets, "case_id")
    each = E.said_against_held(near.join(_sets(t), "case_id").select("query_id", "case_id", "element"), _held(t), ["query_id", "case_id"])
    best = each.groupBy("query_id").agg(F.min_by("case_id", F.struct(-F.col("jaccard"), "case_id")).alias("case_id"))
    parts = {
        "composed": E.composed(rows, ["query_id", "slot"], F.count("*") / F.max("k"), F.lit(THRESHOLD)),
        "copy": rows.filter("rank = 1"),
        "ceiling": best.join(sets, "case_id"),
    }
    said = None
    for name, part in parts.items():
        part = part.select("query_id", "slot", "element", F.lit(name).alias("variant"))
        said = part if said is None else said.unionByName(part)
    held = sets.join(q_retrieval.stated_queries(t).select("query_id"), F.col("case_id") == F.col("query_id")).select("query_id", "slot", "element")
    return E.per_slot(said, held)


@query(SQL_WIDE + """SELECT row_number() OVER (ORDER BY system, query_id) AS place, query_id, q_objective AS objective, system, copy, high, n_held FROM wide JOIN stated USING (query_id) JOIN n_held USING (query_id) QUALIFY place <= 20""")
def loo_worst(t: Tables) -> DataFrame:
    """The twenty queries that the consensus serves worst (a report), with what the nearest case and the best neighbour reach there."""
    sizes = _held(t).groupBy("query_id").agg(F.count("*").alias("n_held"))
    rows = _wide(t).join(q_retrieval.stated_queries(t).select("query_id", F.col("q_objective").alias("objective")), "query_id").join(sizes, "query_id")
    least = rows.orderBy("system", "query_id").limit(20)
    return R.best(least.withColumn("report", F.lit(1)), ["report"], [F.asc("system"), F.asc("query_id")], 20, "place").select("place", "query_id", "objective", "system", "copy", "high", "n_held")


@query(q_retrieval.SQL_NEAR + SQL_SETS_HELD + f""", earlier AS (SELECT q.case_id AS query_id, e.case_id, q.version - e.version AS back, e.objective <> q.objective AS changed FROM cases q JOIN stated s ON s.query_id = q.case_id JOIN cases e ON e.entity_id = q.entity_id AND e.version < q.version AND e.version >= q.version - {q_retrieval.K}),
    previous AS (SELECT query_id, case_id, changed FROM earlier WHERE back = 1),
    own AS (SELECT e.query_id, e.case_id, {q_retrieval.score_sql()} AS score FROM earlier e JOIN candidates USING (case_id) JOIN stated s ON s.query_id = e.query_id),
    mixed AS (SELECT query_id, case_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM (SELECT query_id, case_id, score FROM pool UNION ALL SELECT query_id, case_id, score FROM own) QUALIFY rank <= {q_retrieval.K}),
    had AS (SELECT query_id, element FROM previous JOIN sets USING (case_id)),
    agreed AS (SELECT m.query_id, s.element FROM mixed m JOIN sets s USING (case_id) JOIN (SELECT query_id, count(*) AS k FROM mixed GROUP BY 1) USING (query_id) WHERE query_id IN (SELECT query_id FROM previous) GROUP BY 1, 2 HAVING round(count(*) / max(k), 6) >= {THRESHOLD}),
    cold AS (SELECT n.query_id, s.element FROM near n JOIN sets s USING (case_id) JOIN (SELECT query_id, count(*) AS k FROM near GROUP BY 1) USING (query_id) WHERE query_id IN (SELECT query_id FROM previous) GROUP BY 1, 2 HAVING round(count(*) / max(k), 6) >= {THRESHOLD}),
    renewed AS (SELECT * FROM agreed UNION SELECT h.query_id, h.element FROM had h WHERE EXISTS (SELECT 1 FROM mixed m JOIN sets s USING (case_id) WHERE m.query_id = h.query_id AND s.element = h.element AND NOT EXISTS (SELECT 1 FROM previous p WHERE p.query_id = m.query_id AND p.case_id = m.case_id))),
    spoken AS (SELECT 'copy_previous' AS variant, * FROM had UNION ALL SELECT 'cold', * FROM cold UNION ALL SELECT 'history', * FROM agreed UNION ALL SELECT 'renewed', * FROM renewed
        UNION ALL SELECT 'routed', r.* FROM renewed r WHERE query_id IN (SELECT query_id FROM previous WHERE NOT changed) UNION ALL SELECT 'routed', a.* FROM agreed a WHERE query_id IN (SELECT query_id FROM previous WHERE changed)),
    n_had AS (SELECT query_id, count(*) AS n_had FROM had GROUP BY 1),
    each_ AS (SELECT s.variant, s.query_id, count(*) AS n_said, count(h.element) AS common, count(p.element) AS again FROM spoken s LEFT JOIN held h ON h.query_id = s.query_id AND h.element = s.element LEFT JOIN had p ON p.query_id = s.query_id AND p.element = s.element GROUP BY 1, 2),
    judged AS (SELECT v.variant, p.changed, coalesce({JACCARD}, 0) AS jaccard, coalesce(round(again / CAST(n_said + n_had - again AS DOUBLE), 6), 0) AS novelty, coalesce(round(n_said / CAST(n_held AS DOUBLE), 6), 0) AS size
        FROM previous p JOIN n_held USING (query_id) JOIN n_had USING (query_id) CROSS JOIN (SELECT DISTINCT variant FROM spoken) v LEFT JOIN each_ e ON e.query_id = p.query_id AND e.variant = v.variant)
    SELECT variant, coalesce(CAST(changed AS VARCHAR), 'all') AS changed, count(*) AS n, round(avg(jaccard), 5) AS jaccard, round(avg(novelty), 5) AS novelty, round(avg(size), 5) AS size FROM judged GROUP BY GROUPING SETS ((variant, changed), (variant))""")
def loo_recurrent(t: Tables) -> DataFrame:
    """Entities that come back: the next version foretold from the previous one, from others, from both, and by route. ``novelty`` is
    the Jaccard with the previous version; that of ``copy_previous`` with the truth is what people renew."""
    asked = q_retrieval.stated_queries(t)
    history = t.once("history", lambda: E.own_history(t.cases, asked, q_retrieval.K))
    goals = t.headers.select("case_id", "objective")
    before = history.filter("back = 1").join(goals, "case_id").join(asked.select("query_id", "q_objective"), "query_id")
    previous = t.once("previous", lambda: before.select("query_id", "case_id", (F.col("objective") != F.col("q_objective")).alias("changed")))
    own = history.join(q_retrieval.candidates(t), "case_id").join(asked, "query_id").select("query_id", "case_id", R.attribute_score().alias("score"))
    both = q_retrieval.pool(t).select("query_id", "case_id", "score").unionByName(own)
    mixed = t.once("mixed", lambda: R.best(both, ["query_id"], [F.desc("score"), F.asc("case_id")], q_retrieval.K).select("query_id", "case_id"))
    said = E.recurrent_variants(q_retrieval.neighbourhood(t), mixed, previous, _sets(t), THRESHOLD)
    had = previous.join(_sets(t), "case_id").select("query_id", "element")
    true, again = (E.said_against_held(said, other, ["query_id", "variant"]) for other in (_held(t), had))
    both_held = previous.select("query_id", "changed").join(_held(t).select("query_id").distinct(), "query_id").join(had.select("query_id").distinct(), "query_id")
    rows = both_held.crossJoin(F.broadcast(said.select("variant").distinct()))
    rows = rows.join(true.select("query_id", "variant", "jaccard", F.round(F.col("n_said") / F.col("n_held"), 6).alias("size")), ["query_id", "variant"], "left")
    rows = rows.join(again.select("query_id", "variant", F.col("jaccard").alias("novelty")), ["query_id", "variant"], "left")
    out = rows.fillna(0.0, ["jaccard", "size", "novelty"]).groupingSets([[F.col("variant"), F.col("changed")], [F.col("variant")]], "variant", "changed").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in ("jaccard", "novelty", "size")]
    )
    return out.withColumn("changed", F.coalesce(F.col("changed").cast("string"), F.lit("all")))

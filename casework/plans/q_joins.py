"""Queries of ingestion checks, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from casework.operators import joins as J
from casework.operators import quality as Q
from casework.operators.retrieve import best
from casework.operators.models import sampled_pairs
from casework.plans.registry import query
from casework.sources.tables import Tables, read_corpus


@query("SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def read_corpus_events(t: Tables) -> DataFrame:
    rows = read_corpus(t.spark, f"{t.folder}/events.parquet", T.StructType())
    return rows.select("event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint")["k"].alias("k"))


CUSTOMER = {"c_custkey": ("bigint", True), "c_name": ("string", True), "c_nationkey": ("int", True), "c_acctbal": ("double", False), "c_segment": ("string", True)}


@query("SELECT 'c_segment' AS \"column\", 'missing' AS problem, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'c_name', 'null', count(*) FROM customer WHERE c_name IS NULL HAVING count(*) > 0")
def schema_conformance(t: Tables) -> DataFrame:
    return Q.schema_conformance(t.customer, CUSTOMER)


@query("""SELECT 'items without case' AS "check", count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'cases without entity', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'items without product', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'repeated case', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
    UNION ALL SELECT 'repeated line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def integrity_report(t: Tables) -> DataFrame:
    parts = [
        Q.orphans(t.lineitem, t.orders, ["l_orderkey"], ["o_orderkey"], "items without case"),
        Q.orphans(t.orders, t.customer, ["o_custkey"], ["c_custkey"], "cases without entity"),
        Q.orphans(t.lineitem, t.part, ["l_partkey"], ["p_partkey"], "items without product"),
        Q.duplicates(t.orders, ["o_orderkey"], "repeated case"),
        Q.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], "repeated line"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS load FROM customer""")
def latest_wins_merge(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    newer = rows.filter("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return Q.latest_wins_merge([rows, newer], "c_custkey").select("c_custkey", "c_name", "c_acctbal", "load")


@query("""SELECT event_id, entity_id, marker, day(ts) % 7 AS weekday FROM series s
    WHERE CAST(ts AS DATE) >= DATE '2024-01-15' AND NOT EXISTS (SELECT 1 FROM series o WHERE CAST(o.ts AS DATE) < DATE '2024-01-15' AND o.entity_id = s.entity_id AND o.marker = s.marker AND day(o.ts) % 7 = day(s.ts) % 7)
    QUALIFY row_number() OVER (PARTITION BY entity_id, marker, day(ts) % 7 ORDER BY event_id) = 1""")
def idempotent_append(t: Tables) -> DataFrame:
    """The second half of the month appended to the first: one reading of each entity, marker and day of seven, none twice."""
    day = F.to_date("ts")
    rows = t.series.select("event_id", "entity_id", "marker", day.alias("day"), (F.dayofmonth("ts") % 7).alias("weekday"))
    old, new = rows.filter("day < DATE '2024-01-15'"), rows.filter("day >= DATE '2024-01-15'")
    return Q.idempotent_append(old, new, ["entity_id", "marker", "weekday"], [F.asc("event_id")]).select("event_id", "entity_id", "marker", "weekday")


@query("""SELECT event_id, entity_id, lower(marker) AS marker, CAST(series.ts AS DATE) AS day, CASE WHEN series.value = 0 THEN NULL ELSE series.value END AS value,
        TRY_CAST(json_extract_string(e.props, '$.k') AS DOUBLE) AS extra
    FROM series JOIN events e USING (event_id) WHERE entity_id IN (SELECT c_custkey FROM customer)""")
def reading_normalise(t: Tables) -> DataFrame:
    known = t.customer.select(F.col("c_custkey").alias("user_id"))
    rows = t.events.join(known, "user_id", "left_semi")
    return rows.select(
        "event_id",
        F.col("user_id").alias("entity_id"),
        F.lower("event_type").alias("marker"),
        F.to_date("ts").alias("day"),
        F.nullif(F.col("value"), F.lit(0.0)).alias("value"),
        F.get_json_object("props", "$.k").try_cast("double").alias("extra"),
    )


@query("SELECT objective, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT objective, count(*) AS n FROM cases GROUP BY 1) WHERE n >= 10")
def min_cell_shares(t: Tables) -> DataFrame:
    return Q.share_cells(t.headers, "objective", 10)


@query("""SELECT family, unit, count(quantity) AS n, round(avg(quantity), 6) AS mean, round(stddev_pop(quantity), 6) AS sd,
        round(quantile_cont(CAST(quantity AS DOUBLE), 0.05), 6) AS p05, round(quantile_cont(CAST(quantity AS DOUBLE), 0.5), 6) AS p50,
        round(quantile_cont(CAST(quantity AS DOUBLE), 0.95), 6) AS p95, min(quantity) AS low, max(quantity) AS high
    FROM named_items GROUP BY 1, 2 HAVING count(quantity) >= 10""")
def spread_profile(t: Tables) -> DataFrame:
    return Q.spread_profile(t.named_items, ["family", "unit"], "quantity")


@query("""SELECT metric, key, value FROM (
      SELECT 'objective' AS metric, objective AS key, CAST(count(*) AS DOUBLE) AS value FROM cases GROUP BY 2
      UNION ALL SELECT 'slots per case', CAST(n AS VARCHAR), CAST(count(*) AS DOUBLE) FROM (SELECT count(DISTINCT slot) AS n FROM items GROUP BY case_id) GROUP BY 2
      UNION ALL SELECT 'items per slot', slot, round(avg(n), 6) FROM (SELECT slot, count(*) AS n FROM items GROUP BY case_id, slot) GROUP BY 2
      UNION ALL SELECT 'segment', segment, CAST(count(*) AS DOUBLE) FROM profiles GROUP BY 2
      UNION ALL SELECT 'marker', marker, CAST(count(*) AS DOUBLE) FROM series GROUP BY 2)""")
def corpus_parameter_tables(t: Tables) -> DataFrame:
    def table(df: DataFrame, metric: str, key: str, value) -> DataFrame:
        return df.groupBy(F.col(key).cast("string").alias("key")).agg(value.cast("double").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")

    n = F.count("*")
    slots = t.items.groupBy("case_id").agg(F.count_distinct("slot").alias("n"))
    per_slot = t.items.groupBy("case_id", "slot").agg(n.alias("n"))
    out = table(t.headers, "objective", "objective", n)
    for part in (table(slots, "slots per case", "n", n), table(per_slot, "items per slot", "slot", F.round(F.avg("n"), 6)), table(t.profiles, "segment", "segment", n), table(t.series, "marker", "marker", n)):
        out = out.unionByName(part)
    return out


@query("SELECT 'c_name' AS \"column\", count(*) FILTER (WHERE regexp_matches(c_name, '#[0-9]{9}')) AS n_hits FROM customer UNION ALL SELECT 'c_mktsegment', count(*) FILTER (WHERE regexp_matches(c_mktsegment, '#[0-9]{9}')) FROM customer")
def publication_guard(t: Tables) -> DataFrame:
    return Q.publication_guard(t.customer, ["c_custkey", "c_name", "c_mktsegment"], "#[0-9]{9}")


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'removed' WHEN lang = 'fr' THEN 'added' ELSE 'changed' END AS state FROM documents
    WHERE lang IN ('de', 'fr') OR sha256(coalesce(text, '')) <> sha256(trim(coalesce(replace(text, '  ', ' '), '')))""")
def content_manifest_diff(t: Tables) -> DataFrame:
    old = t.documents.filter("lang <> 'fr' OR lang IS NULL").select("doc_id", "text")
    new = t.documents.filter("lang <> 'de' OR lang IS NULL").select("doc_id", F.trim(F.replace("text", F.lit("  "), F.lit(" "))).alias("text"))
    return Q.manifest_diff(old, new, "doc_id", "text")


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '(/[A-Za-z0-9_.-]+){2,}', '<path>', 'g')) AS n_chars FROM documents")
def path_scrub(t: Tables) -> DataFrame:
    scrubbed = F.regexp_replace(F.coalesce("text", F.lit("")), r"(/[A-Za-z0-9_.-]+){2,}", "<path>")
    return t.documents.select("doc_id", F.length(scrubbed).cast("long").alias("n_chars"))


# Filters.
@query("SELECT case_id, entity_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM items WHERE quantity >= 50)")
def exclude_ids(t: Tables) -> DataFrame:
    return t.headers.select("case_id", "entity_id").join(t.items.filter("quantity >= 50").select("case_id"), "case_id", "left_anti")


@query("""SELECT case_id, objective FROM cases LEFT JOIN (SELECT case_id, list(DISTINCT slot) AS methods FROM items GROUP BY 1) USING (case_id)
    WHERE objective = '1-URGENT' OR list_contains(methods, 'RF')""")
def objective_or_method_filter(t: Tables) -> DataFrame:
    methods = t.items.groupBy("case_id").agg(F.collect_set("slot").alias("methods"))
    rows = t.headers.join(methods, "case_id", "left")
    return rows.filter((F.col("objective") == "1-URGENT") | F.array_contains("methods", "RF")).select("case_id", "objective")


@query("SELECT entity_id, CASE WHEN balance < 0 THEN NULL ELSE segment END AS segment FROM profiles WHERE balance < 0 OR segment = 'BUILDING' OR segment IS NULL")
def null_tolerant_filter(t: Tables) -> DataFrame:
    rows = t.profiles.select("entity_id", F.when(~(F.col("balance") < 0), F.col("segment")).alias("segment"))
    return rows.filter("segment = 'BUILDING' OR segment IS NULL")


@query("SELECT entity_id, count(*) AS n_cases FROM cases WHERE entity_id IN (SELECT entity_id FROM profiles WHERE segment <> 'MACHINERY') GROUP BY 1")
def cases_per_entity(t: Tables) -> DataFrame:
    scope = t.profiles.filter("segment <> 'MACHINERY'").select("entity_id")
    return t.headers.join(scope, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("n_cases"))


@query("SELECT case_id, entity_id, total FROM cases WHERE entity_id IN (SELECT entity_id FROM profiles WHERE segment = 'BUILDING')")
def scope_filter(t: Tables) -> DataFrame:
    return t.headers.select("case_id", "entity_id", "total").join(t.profiles.filter("segment = 'BUILDING'").select("entity_id"), "entity_id", "left_semi")


SQL_UNSCORABLE = """, shape AS (SELECT case_id, avg(CAST(slot = 'NO' AS DOUBLE)) AS other, count(*) FILTER (WHERE slot <> 'NO') AS scorable FROM items GROUP BY 1),
    unscorable AS (SELECT case_id, round(other, 6) AS other, scorable FROM shape WHERE other > 0.5 OR scorable = 0)
"""


def _unscorable(t: Tables) -> DataFrame:
    shape = t.items.groupBy("case_id").agg(F.avg((F.col("slot") == "NO").cast("double")).alias("other"), F.count_if(F.col("slot") != "NO").alias("scorable"))
    return shape.filter("other > 0.5 OR scorable = 0").withColumn("other", F.round("other", 6))


@query(SQL_UNSCORABLE + "SELECT case_id, other, scorable FROM unscorable")
def unscorable_cases(t: Tables) -> DataFrame:
    return _unscorable(t)


SQL_ELIGIBLE = SQL_UNSCORABLE + """, eligible AS (SELECT case_id, entity_id, n FROM (SELECT case_id, entity_id, count(*) OVER (PARTITION BY entity_id) AS n FROM cases
        WHERE entity_id IN (SELECT entity_id FROM profiles WHERE segment IS NOT NULL AND balance IS NOT NULL)) WHERE n >= 2 AND case_id NOT IN (SELECT case_id FROM unscorable))
"""


def _eligible(t: Tables) -> DataFrame:
    complete = t.profiles.filter("segment IS NOT NULL AND balance IS NOT NULL").select("entity_id")
    rows = t.headers.select("case_id", "entity_id").join(complete, "entity_id", "left_semi")
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy("entity_id"))).filter("n >= 2")
    return counted.join(_unscorable(t).select("case_id"), "case_id", "left_anti").select("case_id", "entity_id", "n")


@query(SQL_ELIGIBLE + "SELECT case_id, entity_id, n FROM eligible")
def eligible_queries(t: Tables) -> DataFrame:
    return _eligible(t)


@query(SQL_ELIGIBLE + """SELECT count(*) AS entities, CAST(sum(k) AS BIGINT) AS n_queries, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS pairs, min(k) AS least, max(k) AS most, round(avg(k), 6) AS mean
    FROM (SELECT entity_id, count(*) AS k FROM eligible GROUP BY 1)""")
def eligibility_summary(t: Tables) -> DataFrame:
    k = _eligible(t).groupBy("entity_id").agg(F.count("*").alias("k"))
    pairs = F.sum((F.col("k") * (F.col("k") - 1) / 2).cast("long"))
    return k.agg(F.count("*").alias("entities"), F.sum("k").alias("n_queries"), pairs.alias("pairs"), F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"))


@query("""SELECT objective, n, usable, CASE WHEN n = 0 THEN 'none' WHEN usable = 0 THEN 'none usable' WHEN usable < 3 THEN 'few usable' END AS reason FROM (
        SELECT objective, count(*) AS n, count(*) FILTER (WHERE total > 499900) AS usable FROM cases GROUP BY 1)
    WHERE usable < 3 OR n = 0""")
def unservable_objectives(t: Tables) -> DataFrame:
    counts = t.headers.groupBy("objective").agg(F.count("*").alias("n"), F.count_if(F.col("total") > 499900).alias("usable"))
    reason = F.when(F.col("n") == 0, "none").when(F.col("usable") == 0, "none usable").when(F.col("usable") < 3, "few usable")
    return counts.withColumn("reason", reason).filter("reason IS NOT NULL")


@query("""SELECT event_id, marker, CASE WHEN value IS NULL OR p05 IS NULL THEN 'unknown' WHEN value < p05 THEN 'low' WHEN value > p95 THEN 'high' ELSE 'in range' END AS status
    FROM series JOIN (SELECT marker, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95 FROM series GROUP BY 1) USING (marker)""")
def range_status(t: Tables) -> DataFrame:
    bands = t.series.groupBy("marker").agg(F.percentile("value", F.lit(0.05)).alias("p05"), F.percentile("value", F.lit(0.95)).alias("p95"))
    status = F.when(F.col("value").isNull() | F.col("p05").isNull(), "unknown").when(F.col("value") < F.col("p05"), "low").when(F.col("value") > F.col("p95"), "high").otherwise("in range")
    return t.series.join(bands, "marker").select("event_id", "marker", status.alias("status"))


@query("SELECT entity_id, balance < 0 AS overdrawn, balance > 9000 AS wealthy, nation IS NULL AS stateless, (balance < 0 OR balance > 9000 OR nation IS NULL) AS any_flag FROM profiles")
def plausibility_flags(t: Tables) -> DataFrame:
    flags = {"overdrawn": F.col("balance") < 0, "wealthy": F.col("balance") > 9000, "stateless": F.col("nation").isNull()}
    any_flag = flags["overdrawn"] | flags["wealthy"] | flags["stateless"]
    return t.profiles.select("entity_id", *[f.alias(n) for n, f in flags.items()], any_flag.alias("any_flag"))


@query("""SELECT entity_id, CASE WHEN balance < 0 THEN 'balance' ELSE '' END || CASE WHEN segment = 'BUILDING' THEN CASE WHEN balance < 0 THEN ',' ELSE '' END || 'segment' ELSE '' END AS missing,
        round((3 - CAST(balance < 0 AS INT) - CAST(segment = 'BUILDING' AS INT)) / 3, 6) AS ratio FROM profiles""")
def profile_completeness(t: Tables) -> DataFrame:
    fields = {
        "balance": F.when(~(F.col("balance") < 0), F.col("balance")).isNull(),
        "nation": F.col("nation").isNull(),
        "segment": F.when(F.col("segment") != "BUILDING", F.col("segment")).isNull(),
    }
    missing = F.filter(F.array(*[F.when(m, F.lit(n)) for n, m in fields.items()]), lambda x: x.isNotNull())
    ratio = F.round((F.lit(len(fields)) - F.size(missing)) / F.lit(float(len(fields))), 6)
    return t.profiles.select("entity_id", F.array_join(missing, ",").alias("missing"), ratio.alias("ratio"))


# Joins.
@query("SELECT case_id, entity_id, objective, segment, nation FROM cases JOIN profiles USING (entity_id)")
def case_profile_join(t: Tables) -> DataFrame:
    return t.headers.join(t.profiles, "entity_id").select("case_id", "entity_id", "objective", "segment", "nation")


@query("""SELECT p.event_id, p.entity_id, v.event_id AS found_event_id, v.value AS found_value FROM series p LEFT JOIN LATERAL
        (SELECT event_id, value FROM series v WHERE v.marker = 'view' AND v.entity_id = p.entity_id AND v.ts < p.ts ORDER BY ts DESC, event_id DESC LIMIT 1) v ON true
    WHERE p.marker = 'purchase'""")
def asof_strict(t: Tables) -> DataFrame:
    bought, seen = t.series.filter("marker = 'purchase'"), t.series.filter("marker = 'view'")
    found = J.asof_strict(bought, seen, by=["entity_id"], left_time="ts", right_time="ts", values=["event_id", "value"], tie="event_id")
    return found.select("event_id", "entity_id", "found_event_id", "found_value")


@query("""SELECT event_id, string_agg(marker || '=' || CAST(found AS VARCHAR), ',' ORDER BY marker) AS readings FROM (
        SELECT p.event_id, v.marker, arg_max(v.event_id, (v.ts, v.event_id)) AS found FROM series p JOIN series v ON v.entity_id = p.entity_id AND v.ts < p.ts AND v.marker <> 'purchase'
        WHERE p.marker = 'purchase' GROUP BY 1, 2) GROUP BY 1""")
def asof_per_marker(t: Tables) -> DataFrame:
    markers = t.series.filter("marker <> 'purchase'").select("marker").distinct()
    asked = t.series.filter("marker = 'purchase'").select(F.col("event_id").alias("query_id"), "entity_id", "ts").crossJoin(markers)
    found = J.asof_strict(asked, t.series.filter("marker <> 'purchase'"), by=["entity_id", "marker"], left_time="ts", right_time="ts", values=["event_id"], tie="event_id")
    one = F.concat("marker", F.lit("="), F.col("found_event_id").cast("string"))
    return found.filter("found_event_id IS NOT NULL").groupBy(F.col("query_id").alias("event_id")).agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("readings"))


@query("SELECT entity_id, lower(marker) AS marker, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM series GROUP BY 1, 2")
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.series.withColumn("marker", F.lower("marker"))
    return J.latest_per_key(rows, ["entity_id", "marker"], "ts", "event_id", ["event_id", "value"])


SQL_SIGNED = """, signed AS (SELECT case_id, md5(string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY CAST(product_id AS VARCHAR))) AS signature FROM (SELECT DISTINCT case_id, product_id FROM items) GROUP BY 1),
    shared AS (SELECT signature FROM signed JOIN cases USING (case_id) GROUP BY 1 HAVING count(DISTINCT entity_id) > 1)
"""


def _signed(t: Tables) -> DataFrame:
    ids = F.array_sort(F.collect_set(F.col("product_id").cast("string")))
    return t.items.groupBy("case_id").agg(F.md5(F.array_join(ids, ",")).alias("signature"))


def _shared(t: Tables) -> DataFrame:
    owned = _signed(t).join(t.headers.select("case_id", "entity_id"), "case_id")
    return owned.groupBy("signature").agg(F.count_distinct("entity_id").alias("n_entities")).filter("n_entities > 1")


@query(SQL_SIGNED + "SELECT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM signed JOIN shared USING (signature))")
def template_exclusion(t: Tables) -> DataFrame:
    return t.headers.select("case_id").join(_signed(t).join(_shared(t), "signature", "left_semi"), "case_id", "left_anti")


@query(SQL_SIGNED + """SELECT query_id, count(*) AS n_excluded FROM (
        SELECT q.case_id AS query_id, c.case_id FROM cases q JOIN cases c USING (entity_id) WHERE q.entity_id % 50 = 0
        UNION SELECT q.case_id, s.case_id FROM cases q JOIN signed m ON m.case_id = q.case_id JOIN shared USING (signature) JOIN signed s ON s.signature = m.signature WHERE q.entity_id % 50 = 0) GROUP BY 1""")
def mandatory_exclusions(t: Tables) -> DataFrame:
    asked = t.headers.filter("entity_id % 50 = 0").select(F.col("case_id").alias("query_id"), "entity_id")
    own = asked.join(t.headers.select("case_id", "entity_id"), "entity_id").select("query_id", "case_id")
    signed = _signed(t).join(_shared(t), "signature", "left_semi")
    mine = asked.join(signed.withColumnRenamed("case_id", "query_id"), "query_id").select("query_id", "signature")
    twins = mine.join(signed, "signature").select("query_id", "case_id")
    return own.union(twins).distinct().groupBy("query_id").agg(F.count("*").alias("n_excluded"))


@query("SELECT case_id FROM cases c WHERE NOT EXISTS (SELECT 1 FROM items JOIN catalogue USING (product_id) WHERE items.case_id = c.case_id AND bulky)")
def restriction_free_cases(t: Tables) -> DataFrame:
    vetoed = t.items.join(t.catalogue.filter("bulky").select("product_id"), "product_id", "left_semi")
    return t.headers.select("case_id").join(vetoed.select("case_id"), "case_id", "left_anti")


@query(""", marked AS (SELECT entity_id, CASE WHEN balance < 0 THEN NULL ELSE segment END AS segment FROM profiles)
    SELECT a.segment, count(*) AS n, count(*) * (count(*) - 1) AS n_pairs FROM marked a GROUP BY 1""")
def null_safe_archetype_match(t: Tables) -> DataFrame:
    marked = t.profiles.select("entity_id", F.when(~(F.col("balance") < 0), F.col("segment")).alias("segment"))
    sizes = marked.groupBy("segment").agg(F.count("*").alias("n"))
    other = sizes.select(F.col("segment").alias("s"), F.col("n").alias("m"))
    return sizes.join(other, F.col("segment").eqNullSafe(F.col("s"))).select("segment", "n", (F.col("n") * (F.col("m") - 1)).alias("n_pairs"))


SQL_CONSECUTIVE = """, consecutive AS (SELECT * FROM (SELECT entity_id, case_id, objective, version, lead(case_id) OVER w AS next_id, lead(objective) OVER w AS next_objective
        FROM cases WINDOW w AS (PARTITION BY entity_id ORDER BY version)) WHERE next_id IS NOT NULL)
"""


@query(SQL_CONSECUTIVE + "SELECT entity_id, case_id, objective, version, next_id, next_objective FROM consecutive")
def consecutive_versions(t: Tables) -> DataFrame:
    return J.consecutive_versions(t.cases)


def purchase_spans(t: Tables) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("ts", "event_id")
    return t.series.filter("marker = 'purchase'").select("event_id", "entity_id", F.col("ts").alias("start"), F.lead("ts").over(w).alias("stop")).filter("stop IS NOT NULL")


@query(""", spans AS (SELECT * FROM (SELECT event_id, entity_id, ts AS start, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS stop FROM series WHERE marker = 'purchase') WHERE stop IS NOT NULL)
    SELECT s.event_id, count(v.ts) AS n, arg_min(v.value, v.ts) AS first_value, arg_max(v.value, v.ts) AS last_value
    FROM spans s LEFT JOIN series v ON v.marker = 'view' AND v.entity_id = s.entity_id AND v.ts >= s.start AND v.ts < s.stop GROUP BY 1""")
def readings_in_window(t: Tables) -> DataFrame:
    views = t.series.filter("marker = 'view'")
    out = J.readings_in_window(purchase_spans(t), views, by="entity_id", start="start", stop="stop", time="ts", value="value")
    return out.select("event_id", "n", "first_value", "last_value")


@query("""SELECT p.event_id, v.event_id AS near_id, abs(epoch_us(p.ts) - epoch_us(v.ts)) AS gap, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), v.event_id) AS nth
    FROM series p JOIN series v ON v.entity_id = p.entity_id AND v.marker = 'signup' WHERE p.marker = 'purchase' QUALIFY nth <= 5""")
def nearest_by_date(t: Tables) -> DataFrame:
    a, b = t.series.filter("marker = 'purchase'"), t.series.filter("marker = 'signup'")
    return J.nearest_by_time(a, b, by="entity_id", left_id="event_id", left_time="ts", right_id="event_id", right_time="ts", k=5)


@query("SELECT case_id, objective, coalesce(segment, 'unknown') AS segment, coalesce(nation, 'unknown') AS nation, coalesce(balance, 0) AS balance FROM cases LEFT JOIN profiles USING (entity_id)")
def enrich_header(t: Tables) -> DataFrame:
    known = t.headers.join(t.profiles, "entity_id", "left")
    text = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("segment", "nation")]
    return known.select("case_id", "objective", *text, F.coalesce("balance", F.lit(0.0)).alias("balance"))


@query("""SELECT side, count(*) AS n, count(*) FILTER (WHERE side = 'both' AND c_mktsegment <> 'FURNITURE') AS n_c_mktsegment, count(*) FILTER (WHERE side = 'both') AS n_c_acctbal FROM (
    SELECT *, CASE WHEN c_nationkey < 5 THEN 'left' WHEN c_nationkey > 20 THEN 'right' ELSE 'both' END AS side FROM customer) GROUP BY 1""")
def unmatched_report(t: Tables) -> DataFrame:
    a = t.customer.filter("c_nationkey <= 20")
    b = t.customer.filter("c_nationkey >= 5").withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "FURNITURE", "other").otherwise(F.col("c_mktsegment")))
    return J.unmatched_report(a, b, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'entity only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'any', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)""")
def entity_set_ops(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id"))
    parts = {"both": a.intersect(b), "entity only": a.subtract(b), "any": a.union(b).distinct()}
    out = None
    for name, ids in parts.items():
        row = ids.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT case_id, CAST(date_sub('month', case_date, DATE '2002-01-01') // 12 AS INTEGER) AS age, CASE WHEN date_sub('month', case_date, DATE '2002-01-01') // 12 < 2 THEN 'new' WHEN date_sub('month', case_date, DATE '2002-01-01') // 12 < 5 THEN 'middle' ELSE 'old' END AS bucket FROM cases")
def age_and_bucket(t: Tables) -> DataFrame:
    from casework.functions.columns import age_on, bucket_of

    age = age_on(F.col("case_date"), F.lit("2002-01-01").cast("date"))
    return t.headers.select("case_id", age.alias("age"), bucket_of(age, [(2, "new"), (5, "middle")], "old").alias("bucket"))


SQL_SAMPLED = """, dealt AS (SELECT *, CAST(('0x' || substr(md5('pairs|1|' || case_id), 1, 8)) AS BIGINT) % greatest(1, (SELECT count(*) FROM cases) // 20) AS block FROM cases),
    sampled AS (SELECT x.case_id AS a, y.case_id AS b, x.objective AS oa, y.objective AS ob, x.case_date AS da, y.case_date AS db FROM dealt x JOIN dealt y ON x.block = y.block AND x.case_id < y.case_id AND x.entity_id <> y.entity_id)
"""


def _sampled(t: Tables) -> DataFrame:
    heads = t.headers.select("case_id", "entity_id", "objective", "case_date")
    return sampled_pairs(heads, key="case_id", entity="entity_id", columns=["objective", "case_date"])


@query("""SELECT a.case_id AS a, b.case_id AS b, a.objective = b.objective AS same FROM cases a JOIN cases b ON a.case_date = b.case_date AND a.case_id < b.case_id AND a.entity_id <> b.entity_id""")
def cross_entity_pairs(t: Tables) -> DataFrame:
    """Pairs of different entities' cases of one day: the equal date bounds them, so no full cross is formed."""
    a = t.headers.select(F.col("case_id").alias("a"), F.col("entity_id").alias("ea"), F.col("objective").alias("oa"), "case_date")
    b = t.headers.select(F.col("case_id").alias("b"), F.col("entity_id").alias("eb"), F.col("objective").alias("ob"), "case_date")
    return a.join(b, "case_date").filter("a < b AND ea <> eb").select("a", "b", (F.col("oa") == F.col("ob")).alias("same"))


@query(SQL_SAMPLED + "SELECT CASE WHEN da < db THEN a ELSE b END AS earlier, CASE WHEN da < db THEN b ELSE a END AS later, abs(date_diff('day', da, db)) AS days FROM sampled WHERE da <> db")
def oriented_causal_pairs(t: Tables) -> DataFrame:
    """Sampled pairs in order of their dates; those of one day have no order and are left out."""
    first = F.col("a_case_date") < F.col("b_case_date")
    pairs = _sampled(t).filter("a_case_date <> b_case_date")
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("later"), F.abs(F.datediff("a_case_date", "b_case_date")).cast("long").alias("days"))

"""Queries of field extraction, imports, spelling variants, and classifiers over cases and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.operators import retrieve as R
from casework.plans import q_retrieval
from casework.plans.registry import query
from casework.sources.tables import Tables


@query("""SELECT page_id, field, value FROM (SELECT page_id, split_part(kv, '=', 1) AS field, split_part(kv, '=', 2) AS value, pos, row_number() OVER (PARTITION BY page_id, split_part(kv, '=', 1) ORDER BY pos) AS r FROM (
        SELECT page_id, unnest(kvs) AS kv, generate_subscripts(kvs, 1) AS pos FROM (SELECT page_id, string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') AS kvs FROM pages)) WHERE kv LIKE '%=%') WHERE r = 1""")
def label_value_pairs(t: Tables) -> DataFrame:
    """The fields of each page's address: several label=value pairs, the first value of a label."""
    pairs = F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")
    rows = t.pages.select("page_id", F.posexplode(pairs).alias("pos", "kv")).filter("kv LIKE '%=%'")
    named = rows.select("page_id", "pos", F.split_part("kv", F.lit("="), F.lit(1)).alias("field"), F.split_part("kv", F.lit("="), F.lit(2)).alias("value"))
    return named.groupBy("page_id", "field").agg(F.min_by("value", "pos").alias("value"))


@query("""SELECT doc_id, len(n) AS n_numbers, len(list_filter(n, lambda x: CAST(x AS BIGINT) BETWEEN 100 AND 999)) AS n_in_range, regexp_matches(text, '(?i)(^|[^a-z])(yes|ja|oui)([^a-z]|$)') AS says_yes
    FROM (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda x: length(x) <= 9) AS n FROM documents)""")
def typed_field_readers(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    numbers = F.filter(F.regexp_extract_all(text, F.lit("([0-9]+)")), lambda x: F.length(x) <= 9)
    inside = F.filter(numbers, lambda x: x.cast("long").between(100, 999))
    return t.documents.select("doc_id", F.size(numbers).cast("long").alias("n_numbers"), F.size(inside).cast("long").alias("n_in_range"), text.rlike("(?i)(^|[^a-z])(yes|ja|oui)([^a-z]|$)").alias("says_yes"))


@query("""SELECT conv_id, arg_min(role, turn) AS first_role, arg_min(text, turn) FILTER (WHERE length(text) > 40) AS first_long, count(*) AS turns, round(avg(CAST(length(text) > 40 AS DOUBLE)), 6) AS coverage FROM conversations GROUP BY 1""")
def profile_merge(t: Tables) -> DataFrame:
    long = F.length("text") > 40
    return t.conversations.groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("first_role"),
        F.min_by(F.when(long, F.col("text")), F.when(long, F.col("turn"))).alias("first_long"),
        F.count("*").alias("turns"),
        F.round(F.avg(long.cast("double")), 6).alias("coverage"),
    )


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN event_type = 'error' THEN 'not a number' END AS rejected FROM events""")
def measurement_file_import(t: Tables) -> DataFrame:
    """Lines "id;value" of the events, read back by declared fields; a value that is no number is rejected with its reason."""
    line = F.concat_ws(";", "event_id", F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")))
    fields = F.from_csv(line, "event_id bigint, raw string", {"sep": ";"})
    rows = t.events.select(fields.alias("f")).select("f.*")
    value = F.col("raw").try_cast("double")
    return rows.select("event_id", value.alias("value"), F.when(value.isNull(), "not a number").alias("rejected"))


@query("SELECT family, slot, name, votes FROM (SELECT family, slot, c.name, count(DISTINCT case_id) AS votes FROM named_items i JOIN catalogue c USING (product_id, family) GROUP BY 1, 2, 3) WHERE votes >= 2 QUALIFY row_number() OVER (PARTITION BY family, slot ORDER BY votes DESC, name) = 1")
def variant_names(t: Tables) -> DataFrame:
    rows = t.items.join(t.catalogue.select("product_id", "family", "name"), "product_id")
    votes = rows.groupBy("family", "slot", "name").agg(F.count_distinct("case_id").alias("votes")).filter("votes >= 2")
    return R.best(votes, ["family", "slot"], [F.desc("votes"), F.asc("name")], 1).drop("rank")


@query(q_retrieval.SQL_POOL + """, r AS (SELECT query_id, rank AS by_score, row_number() OVER (PARTITION BY query_id ORDER BY case_date DESC, case_id) AS by_date FROM pool JOIN cases USING (case_id))
    SELECT query_id, count(*) AS n, round(corr(by_score, by_date), 6) AS rho FROM r GROUP BY 1""")
def recency_vs_similarity(t: Tables) -> DataFrame:
    rows = q_retrieval.pool(t).join(t.headers.select("case_id", "case_date"), "case_id")
    dated = rows.withColumn("by_date", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("case_date"), "case_id")))
    return dated.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.corr("rank", "by_date"), 6).alias("rho"))


@query()
def hashing_embedding(t: Tables) -> DataFrame:
    """A signed hashed bag of words of 64 buckets per document, normalised, as pairs of bucket and weight."""
    words = t.documents.select("doc_id", F.explode(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda x: x != "")).alias("word"))
    h = F.xxhash64("word")
    cells = words.groupBy("doc_id", F.pmod(h, F.lit(64)).alias("bucket")).agg(F.sum(F.when(F.shiftright(h, 20) % 2 == 0, 1).otherwise(-1)).alias("v")).filter("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))
    return cells.select("doc_id", "bucket", F.round(F.col("v") / norm, 6).alias("weight"))


@query()
def rule_predictability(t: Tables) -> DataFrame:
    """How well a profile predicts whether a case is above the usual total: area under the curve of a logistic model on
    held-out entities, beside the share of the larger class."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    rows = t.headers.join(t.profiles, "entity_id").select(
        "entity_id", "objective", "segment", F.coalesce("balance", F.lit(0.0)).alias("balance"), (F.col("total") > 250000).cast("double").alias("label")
    )
    names = ["objective", "segment"]
    steps = [
        StringIndexer(inputCols=names, outputCols=[n + "_i" for n in names], handleInvalid="keep"),
        OneHotEncoder(inputCols=[n + "_i" for n in names], outputCols=[n + "_v" for n in names]),
        VectorAssembler(inputCols=[*[n + "_v" for n in names], "balance"], outputCol="features"),
        LogisticRegression(maxIter=10, regParam=0.01),
    ]
    held = F.pmod(F.xxhash64("entity_id"), F.lit(5)) == 0
    model = Pipeline(stages=steps).fit(rows.filter(~held))
    scored = model.transform(rows.filter(held))
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)
    base = scored.agg(F.count("*").alias("n"), F.avg("label").alias("p"))
    return base.select("n", F.round(F.greatest("p", 1 - F.col("p")), 4).alias("majority"), F.lit(round(auc, 4)).alias("auc"))

"""Queries of de-duplication and linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.operators import linkage as L
from casework.plans.registry import query
from casework.sources.tables import Tables

FOLD = "trim(regexp_replace(replace(translate(lower(coalesce({0}, '')), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), 'ß', 'ss'), '\\s+', ' ', 'g'))"
SQL_SIG = f", sig AS (SELECT doc_id, source, lang, sha256({FOLD.format('text')}) AS signature FROM documents)"


def _signed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "lang", L.signature(F.col("text")).alias("signature"))


@query(SQL_SIG + "SELECT doc_id, signature FROM sig")
def content_signature(t: Tables) -> DataFrame:
    return _signed(t).select("doc_id", "signature")


@query(SQL_SIG + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY source, doc_id) AS place FROM sig)
    SELECT r.doc_id AS dropped, f.doc_id AS survivor, r.source = f.source AS same_owner FROM ranked r JOIN ranked f ON r.signature = f.signature AND f.place = 1 WHERE r.place > 1""")
def dedup_keep_one(t: Tables) -> DataFrame:
    ranked = L.keep_one(_signed(t), ["signature"], [F.asc("source"), F.asc("doc_id")])
    return L.dropped_ledger(ranked, ["signature"], "doc_id", "source")


@query(SQL_SIG + """SELECT 'T' || left(signature, 12) AS template, n_docs, sources FROM (SELECT signature, count(*) AS n_docs, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM sig GROUP BY 1 HAVING count(DISTINCT source) > 1)""")
def template_groups(t: Tables) -> DataFrame:
    groups = _signed(t).groupBy("signature").agg(F.count("*").alias("n_docs"), F.array_sort(F.collect_set("source")).alias("s")).filter(F.size("s") > 1)
    return groups.select(F.concat(F.lit("T"), F.left("signature", F.lit(12))).alias("template"), "n_docs", F.array_join("s", ",").alias("sources"))


@query(SQL_SIG + """SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version FROM sig QUALIFY true AND doc_id IN (SELECT min(doc_id) FROM sig GROUP BY source, signature)""".replace("QUALIFY true AND", "WHERE"))
def assign_versions(t: Tables) -> DataFrame:
    first = L.keep_one(_signed(t), ["source", "signature"], [F.asc("doc_id")]).filter("place = 1")
    return first.select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("version"))


SQL_SHINGLES = """, words AS (SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, source, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM words WHERE len(w) >= 5),
    own AS (SELECT shingle, min(source) AS source FROM shingles GROUP BY 1 HAVING count(DISTINCT source) = 1)
"""


def _shingles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", F.explode(L.word_shingles(F.col("text"), 5)).alias("shingle"))


@query(SQL_SHINGLES + "SELECT source, count(*) AS n FROM own GROUP BY 1")
def distinctive_shingles(t: Tables) -> DataFrame:
    owned = _shingles(t).groupBy("shingle").agg(F.min("source").alias("source"), F.max("source").alias("other")).filter("source = other")
    return owned.groupBy("source").agg(F.count("*").alias("n"))


SQL_VOTES = SQL_SHINGLES + """, sizes AS (SELECT doc_id, count(*) AS size FROM shingles GROUP BY 1),
    sides AS (SELECT shingle, min(source) AS first, max(source) AS second FROM shingles GROUP BY 1 HAVING count(DISTINCT source) = 2),
    votes AS (SELECT s.doc_id AS a, d.second AS b, count(*) AS evidence, round(count(*) / any_value(z.size), 6) AS containment
              FROM shingles s JOIN sides d ON d.shingle = s.shingle AND d.first = s.source JOIN sizes z ON z.doc_id = s.doc_id GROUP BY 1, 2 HAVING count(*) >= 10)
"""


def votes(t: Tables) -> DataFrame:
    """Votes by shingles of five words. An id that has one row has as many shingles as its row; sets of repeated ids are put together."""
    rows = t.documents.select("doc_id", "source", L.word_shingles(F.col("text"), 5).alias("shingles"))
    repeated = t.documents.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    sizes = rows.select("doc_id", F.size("shingles").cast("long").alias("size"))
    if not repeated.isEmpty():
        again = rows.join(repeated, "doc_id", "left_semi").select("doc_id", "source", F.explode("shingles").alias("shingle")).distinct()
        sizes = sizes.join(repeated, "doc_id", "left_anti").unionByName(again.groupBy("doc_id").agg(F.count("*").alias("size")))
    shingles = rows.select("doc_id", "source", F.explode("shingles").alias("shingle"))
    return L.owned_votes(shingles, doc="doc_id", owner="source", shingle="shingle", least=10, sizes=sizes)


@query(SQL_VOTES + "SELECT a, b, evidence, containment FROM votes")
def crosswalk_votes(t: Tables) -> DataFrame:
    """Documents and the one other source that shares shingles with them alone, however many documents hold these."""
    return votes(t)


@query()
def greedy_one_to_one(t: Tables) -> DataFrame:
    """Sources in pairs, by the shingles that no third source has: each once on either side."""
    owner = t.documents.select(F.col("doc_id").alias("a"), F.col("source").alias("one"))
    pairs = votes(t).join(owner, "a").groupBy("one", F.col("b").alias("other")).agg(F.sum("evidence").alias("evidence"))
    return L.greedy_one_to_one(pairs, "one", "other", "evidence")


SQL_SETS = """, sets AS (SELECT DISTINCT case_id, slot || '/' || CAST(product_id AS VARCHAR) AS element FROM items), sizes AS (SELECT case_id, count(*) AS size FROM sets GROUP BY 1),
    alike AS (SELECT a.case_id AS a, b.case_id AS b, count(*) AS common, round(count(*) / (any_value(x.size) + any_value(y.size) - count(*)), 6) AS jaccard FROM sets a JOIN sets b ON a.element = b.element AND a.case_id < b.case_id
        JOIN sizes x ON x.case_id = a.case_id JOIN sizes y ON y.case_id = b.case_id GROUP BY 1, 2 HAVING count(*) / (any_value(x.size) + any_value(y.size) - count(*)) >= 0.5)
"""


def _alike(t: Tables, asked: DataFrame | None = None) -> DataFrame:
    element = F.concat_ws("/", "slot", F.col("product_id").cast("string"))
    return L.overlap_pairs(t.items.select("case_id", element.alias("element")).distinct(), "case_id", "element", threshold=0.5, asked=asked)


SQL_RELABEL = """, folded AS (SELECT doc_id AS member, source, substr(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')), 1, 40) AS head, substr(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')), 1, 20) AS short FROM documents),
    old AS (SELECT member, min(member) OVER (PARTITION BY source, head) AS grp FROM folded), new AS (SELECT member, min(member) OVER (PARTITION BY short) AS grp FROM folded),
    n_old AS (SELECT grp AS was, count(*) AS n_was FROM old GROUP BY 1), n_new AS (SELECT grp, count(*) AS n FROM new GROUP BY 1),
    met AS (SELECT n.grp, o.grp AS was, count(*) AS shared FROM new n JOIN old o USING (member) GROUP BY 1, 2),
    ways AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY shared DESC, was) AS x, row_number() OVER (PARTITION BY was ORDER BY shared DESC, grp) AS y, count(*) OVER (PARTITION BY grp) AS parts, count(*) OVER (PARTITION BY was) AS heirs FROM met),
    named AS (SELECT n_new.grp AS "group", w.was, CASE WHEN y = 1 THEN w.was ELSE n_new.grp END AS label, n, coalesce(shared, 0) AS shared,
        CASE WHEN w.was IS NULL THEN 'new' WHEN parts > 1 THEN 'merged' WHEN heirs > 1 THEN 'split' WHEN shared = n AND shared = n_was THEN 'same' WHEN shared < n_was THEN 'shrunk' ELSE 'grown' END AS kind
        FROM n_new LEFT JOIN (SELECT * FROM ways JOIN n_old USING (was) WHERE x = 1) w ON w.grp = n_new.grp)
    SELECT "group", was, label, n, shared, kind FROM named UNION ALL SELECT NULL, was, was, n_was, 0, 'gone' FROM n_old WHERE was NOT IN (SELECT was FROM named WHERE label = was)
"""


@query(SQL_RELABEL)
def relabel_after_fix(t: Tables) -> DataFrame:
    """Templates by source and the first 40 characters, grouped anew by the first 20 of any source: who keeps its name."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    rows = t.documents.select(F.col("doc_id").alias("member"), "source", F.substring(plain, 1, 40).alias("head"), F.substring(plain, 1, 20).alias("short"))
    least = lambda *by: F.min("member").over(Window.partitionBy(*by)).alias("group")
    return L.relabelled(rows.select("member", least("source", "head")), rows.select("member", least("short")))


@query(SQL_SETS + "SELECT a, b, common, jaccard FROM alike")
def set_signature_link(t: Tables) -> DataFrame:
    return _alike(t)


@query(SQL_SETS + "SELECT case_id, count(*) AS twins FROM (SELECT a AS case_id, b AS other FROM alike UNION ALL SELECT b, a FROM alike) p JOIN cases USING (case_id) JOIN (SELECT case_id AS other, entity_id AS oe FROM cases) o USING (other) WHERE entity_id <> oe GROUP BY 1")
def near_duplicate_exposure(t: Tables) -> DataFrame:
    pairs = _alike(t).select("a", "b")
    both = pairs.union(pairs.select("b", "a")).toDF("case_id", "other")
    owner = t.headers.select("case_id", "entity_id")
    named = both.join(owner, "case_id").join(owner.select(F.col("case_id").alias("other"), F.col("entity_id").alias("other_entity")), "other")
    return named.filter("entity_id <> other_entity").groupBy("case_id").agg(F.count("*").alias("twins"))


@query("SELECT case_id, 'E' || lpad(CAST(entity_id AS VARCHAR), 7, '0') || '-' || lpad(CAST(version AS VARCHAR), 3, '0') AS code FROM cases")
def stable_pseudonyms(t: Tables) -> DataFrame:
    return t.cases.select("case_id", F.format_string("E%07d-%03d", "entity_id", "version").alias("code"))


@query("SELECT segment, entity_id, nth FROM (SELECT segment, entity_id, row_number() OVER (PARTITION BY segment ORDER BY md5(CAST(entity_id AS VARCHAR) || '|review'), entity_id) AS nth FROM profiles) WHERE nth <= 25")
def seeded_sample(t: Tables) -> DataFrame:
    return L.seeded_sample(t.profiles, "segment", "entity_id", 25, "review").select("segment", "entity_id", "nth")


@query(""", lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), shared AS (SELECT line FROM lines GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)
    SELECT class, count(*) AS n FROM (SELECT CASE WHEN trim(l.line) = '' THEN 'blank' WHEN s.line IS NOT NULL THEN 'shared' WHEN regexp_matches(l.line, '[0-9]{3,}') THEN 'numbers' ELSE 'own' END AS class FROM lines l LEFT JOIN shared s ON s.line = l.line) GROUP BY 1""")
def line_accounting(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    shared = lines.groupBy("line").agg(F.count_distinct("doc_id").alias("n")).filter("n > 1").select("line", F.lit(True).alias("shared"))
    kind = F.when(F.trim("line") == "", "blank").when(F.col("shared"), "shared").when(F.col("line").rlike("[0-9]{3,}"), "numbers").otherwise("own")
    return lines.join(shared, "line", "left").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))

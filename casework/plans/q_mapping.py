"""Queries of name resolution: parsed components, chat turns and product descriptions against the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators import mapping as M
from casework.operators import parse as P
from casework.plans import q_parse
from casework.plans.registry import query
from casework.sources.tables import Tables

EXCLUDED = [("old widget", None), ("hot", None), ("small ring", "rod"), ("anvil", "gizmo")]
SQL_EXCLUDED = """
, excluded AS (SELECT * FROM (VALUES ('old widget', NULL), ('hot', NULL), ('small ring', 'rod'), ('anvil', 'gizmo')) e(key, token)),
tried AS (
    SELECT n.name, e.key, 0 AS place, 'whole' AS how FROM (SELECT DISTINCT name FROM catalogue) n JOIN excluded e ON n.name = e.key
    UNION ALL SELECT n.name, e.key, 1, 'two_words' FROM (SELECT DISTINCT name FROM catalogue) n JOIN excluded e ON array_to_string(string_split(n.name, ' ')[1:2], ' ') = e.key
    UNION ALL SELECT n.name, e.key, 2, 'head' FROM (SELECT DISTINCT name FROM catalogue) n JOIN excluded e ON split_part(n.name, ' ', 1) = e.key
    UNION ALL SELECT n.name, e.key, 3, 'token' FROM (SELECT DISTINCT name FROM catalogue) n JOIN excluded e ON list_contains(string_split(n.name, ' '), e.token)),
resolved AS (SELECT name, key, how FROM tried QUALIFY row_number() OVER (PARTITION BY name ORDER BY place, key) = 1)
"""


def _excluded(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(EXCLUDED, "key string, token string")


@query(SQL_EXCLUDED + "SELECT product_id AS id, key, how FROM catalogue JOIN resolved USING (name)")
def resolve_excluded(t: Tables) -> DataFrame:
    return M.resolve_excluded(t.catalogue.select(F.col("product_id").alias("id"), "name"), _excluded(t))


SQL_MAPPED = q_parse.SQL_PARTS + SQL_EXCLUDED + """
, known AS (SELECT name, min(product_id) AS product_id, arg_min(family = 'STANDARD', product_id) AS generic FROM catalogue WHERE bulky GROUP BY 1),
mapped AS (SELECT p.line_id, p.alt_no, p.comp_no, row_number() OVER (PARTITION BY p.line_id ORDER BY p.alt_no, p.comp_no) - 1 AS component_index, p.name, k.product_id, coalesce(k.generic, FALSE) AS generic,
        CASE WHEN p.name IS NULL THEN 'no_name' WHEN k.product_id IS NOT NULL THEN 'mapped' WHEN r.key IS NOT NULL THEN 'excluded' ELSE 'unknown' END AS reason
    FROM (SELECT line_id, alt_no, comp_no, CASE WHEN shape = 2 THEN n1 ELSE name END AS name FROM parts JOIN wide USING (line_id)) p LEFT JOIN known k ON k.name = p.name LEFT JOIN resolved r ON r.name = p.name)
"""


def _mapped(t: Tables) -> DataFrame:
    components = P.promote_embedded_quantity(P.parse_components(q_parse.written_lines(t)))
    known = t.catalogue.filter("bulky").select(F.col("name").alias("key"), "product_id", (F.col("family") == "STANDARD").alias("generic"))
    return M.map_items(components, known, _excluded(t))


@query(SQL_MAPPED + "SELECT line_id, alt_no, comp_no, component_index, name, product_id, generic, reason FROM mapped")
def map_items(t: Tables) -> DataFrame:
    return _mapped(t)


@query(SQL_MAPPED + "SELECT reason, count(*) AS n, count(DISTINCT name) AS names, count(DISTINCT line_id) AS lines FROM mapped GROUP BY 1")
def mapping_coverage(t: Tables) -> DataFrame:
    return _mapped(t).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_distinct("line_id").alias("lines"))


@query(SQL_MAPPED + """, started AS (SELECT DISTINCT CASE WHEN name LIKE 'red %' THEN name WHEN split_part(name, ' ', 1) IN ('small', 'large') THEN split_part(name, ' ', 1) END AS start FROM catalogue),
    freq AS (SELECT name, count(*) AS n FROM mapped WHERE name IS NOT NULL GROUP BY 1), parts_ AS (SELECT name, string_split(name, ' ') AS w, unnest(range(1, len(string_split(name, ' ')) + 1)) AS j FROM freq),
    longest AS (SELECT name, start FROM parts_ JOIN started ON start = array_to_string(w[1:j], ' ') QUALIFY row_number() OVER (PARTITION BY name ORDER BY j DESC) = 1),
    stated_ AS (SELECT f.name, f.n, r.key, l.start, CASE WHEN f.name = 'old rod' THEN 'descriptor_only' WHEN r.key IS NOT NULL THEN 'excluded' WHEN l.start = f.name THEN 'exact' WHEN l.start IS NOT NULL THEN 'prefix'
        WHEN f.n >= 0.0156 * (SELECT sum(n) FROM freq) THEN 'promoted' ELSE 'unmapped' END AS state FROM freq f LEFT JOIN resolved r USING (name) LEFT JOIN longest l ON l.name = f.name)
    SELECT name AS key, n, state, CASE WHEN state = 'excluded' THEN stated_.key WHEN state IN ('exact', 'prefix') THEN start WHEN state = 'promoted' THEN name END AS canonical FROM stated_""")
def mine_catalogue(t: Tables) -> DataFrame:
    """The names in item lines against a catalogue that has only begun: which it knows, which stay out, which are frequent enough to enter."""
    names = P.promote_embedded_quantity(P.parse_components(q_parse.written_lines(t))).select("name")
    head = F.split_part("name", F.lit(" "), F.lit(1))
    begun = F.when(head == "red", F.col("name")).when(head.isin("small", "large"), head)
    started = t.catalogue.select(begun.alias("key")).filter("key IS NOT NULL").distinct()
    return M.mine_catalogue(names, started, _excluded(t), least_share=0.0156, descriptors=("old", "rod"))


#: What the entity of a case writes about it: names in the plural, whole, within more words, and unknown ones.
SQL_WISHES = """
, wishes AS (SELECT case_id AS id, arg_min(name, (line, product_id)) AS a, arg_max(name, (line, product_id)) AS b FROM items JOIN catalogue USING (product_id) GROUP BY 1),
texts AS (SELECT id, 0 AS pos, a || 's' AS fragment, a AS key, CASE WHEN a || 's' IN (SELECT name FROM catalogue) THEN 'exact' ELSE 'singular' END AS how FROM wishes
    UNION ALL SELECT id, 1, b, b, 'exact' FROM wishes UNION ALL SELECT id, 2, 'my ' || b || ' please', b, 'contained' FROM wishes UNION ALL SELECT id, 3, 'nothing else', NULL, NULL FROM wishes)
"""


@query(SQL_WISHES + "SELECT id, pos, fragment, n.product_id, how FROM texts LEFT JOIN (SELECT name, min(product_id) AS product_id FROM catalogue GROUP BY 1) n ON n.name = key")
def match_free_text(t: Tables) -> DataFrame:
    rows = t.items.join(t.catalogue.select("product_id", "name"), "product_id")
    first, last = F.min_by("name", F.struct("line", "product_id")), F.max_by("name", F.struct("line", "product_id"))
    wishes = rows.groupBy("case_id").agg(first.alias("a"), last.alias("b"))
    texts = wishes.select(F.col("case_id").alias("id"), F.format_string("%ss, %s and My %s please; nothing else", "a", "b", "b").alias("text"))
    return M.match_free_text(texts, t.catalogue.select(F.col("name").alias("key"), "product_id"))


@query(""", l AS (SELECT product_id AS left_id, list_sort(list_distinct([*string_split(lower(name), ' '), lower(grp)])) AS lw FROM catalogue WHERE product_id % 50 = 0),
    r AS (SELECT product_id AS right_id, list_sort(list_distinct([*string_split(lower(name), ' '), lower(grp)])) AS rw FROM catalogue WHERE product_id % 50 <> 0),
    same AS (SELECT left_id, min(right_id) AS right_id, any_value(len(lw)) AS shared, 'same' AS how FROM l JOIN r ON lw = rw GROUP BY 1),
    met AS (SELECT left_id, right_id, len(list_intersect(lw, rw)) AS shared FROM l JOIN r ON len(list_intersect(lw, rw)) >= 2 WHERE left_id NOT IN (SELECT left_id FROM same)),
    clear AS (SELECT * FROM (SELECT *, max(shared) OVER (PARTITION BY left_id) AS most FROM met) WHERE shared = most QUALIFY count(*) OVER (PARTITION BY left_id) = 1),
    both_ AS (SELECT * FROM same UNION ALL SELECT left_id, right_id, shared, 'overlap' FROM clear)
    SELECT left_id, right_id, shared, how FROM both_ QUALIFY row_number() OVER (PARTITION BY right_id ORDER BY (how = 'same') DESC, shared DESC, left_id) = 1""".replace("[*string_split(lower(name), ' '), lower(grp)]", "list_append(string_split(lower(name), ' '), lower(grp))"))
def token_overlap_match(t: Tables) -> DataFrame:
    texts = t.catalogue.select(F.col("product_id").alias("id"), F.concat_ws(" ", "grp", "name").alias("text"))
    return M.token_overlap_match(texts.filter("id % 50 = 0"), texts.filter("id % 50 <> 0"))

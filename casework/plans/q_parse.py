"""Queries of the item-line parser. Lines are written from the items of each case in ten shapes; the SQL twin never parses
but says what the lines were written from. What no written line shows is in tests/test_parse.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.operators import parse as P
from casework.plans.registry import query
from casework.sources.tables import Tables


def written_lines(t: Tables) -> DataFrame:
    """(line_id, line): one line for each case, from its first three items."""
    order = Window.partitionBy("case_id").orderBy("line", "product_id", "quantity")
    items = t.items.join(t.catalogue.select("product_id", "name"), "product_id").withColumn("n", F.row_number().over(order)).filter("n <= 3")
    q = lambda n: F.max(F.when(F.col("n") == n, F.col("quantity").cast("int").cast("string"))).alias(f"q{n}")
    name = lambda n: F.max(F.when(F.col("n") == n, F.col("name"))).alias(f"n{n}")
    wide = items.groupBy("case_id").agg(*[q(n) for n in (1, 2, 3)], *[name(n) for n in (1, 2, 3)]).filter("q3 IS NOT NULL")
    say = lambda text, *columns: F.format_string(text, *columns)
    shape = F.col("case_id") % 10
    line = (
        F.when(shape == 0, say("%s gr %s / %s ml %s y %s cucharadas de %s (caso %s)", "q1", "n1", "q2", "n2", "q3", "n3", F.col("case_id").cast("string")))
        .when(shape == 1, say("Cena: %s gr %s o %s", "q1", "n1", "n2"))
        .when(shape == 2, say("1 %s de %s gr", "n1", "q1"))
        .when(shape == 3, say("%s - %s latas de %s con %s", "q1", (F.col("q1").cast("int") + 2).cast("string"), "n1", "n2"))
        .when(shape == 4, say("Merienda 18:30: %s kg %s, %s", "q1", "n1", "n2"))
        .when(shape == 5, say("%s min", "q1"))
        .when(shape == 6, say("Beber %s o %s vasos grandes de %s", "n1", "q2", "n2"))
        .when(shape == 7, say("%s%s gr %s en %s ml de %s", "n1", "q1", "n2", "q2", "n3"))
        .when(shape == 8, say("%s gr (%s o %s)", "q1", "n1", "n2"))
        .otherwise(say("tel / web: (%s)", "n1"))
    )
    return wide.select(F.col("case_id").alias("line_id"), line.alias("line"))


SQL_PARTS = """
, ordered AS (SELECT case_id, CAST(CAST(quantity AS INT) AS DOUBLE) AS q, name, row_number() OVER (PARTITION BY case_id ORDER BY line, product_id, quantity) AS n
              FROM items JOIN catalogue USING (product_id)),
wide AS (SELECT case_id AS line_id, case_id % 10 AS shape, max(q) FILTER (WHERE n = 1) AS q1, max(q) FILTER (WHERE n = 2) AS q2, max(q) FILTER (WHERE n = 3) AS q3,
                max(name) FILTER (WHERE n = 1) AS n1, max(name) FILTER (WHERE n = 2) AS n2, max(name) FILTER (WHERE n = 3) AS n3
         FROM ordered GROUP BY 1, 2 HAVING q3 IS NOT NULL),
parts AS (
    SELECT line_id, 0 AS alt_no, 0 AS comp_no, 2 AS alternatives, 1 AS components, q1 AS quantity, 'gram' AS unit, NULL AS raw_unit, n1 AS name, 'caso ' || line_id AS note, false AS is_noise, false AS is_advice FROM wide WHERE shape = 0
    UNION ALL SELECT line_id, 1, 0, 2, 2, q2, 'millilitre', NULL, n2, 'caso ' || line_id, false, false FROM wide WHERE shape = 0
    UNION ALL SELECT line_id, 1, 1, 2, 2, q3, 'tablespoon', NULL, n3, 'caso ' || line_id, false, false FROM wide WHERE shape = 0
    UNION ALL SELECT line_id, 0, 0, 2, 1, q1, 'gram', NULL, n1, NULL, false, false FROM wide WHERE shape IN (1, 8)
    UNION ALL SELECT line_id, 1, 0, 2, 1, NULL, NULL, NULL, n2, NULL, false, false FROM wide WHERE shape IN (1, 8)
    UNION ALL SELECT line_id, 0, 0, 1, 1, 1, 'piece', NULL, n1 || ' de ' || CAST(CAST(q1 AS INT) AS VARCHAR) || ' gr', NULL, false, false FROM wide WHERE shape = 2
    UNION ALL SELECT line_id, 0, 0, 1, 2, q1 + 1, 'can', NULL, n1, NULL, false, false FROM wide WHERE shape = 3
    UNION ALL SELECT line_id, 0, 0, 1, 2, q1 * 1000, 'gram', NULL, n1, NULL, false, false FROM wide WHERE shape = 4
    UNION ALL SELECT line_id, 0, 1, 1, 2, NULL, NULL, NULL, n2, NULL, false, false FROM wide WHERE shape IN (3, 4)
    UNION ALL SELECT line_id, 0, 0, 1, 1, NULL, NULL, NULL, NULL, NULL, false, true FROM wide WHERE shape = 5
    UNION ALL SELECT line_id, 0, 0, 1, 1, q2, NULL, 'vaso', n2, NULL, false, false FROM wide WHERE shape = 6
    UNION ALL SELECT line_id, 0, 0, 1, 3, NULL, NULL, NULL, n1, NULL, false, false FROM wide WHERE shape = 7
    UNION ALL SELECT line_id, 0, 1, 1, 3, q1, 'gram', NULL, n2, NULL, false, false FROM wide WHERE shape = 7
    UNION ALL SELECT line_id, 0, 2, 1, 3, q2, 'millilitre', NULL, n3, NULL, false, false FROM wide WHERE shape = 7
    UNION ALL SELECT line_id, 0, 0, 1, 1, NULL, NULL, NULL, NULL, n1, true, false FROM wide WHERE shape = 9)
"""
COLUMNS = ["line_id", "alt_no", "comp_no", "alternatives", "components", "quantity", "unit", "raw_unit", "name", "note", "is_noise", "is_advice"]


@query(SQL_PARTS + "SELECT line_id, alt_no, comp_no, alternatives, components, quantity, unit, raw_unit, name, note, is_noise, is_advice FROM parts")
def parse_components(t: Tables) -> DataFrame:
    return P.parse_components(written_lines(t)).select(COLUMNS)


@query(SQL_PARTS + """SELECT p.line_id, alt_no, comp_no, alternatives, components, CASE WHEN shape IN (1, 8) THEN q1 ELSE quantity END AS quantity,
        CASE WHEN shape IN (1, 8) THEN 'gram' ELSE unit END AS unit, raw_unit, name, note, is_noise, is_advice FROM parts p JOIN wide w ON p.line_id = w.line_id""")
def propagate_quantity(t: Tables) -> DataFrame:
    return P.propagate_quantity(P.parse_components(written_lines(t))).select(COLUMNS)


@query(SQL_PARTS + """SELECT p.line_id, alt_no, comp_no, alternatives, components, CASE WHEN shape = 2 THEN q1 ELSE quantity END AS quantity,
        CASE WHEN shape = 2 THEN 'gram' ELSE unit END AS unit, CASE WHEN shape = 2 THEN 'gr' ELSE raw_unit END AS raw_unit, CASE WHEN shape = 2 THEN n1 ELSE name END AS name, note, is_noise, is_advice FROM parts p JOIN wide w ON p.line_id = w.line_id""")
def promote_embedded_quantity(t: Tables) -> DataFrame:
    return P.promote_embedded_quantity(P.parse_components(written_lines(t))).select(COLUMNS)

"""Queries of rendering, of groups split by role, and of labels with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators import render as R
from casework.plans import q_retrieval
from casework.plans.registry import query
from casework.sources.tables import Tables


@query(q_retrieval.SQL_ROWS + """, units AS (SELECT query_id, slot, family, unit, count(*) AS n, median(quantity) AS quantity FROM rows_ GROUP BY 1, 2, 3, 4),
    modal AS (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY query_id, slot, family ORDER BY n DESC, unit) = 1),
    placed AS (SELECT p.query_id, p.slot, p.family, m.unit, CASE WHEN m.quantity > 5 THEN round_even(m.quantity / 5, 0) * 5 ELSE m.quantity END AS quantity,
           row_number() OVER (PARTITION BY p.query_id, p.slot ORDER BY p.support DESC, p.product_cases DESC, p.family) AS position FROM products p JOIN modal m USING (query_id, slot, family))
    SELECT query_id, slot, string_agg(CASE WHEN quantity = floor(quantity) THEN CAST(CAST(quantity AS BIGINT) AS VARCHAR) ELSE CAST(quantity AS VARCHAR) END || ' ' || unit || ' ' || family, ' / ' ORDER BY position) AS line FROM placed GROUP BY 1, 2""")
def render_lines(t: Tables) -> DataFrame:
    return R.render_lines(q_retrieval.compose_proposal(t))


@query("SELECT case_id, line_group, line, product_id, family, dense_rank() OVER (PARTITION BY case_id, line_group ORDER BY family) AS part FROM named_items")
def split_mixed_groups(t: Tables) -> DataFrame:
    return R.split_mixed_groups(t.named_items, ["case_id", "line_group"], "family").select("case_id", "line_group", "line", "product_id", "family", "part")


@query(r"""SELECT page_id, coalesce(a, b, c) AS label, CASE WHEN a IS NOT NULL THEN 'path' WHEN b IS NOT NULL THEN 'host' WHEN c IS NOT NULL THEN 'html' END AS source,
        coalesce(a, b, c) IS NOT NULL AND a IS NULL AS inferred
    FROM (SELECT page_id, nullif(regexp_extract(url, '^[^/]*//[^/]*/(en|de|es|fr)/', 1), '') AS a, nullif(regexp_extract(url, '^[^/]*//[^/]*\.(de|es|fr)(?:[/?#]|$)', 1), '') AS b,
        nullif(regexp_extract(html, 'lang="([a-z]{2})"', 1), '') AS c FROM pages)""")
def label_fallback_chain(t: Tables) -> DataFrame:
    """A page's language: as its path says, else its host's country, else its markup."""
    label, source, inferred = R.label_fallback_chain(
        [
            ("path", F.regexp_extract("url", r"^[^/]*//[^/]*/(en|de|es|fr)/", 1)),
            ("host", F.regexp_extract("url", r"^[^/]*//[^/]*\.(de|es|fr)(?:[/?#]|$)", 1)),
            ("html", F.regexp_extract("html", r'lang="([a-z]{2})"', 1)),
        ]
    )
    return t.pages.select("page_id", label.alias("label"), source.alias("source"), F.coalesce(inferred, F.lit(False)).alias("inferred"))

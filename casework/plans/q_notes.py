"""Queries over the notes of cases. A case's notes are the lines that users wrote in the conversation that its id falls on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators import notes as N
from casework.plans import q_retrieval
from casework.plans.registry import query
from casework.sources.tables import Tables

#: Name, pattern and canonical text of what the query looks for: a word list a language.
THEMES = [
    ("de", r"(^|[^a-zäöüß])(der|die|und)([^a-zäöüß]|$)", "Deutsch."),
    ("en", r"(^|[^a-z])(the|and|with)([^a-z]|$)", "English."),
    ("short", r"^.{1,24}$", "Short and plain."),
    ("terse", r"^\S+( \S+)?$", "short  and plain."),
]


def case_notes(t: Tables) -> DataFrame:
    lines = t.conversations.filter("role = 'user'").select("conv_id", F.explode(F.split("text", "\n")).alias("note"))
    n = t.conversations.agg((F.max("conv_id") + 1).alias("n_conv"))
    cases = q_retrieval.neighbourhood(t).select("case_id").distinct().crossJoin(F.broadcast(n))
    return cases.withColumn("conv_id", F.col("case_id") % F.col("n_conv")).join(lines, "conv_id").select("case_id", "note")


_THEMES_SQL = ", ".join(f"({n!r}, {p!r}, {c!r})" for n, p, c in THEMES)


@query(
    q_retrieval.SQL_NEAR
    + f"""
, themes AS (SELECT * FROM (VALUES {_THEMES_SQL}) v(name, pattern, canonical)),
lines AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS note FROM conversations WHERE role = 'user'),
said AS (SELECT conv_id, trim(note) AS wording, lower(trim(regexp_replace(note, '\\s+', ' ', 'g'))) AS plain FROM lines),
held AS (SELECT n.query_id, n.case_id, n.rank, s.plain, min(s.wording) AS wording FROM near n
    JOIN said s ON s.conv_id = n.case_id % (SELECT max(conv_id) + 1 FROM conversations) WHERE s.plain <> '' AND NOT regexp_matches(s.plain, '^[^a-zß-ÿ]*$') GROUP BY 1, 2, 3, 4),
ks AS (SELECT query_id, count(*) AS k FROM near GROUP BY 1),
hits AS (SELECT h.*, t.name AS theme, t.canonical FROM held h LEFT JOIN themes t ON regexp_matches(h.plain, t.pattern)),
by_theme AS (SELECT query_id, theme AS name, any_value(canonical) AS text, count(DISTINCT case_id) AS support, min(rank) AS best_rank FROM hits WHERE theme IS NOT NULL GROUP BY 1, 2),
kept AS (SELECT b.* FROM by_theme b JOIN ks USING (query_id) WHERE support >= 0.3 * k - 1e-9 AND support >= 2
    QUALIFY row_number() OVER (PARTITION BY b.query_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY support DESC, best_rank, name) = 1),
literal AS (SELECT query_id, plain AS name, arg_min(wording, (rank, case_id)) AS text, count(DISTINCT case_id) AS support, min(rank) AS best_rank
    FROM hits WHERE theme IS NULL GROUP BY 1, 2 HAVING count(DISTINCT case_id) >= 2),
placed AS (SELECT l.*, k, row_number() OVER (PARTITION BY l.query_id ORDER BY support DESC, best_rank, name) AS at_, (SELECT count(*) FROM kept x WHERE x.query_id = l.query_id) AS n_themes
    FROM literal l JOIN ks USING (query_id)),
filled AS (SELECT * FROM placed p WHERE (support >= 0.3 * k - 1e-9 OR at_ + n_themes <= 5)
    AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.query_id = p.query_id AND lower(trim(regexp_replace(x.text, '\\s+', ' ', 'g'))) = p.name)),
parts AS (SELECT query_id, name, text, support, best_rank, 'theme' AS source FROM kept UNION ALL SELECT query_id, name, text, support, best_rank, 'wording' FROM filled)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY source, support DESC, best_rank, name) AS place, source, text, support, best_rank FROM parts
"""
)
def note_consensus(t: Tables) -> DataFrame:
    near = q_retrieval.neighbourhood(t).select("query_id", "case_id", "rank")
    return N.note_consensus(near, case_notes(t), THEMES, share=0.3, floor=2, least=5, artefact=r"^[^a-zß-ÿ]*$")

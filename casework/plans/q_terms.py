"""Queries of words with slips, schedules and dated values, and blocks under the wrong heading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators import relocate as R
from casework.operators import schedule as S
from casework.operators import terms as W
from casework.plans.registry import query
from casework.sources.tables import Tables

CATEGORIES = [("legal", "license"), ("legal", "copyright"), ("contact", "email"), ("contact", "phone"), ("abuse", "idiot"), ("abuse", "stupid"), ("web", "www")]
MEASURES = {"size": (r"([0-9]{2,3}(?:[.,][0-9])?) ?(?:mb|kb)\b", 10, 900)}


@query(
    ", terms AS (SELECT * FROM (VALUES " + ", ".join(map(str, CATEGORIES)) + r""") v(category, term)),
    split AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+'), lambda w: w <> '') AS w, lower(coalesce(text, '')) AS body FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM split),
    near AS (SELECT word, arg_min(category, (levenshtein(word, term), term, category)) AS category, min(levenshtein(word, term)) AS edits FROM (SELECT DISTINCT word FROM words) w, terms
        WHERE levenshtein(word, term) <= CASE WHEN length(term) < 4 THEN 0 WHEN length(term) < 7 THEN 1 ELSE 2 END GROUP BY 1),
    hits AS (SELECT doc_id, category, min(place) AS place, min(edits) AS edits FROM words JOIN near USING (word) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, category) AS n FROM hits),
    read_ AS (SELECT doc_id, max(category) FILTER (WHERE n = 1) AS category, max(category) FILTER (WHERE n = 2) AS secondary, max(edits) FILTER (WHERE n = 1) AS edits FROM ranked GROUP BY 1),
    sizes AS (SELECT *, TRY_CAST(replace(regexp_extract(body, '([0-9]{2,3}(?:[.,][0-9])?) ?(?:mb|kb)\b', 1), ',', '.') AS DOUBLE) AS v FROM split)
    SELECT doc_id, category, secondary, coalesce(len(w) = 1 AND edits = 0, false) AS clean, CASE WHEN v BETWEEN 10 AND 900 THEN v END AS size FROM sizes LEFT JOIN read_ USING (doc_id)"""
)
def category_reader(t: Tables) -> DataFrame:
    """What documents talk about first and second, by a short list of words with room for slips."""
    terms = t.spark.createDataFrame(CATEGORIES, "category string, term string")
    return W.read_categories(t.documents, terms, key="doc_id", text="text", measures=MEASURES)


UNITS = ["gram", "litre", "www"]
SQL_FORMS = r""", hosts AS (SELECT list_filter(string_split_regex(lower(regexp_extract(url, '://([^/?#]*)', 1)), '[^a-z]+'), lambda w: w <> '') AS h, list_filter(string_split_regex(lower(regexp_extract(url, '://[^/]*/([^?#]*)', 1)), '[^a-z]+'), lambda w: w <> '') AS p FROM pages),
    forms AS (SELECT canonical, form, count(*) AS n FROM (SELECT h[-1] AS canonical, unnest(h) AS form FROM hosts UNION ALL SELECT h[-1], unnest(p) FROM hosts UNION ALL SELECT h[-1], array_to_string(p[1:2], ' ') FROM hosts WHERE len(p) >= 2) WHERE canonical IS NOT NULL GROUP BY 1, 2),
    each AS (SELECT form, sum(n)::BIGINT AS n FROM forms GROUP BY 1), single AS (SELECT * FROM each WHERE form NOT LIKE '% %' AND length(form) >= 5),
"""


@query(
    SQL_FORMS + """
    found AS (SELECT a.form, b.form AS other, 'slip' AS kind FROM single a JOIN single b ON a.n < b.n AND abs(length(a.form) - length(b.form)) <= 2 AND levenshtein(a.form, b.form) <= 2
        UNION ALL SELECT a.form, b.form, 'split' FROM each a JOIN each b ON b.form = replace(a.form, ' ', '') WHERE a.form LIKE '% %'
        UNION ALL SELECT p.form, p.head || ' ' || p.tail, 'glued' FROM (SELECT form, form[1:i] AS head, form[i + 1:] AS tail FROM (SELECT form, unnest(range(2, length(form) - 1)) AS i FROM each WHERE form NOT LIKE '% %' AND length(form) >= 4)) p
            JOIN each h ON h.form = p.head WHERE p.tail IN (SELECT form FROM each) OR p.tail IN ('gram', 'litre', 'www')
        UNION ALL SELECT form, NULL, 'unit' FROM each WHERE form IN ('gram', 'litre', 'www')
        UNION ALL SELECT form, min(canonical), 'shared' FROM forms GROUP BY 1 HAVING count(*) > 1
        UNION ALL SELECT DISTINCT f.form, c.canonical, 'name' FROM forms f JOIN forms c ON f.form = c.canonical WHERE f.canonical <> c.canonical)
    SELECT form, canonical, kind, other FROM forms JOIN found USING (form) WHERE kind <> 'name' OR canonical <> other"""
)
def synonym_audit(t: Tables) -> DataFrame:
    """Words of URLs under the domain they stand in: slips, split, glued, shared ones and names."""
    words = lambda pattern: F.filter(F.split(F.lower(F.regexp_extract("url", pattern, 1)), "[^a-z]+"), lambda w: w != "")
    hosts = t.pages.select(words("://([^/?#]*)").alias("h"), words("://[^/]*/([^?#]*)").alias("p")).filter(F.size("h") > 0).withColumn("canonical", F.element_at("h", -1))
    pairs = F.when(F.size("p") >= 2, F.array(F.array_join(F.slice("p", 1, 2), " "))).otherwise(F.array().cast("array<string>"))
    forms = hosts.select("canonical", F.explode(F.concat("h", "p", pairs)).alias("form")).groupBy("canonical", "form").agg(F.count("*").alias("n"))
    return W.synonym_audit(forms, units=UNITS)


DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
WORDS = S.ScheduleWords(
    stated=r"([0-9]) (?:days|times|sessions) (?:a|per) week",
    days=DAYS,
    session=r"(?:^|\n)session ([a-z])\b",
    kinds={"cardio": "cardio|running", "strength": "strength|weights", "mobility": "yoga|stretch"},
    parts={"chest": r"(^|[^a-z])chest", "legs": r"(^|[^a-z])legs", "back": r"(^|[^a-z])back"},
)
BODY = {"weight_kg": (r"weight[^0-9\n]{0,12}([0-9]{2,3}[.,]?[0-9]?)", 30, 250), "fat_pct": (r"fat[^0-9\n]{0,12}([0-9]{1,2}[.,]?[0-9]?)", 3, 70)}

#: Sheets of an entity's cases: what a line says depends on the case.
SQL_SHEETS = r""", sheets AS (SELECT entity_id * 4 + version % 4 AS sheet_id, string_agg(line, chr(10) ORDER BY version) AS sheet FROM (SELECT entity_id, version, CASE case_id % 6
        WHEN 0 THEN (case_id % 8) || ' days a week of strength' WHEN 1 THEN dayname(case_date) || ' cardio and legs' WHEN 2 THEN 'Session ' || chr(CAST(65 + case_id % 7 AS INTEGER)) || ': chest, back'
        WHEN 3 THEN strftime(case_date, '%d/%m/%y') || ' Weight: ' || CAST(total AS INTEGER) // 1000 || ',5 kg fat ' || case_id % 97 || '%' WHEN 4 THEN strftime(case_date, '%Y-%m-%d') || ' fat ' || case_id % 50 || ' yoga' ELSE 'rest on ' || dayname(case_date) END AS line FROM cases) GROUP BY 1)
"""


def _sheets(t: Tables) -> DataFrame:
    day, n = F.date_format("case_date", "EEEE"), F.col("case_id")
    line = (
        F.when(n % 6 == 0, F.concat((n % 8).cast("string"), F.lit(" days a week of strength")))
        .when(n % 6 == 1, F.concat(day, F.lit(" cardio and legs")))
        .when(n % 6 == 2, F.concat(F.lit("Session "), F.char(65 + n % 7), F.lit(": chest, back")))
        .when(n % 6 == 3, F.concat(F.date_format("case_date", "dd/MM/yy"), F.lit(" Weight: "), F.floor(F.round("total") / 1000).cast("string"), F.lit(",5 kg fat "), (n % 97).cast("string"), F.lit("%")))
        .when(n % 6 == 4, F.concat(F.date_format("case_date", "yyyy-MM-dd"), F.lit(" fat "), (n % 50).cast("string"), F.lit(" yoga")))
        .otherwise(F.concat(F.lit("rest on "), day))
    )
    rows = t.cases.select((F.col("entity_id") * 4 + F.col("version") % 4).alias("sheet_id"), F.struct("version", line.alias("line")).alias("x"))
    return rows.groupBy("sheet_id").agg(F.array_join(F.array_sort(F.collect_list("x"))["line"], "\n").alias("sheet"))


_SQL_DAYS = ", ".join(f"CASE WHEN regexp_matches(b, '(^|[^a-z]){d}([^a-z]|$)') THEN '{d}' END" for d in DAYS)


def _sql_named(patterns: dict[str, str]) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(b, '{p}') THEN '{n}' END" for n, p in sorted(patterns.items()))
    return f"array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',')"


@query(
    SQL_SHEETS
    + rf""", found AS (SELECT sheet_id, TRY_CAST(regexp_extract(b, '{WORDS.stated}', 1) AS INTEGER) AS stated, list_filter([{_SQL_DAYS}], lambda x: x IS NOT NULL) AS d,
        len(list_distinct(regexp_extract_all(b, '(?:^|\n)session ([a-z])\b', 1))) AS s, {_sql_named(WORDS.kinds)} AS kinds, {_sql_named(WORDS.parts)} AS parts FROM (SELECT sheet_id, lower(sheet) AS b FROM sheets))
    SELECT sheet_id, CAST(coalesce(stated, nullif(len(d), 0), nullif(s, 0)) AS INTEGER) AS per_week, CASE WHEN stated IS NOT NULL THEN 'stated' WHEN len(d) > 0 THEN 'days' WHEN s > 0 THEN 'sessions' END AS source,
        array_to_string(d, ',') AS days, CAST(s AS INTEGER) AS sessions, kinds, parts FROM found"""
)
def extract_schedule(t: Tables) -> DataFrame:
    return S.extract_schedule(_sheets(t), WORDS, key="sheet_id", text="sheet")


@query(
    SQL_SHEETS
    + r""", lines AS (SELECT sheet_id, unnest(string_split(sheet, chr(10))) AS l, generate_subscripts(string_split(sheet, chr(10)), 1) - 1 AS line FROM sheets),
    parsed AS (SELECT sheet_id, CAST(line AS INTEGER) AS line, coalesce(TRY_CAST(regexp_extract(l, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') AS DATE),
            CAST(TRY_STRPTIME(regexp_extract(l, '[0-9]{2}/[0-9]{2}/[0-9]{2}'), '%d/%m/%y') AS DATE)) AS date,
        TRY_CAST(replace(regexp_extract(lower(l), 'weight[^0-9\n]{0,12}([0-9]{2,3}[.,]?[0-9]?)', 1), ',', '.') AS DOUBLE) AS w, TRY_CAST(replace(regexp_extract(lower(l), 'fat[^0-9\n]{0,12}([0-9]{1,2}[.,]?[0-9]?)', 1), ',', '.') AS DOUBLE) AS f FROM lines)
    SELECT sheet_id, line, date, CASE WHEN w BETWEEN 30 AND 250 THEN w END AS weight_kg, CASE WHEN f BETWEEN 3 AND 70 THEN f END AS fat_pct FROM parsed
    WHERE year(date) BETWEEN 1990 AND 2030 AND (w BETWEEN 30 AND 250 OR f BETWEEN 3 AND 70)"""
)
def dated_measures(t: Tables) -> DataFrame:
    return S.dated_measures(_sheets(t), BODY, key="sheet_id", text="sheet", first_year=1990, last_year=2030)


RULES = [("^promo", "move", "NO"), ("^economy", "note", None), ("^(small|tiny)", "drop", None)]
SQL_BLOCKS = r""", raw_lines AS (SELECT case_id AS doc_id, slot, dense_rank() OVER (PARTITION BY case_id ORDER BY slot) AS slot_no, row_number() OVER (PARTITION BY case_id, slot ORDER BY line, product_id, quantity) AS pos,
        CASE WHEN line % 3 = 1 THEN family || CASE WHEN product_id % 2 = 0 THEN ' (18:30)' ELSE ' 2 h' END || ': ' || lower(grp) ELSE CAST(quantity AS INTEGER) || ' of ' || name END AS line
    FROM items JOIN catalogue USING (product_id)),
keys AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(string_split(line, ':')[1]), '\(.*$', ' '), '[0-9]+\s*(h|min)?\b', ' ', 'g'), '[^a-z]+', ' ', 'g')) AS k FROM raw_lines),
marked AS (SELECT *, CASE WHEN line LIKE '%:%' AND NOT regexp_matches(line, '^[0-9]') AND k NOT LIKE 'standard%' THEN k END AS mark FROM keys),
blocks AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id, slot ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM marked),
decided AS (SELECT label, count(mark) AS blocks, count(*) FILTER (WHERE regexp_matches(line, '^\s*[0-9]') AND mark IS NULL) AS components FROM blocks WHERE label IS NOT NULL GROUP BY 1),
fates AS (SELECT label, blocks, components, CASE WHEN starts_with(label, 'promo') THEN 'move' WHEN starts_with(label, 'economy') THEN 'note' WHEN regexp_matches(label, '^(small|tiny)') THEN 'drop' WHEN components < blocks THEN 'note' ELSE 'keep' END AS fate FROM decided)
"""


def _lines(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    rows = t.items.join(t.catalogue.select("product_id", "family", "grp", "name"), "product_id")
    head = F.concat("family", F.when(F.col("product_id") % 2 == 0, " (18:30)").otherwise(" 2 h"), F.lit(": "), F.lower("grp"))
    text = F.when(F.col("line") % 3 == 1, head).otherwise(F.concat(F.col("quantity").cast("int").cast("string"), F.lit(" of "), F.col("name")))
    number = F.dense_rank().over(Window.partitionBy("case_id").orderBy("slot"))
    place = F.row_number().over(Window.partitionBy("case_id", "slot").orderBy("line", "product_id", "quantity"))
    return rows.select(F.col("case_id").alias("doc_id"), "slot", number.alias("slot_no"), place.alias("pos"), text.alias("line"))


@query(SQL_BLOCKS + "SELECT label, blocks, components, fate, CASE WHEN fate = 'move' THEN 'NO' END AS target FROM fates")
def label_decisions(t: Tables) -> DataFrame:
    return R.label_decisions(R.label_blocks(_lines(t), ["standard"]), RULES, r"^\s*([0-9]|[½¼¾])")


@query(
    SQL_BLOCKS
    + """, aimed AS (SELECT b.*, CASE fate WHEN 'note' THEN 'note' WHEN 'drop' THEN 'dropped' ELSE 'text' END AS part, coalesce(fate = 'move' AND slot <> 'NO', false) AS moved FROM blocks b LEFT JOIN fates USING (label)),
    goes AS (SELECT *, CASE WHEN moved THEN 'NO' ELSE slot END AS to_slot FROM aimed),
    nos AS (SELECT doc_id, to_slot, coalesce(min(slot_no) FILTER (WHERE slot = to_slot), min(slot_no) FILTER (WHERE moved) + 0.5) AS to_no FROM goes GROUP BY 1, 2)
    SELECT doc_id, part, CASE WHEN part = 'text' THEN to_slot END AS slot, row_number() OVER (PARTITION BY doc_id, part ORDER BY CASE WHEN part = 'text' THEN to_no END, CASE WHEN part = 'text' THEN to_slot END, CASE WHEN part = 'text' THEN moved END, slot_no, pos) AS place, pos, line
    FROM goes JOIN nos USING (doc_id, to_slot)"""
)
def relocate_blocks(t: Tables) -> DataFrame:
    """Blocks under a label that belongs elsewhere, moved by one decision for all cases; every line is still there."""
    return R.relocate_blocks(_lines(t), RULES, known=["standard"])

"""Queries over text columns: cleaning, classification, segmentation, and privacy scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.functions.columns import fold_text
from casework.operators import text as X
from casework.operators.retrieve import best
from casework.operators.schedule import date_in
from casework.plans.q_linkage import FOLD
from casework.plans.registry import query
from casework.sources.tables import Tables


def body() -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col("text"), F.lit(""))



@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def fold_text_documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(fold_text(body())).alias("folded"))


MARKUP, LINK, MAIL = r"<[^>]*>", r"https?://[^\s<>\"]+", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def clean(text: Column, patterns: list[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


@query(f"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '{MARKUP}', ' ', 'g'), '{LINK}', ' ', 'g'), '[ \\t]+', ' ', 'g'))) AS n_clean,
    regexp_matches(html, '{MARKUP}') AS had_markup, regexp_matches(regexp_replace(html, '{MARKUP}', ' ', 'g'), '{LINK}') AS had_link FROM pages""")
def residue_clean(t: Tables) -> DataFrame:
    bare = F.regexp_replace("html", MARKUP, " ")
    return t.pages.select(
        "page_id", F.length(clean(F.col("html"), [MARKUP, LINK])).cast("long").alias("n_clean"), F.col("html").rlike(MARKUP).alias("had_markup"), bare.rlike(LINK).alias("had_link")
    )


NOTE = "CASE WHEN length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) < 15 THEN 'dropped_short' WHEN regexp_matches(text, '(?i)^(ok|thanks|hello)') THEN 'dropped_boilerplate' WHEN text <> trim(text) THEN 'trimmed' ELSE 'kept' END"


def note_outcome(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(letters < 15, "dropped_short").when(text.rlike("(?i)^(ok|thanks|hello)"), "dropped_boilerplate").when(text != F.trim(text), "trimmed").otherwise("kept")


@query(f"SELECT conv_id, turn, {NOTE} AS outcome FROM conversations")
def note_clean(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", note_outcome(body()).alias("outcome"))


@query(f"SELECT role, {NOTE} AS outcome, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_before, CAST(sum(CASE WHEN {NOTE} IN ('kept', 'trimmed') THEN length(trim(coalesce(text, ''))) ELSE 0 END) AS BIGINT) AS n_after FROM conversations GROUP BY 1, 2")
def clean_and_discard(t: Tables) -> DataFrame:
    rows = t.conversations.select("role", body().alias("text"), note_outcome(body()).alias("outcome"))
    after = F.when(F.col("outcome").isin("kept", "trimmed"), F.length(F.trim("text"))).otherwise(0)
    return rows.groupBy("role", "outcome").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_before"), F.sum(after).alias("n_after"))


#: Label, pattern and priority of what a document shows.
LABELS = [("numbers", "[0-9]{3,}", 1), ("licensed", "(?i)licensed under", 5), ("licensed", "(?i)under the mit", 5), ("contact", MAIL, 4), ("shouting", r"!![ \n]", 3), ("table", r" \| ", 2)]
_BY_RANK = sorted(range(len(LABELS)), key=lambda i: (-LABELS[i][2], i))


@query(", hits AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{LABELS[i][1]}') THEN '{LABELS[i][0]}' END" for i in _BY_RANK) + """], lambda x: x IS NOT NULL) AS h FROM documents),
    labels AS (SELECT doc_id, list_filter(h, lambda x, i: list_position(h, x) = i) AS l FROM hits) SELECT doc_id, array_to_string(l, ',') AS labels, l[1] AS main, len(l) > 1 AS compound, len(l) > 0 AS covered FROM labels""")
def label_taxonomy(t: Tables) -> DataFrame:
    return X.label_by_patterns(t.documents, LABELS, key="doc_id", text="text")


#: Frequent words of each language and their weight. Neighbours are spelt out: word boundaries differ between engines.
SIGNALS = {n: (f"(^|[^a-z])({words})([^a-z]|$)", 2) for n, words in {"en": "the|and|of", "de": "der|die|und", "fr": "le|les|des", "es": "los|que|del"}.items()}


@query(", hits AS (SELECT doc_id, unnest([" + ", ".join(f"{{'label': '{n}', 'score': {w} * least(len(regexp_extract_all(lower(coalesce(text, '')), '{p}')), 4)}}" for n, (p, w) in SIGNALS.items()) + """]) AS h FROM documents),
    top AS (SELECT doc_id, h.label AS label, h.score AS score, row_number() OVER w AS r, lead(h.score) OVER w AS second FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY h.score DESC, h.label))
    SELECT doc_id, CASE WHEN score = 0 THEN 'unclassified' WHEN score = second THEN 'ambiguous' ELSE label END AS label, CAST(score AS INTEGER) AS score FROM top WHERE r = 1""")
def signal_classify(t: Tables) -> DataFrame:
    return X.label_by_signals(t.documents, [(n, p, w) for n, (p, w) in SIGNALS.items()], key="doc_id", text="text")


HEAD = r"^([A-Za-z]+[.:])\s+(.+)$"
SQL_LINES = ", lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


def _lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split(body(), "\n")).alias("pos", "line"))


@query(SQL_LINES + f", heads AS (SELECT doc_id, pos, regexp_extract(line, '{HEAD}', 1) AS head, length(regexp_extract(line, '{HEAD}', 2)) AS n_rest FROM lines) SELECT doc_id, pos, head, n_rest FROM heads WHERE head <> ''")
def header_split(t: Tables) -> DataFrame:
    rows = _lines(t).select("doc_id", "pos", F.regexp_extract("line", HEAD, 1).alias("head"), F.length(F.regexp_extract("line", HEAD, 2)).cast("long").alias("n_rest"))
    return rows.filter("head <> ''")


#: Pattern of a head, its class, and why; the first that fits counts.
HEAD_RULES = [("^[A-Z]{2,}", "section", "capitals"), ("^(The|And|Of|In|To)", "slot", "frequent word"), (":$", "field", "colon")]


SQL_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(head, '{p}') THEN '{k}'" for p, k, _ in HEAD_RULES) + " ELSE 'unmapped' END"
SQL_WHY = "CASE " + " ".join(f"WHEN regexp_matches(head, '{p}') THEN '{why}'" for p, _, why in HEAD_RULES) + " END"


@query(SQL_LINES + f", heads AS (SELECT doc_id, pos, regexp_extract(line, '{HEAD}', 1) AS head FROM lines) SELECT doc_id, pos, {SQL_CLASS} AS class, {SQL_WHY} AS reason FROM heads WHERE head <> ''")
def header_classify(t: Tables) -> DataFrame:
    heads = _lines(t).select("doc_id", "pos", F.regexp_extract("line", HEAD, 1).alias("head")).filter("head <> ''")
    return X.first_rule(heads, HEAD_RULES, column="head").select("doc_id", "pos", "class", "reason")


@query(SQL_LINES + f", heads AS (SELECT doc_id, pos, line, nullif(regexp_extract(line, '{HEAD}', 1), '') AS head FROM lines), carried AS (SELECT doc_id, pos, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'preamble') AS section FROM heads) SELECT doc_id, section, count(*) AS n_lines, min(pos) AS first_pos FROM carried GROUP BY 1, 2")
def segment_document(t: Tables) -> DataFrame:
    head = F.nullif(F.regexp_extract("line", HEAD, 1), F.lit(""))
    carried = F.last(head, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = _lines(t).select("doc_id", "pos", F.coalesce(carried, F.lit("preamble")).alias("section"))
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.min("pos").cast("long").alias("first_pos"))


@query(SQL_LINES + f", heads AS (SELECT doc_id, regexp_extract(line, '{HEAD}', 1) AS head FROM lines) SELECT head, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS example, {SQL_CLASS} AS class FROM heads WHERE head <> '' GROUP BY head")
def vocabulary_census(t: Tables) -> DataFrame:
    heads = _lines(t).select("doc_id", F.regexp_extract("line", HEAD, 1).alias("head")).filter("head <> ''")
    counted = heads.groupBy("head").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("example"))
    return X.first_rule(counted, HEAD_RULES, column="head").drop("reason")


@query(SQL_LINES + """SELECT round(avg(CAST(tables AS DOUBLE)), 6) AS tables, round(avg(CAST(blank AS DOUBLE)), 6) AS blank, round(avg(CAST(shout AS DOUBLE)), 6) AS shout, round(avg(n), 6) AS n_lines
    FROM (SELECT doc_id, bool_or(line LIKE '% | %') AS tables, bool_or(trim(line) = '') AS blank, bool_or(line LIKE '%!!%') AS shout, count(*) AS n FROM lines GROUP BY 1)""")
def document_shape_stats(t: Tables) -> DataFrame:
    kinds = {"tables": F.col("line").like("% | %"), "blank": F.trim("line") == "", "shout": F.col("line").like("%!!%")}
    per = _lines(t).groupBy("doc_id").agg(*[F.bool_or(k).alias(n) for n, k in kinds.items()], F.count("*").alias("n"))
    return per.agg(*[F.round(F.avg(F.col(n).cast("double")), 6).alias(n) for n in kinds], F.round(F.avg("n"), 6).alias("n_lines"))


SQL_NAMES = ", words AS (SELECT product_id, lower(name) AS name FROM catalogue)"


@query(SQL_NAMES + ", idx AS (SELECT DISTINCT split_part(name, ' ', 1) AS key FROM words) SELECT product_id, name AS matched, length(name) AS n FROM words WHERE product_id % 2 = 0 UNION ALL SELECT product_id, key, length(key) FROM words JOIN idx ON key = split_part(name, ' ', 1) WHERE product_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM words w WHERE w.product_id % 2 = 0 AND w.name = words.name) UNION ALL SELECT product_id, name, length(name) FROM words WHERE product_id % 2 = 1 AND EXISTS (SELECT 1 FROM words w WHERE w.product_id % 2 = 0 AND w.name = words.name)")
def resolve_longest_prefix(t: Tables) -> DataFrame:
    """Names resolved by the longest token prefix that is a key; keys are the full names of even products and all first words."""
    words = t.catalogue.select("product_id", F.lower("name").alias("name"))
    keys = words.filter("product_id % 2 = 0").select(F.col("name").alias("key")).union(words.select(F.split_part("name", F.lit(" "), F.lit(1)))).distinct()
    tokens = F.split("name", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, 1, n), " "))
    hits = words.select("product_id", F.explode(prefixes).alias("key")).join(keys, "key")
    return hits.groupBy("product_id").agg(F.max_by("key", F.length("key")).alias("matched"), F.max(F.length("key")).cast("long").alias("n"))


@query("SELECT product_id, array_to_string(list_sort(list_filter(string_split(lower(name), ' '), lambda x: x NOT IN ('red', 'blue', 'green', 'small', 'large'))), ' ') AS key FROM catalogue")
def grouping_key(t: Tables) -> DataFrame:
    words = F.filter(F.split(F.lower("name"), " "), lambda x: ~x.isin("red", "blue", "green", "small", "large"))
    return t.catalogue.select("product_id", F.array_join(F.array_sort(words), " ").alias("key"))


TERMS = [("idiot", 2), ("moron", 2), ("clown", 1), ("stupid", 1), ("license", 1), ("licensed", 1)]


@query(", terms AS (SELECT * FROM (VALUES " + ", ".join(map(str, TERMS)) + r""") v(term, weight)), pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\p{L}+|[^\p{L}]+') AS p FROM documents)),
    met AS (SELECT p.*, t.term, t.weight FROM pieces p LEFT JOIN terms t ON t.term = lower(p.piece))
    SELECT doc_id, count(term) AS mentions, string_agg(DISTINCT term, ',' ORDER BY term) AS terms, CAST(sum(weight) AS BIGINT) AS weight, sum(weight) >= 4 AS dropped, md5(string_agg(CASE WHEN term IS NULL THEN piece ELSE '***' END, '' ORDER BY pos)) AS redacted
    FROM met GROUP BY 1 HAVING count(term) > 0""")
def term_screen(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame(TERMS, "term string, weight long")
    return X.screen_terms(t.documents, terms, key="doc_id", text="text", limit=4).withColumn("redacted", F.md5("redacted"))


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_ISO, _DMY = "(?:^|[^0-9])([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[^0-9]|$)", "(?:^|[^0-9])([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})(?:[^0-9]|$)"
_NAMED = f"(?i)(?:^|[^0-9])([0-9]{{1,2}})\\.? (?:de )?({'|'.join(MONTHS)}),? (?:de )?([0-9]{{4}})(?:[^0-9]|$)"


@query(f""", dated AS (SELECT case_id, CASE case_id % 5 WHEN 0 THEN 'due ' || strftime(case_date, '%Y-%m-%d') || ' or 1/1/2001' WHEN 1 THEN strftime(case_date, '%-d/%-m/%y') || ' noted' WHEN 2 THEN 'on ' || strftime(case_date, '%d.%m.%Y')
        WHEN 3 THEN 'by ' || strftime(case_date, '%-d %B %Y') || '.' ELSE 'on 31/' || (case_id % 14) || '/2020' END AS line FROM cases),
    parts AS (SELECT case_id, line, regexp_extract(line, '{_ISO}', ['y', 'm', 'd']) AS i, regexp_extract(line, '{_DMY}', ['d', 'm', 'y']) AS s, regexp_extract(line, '{_NAMED}', ['d', 'm', 'y']) AS n FROM dated)
    SELECT case_id, CASE WHEN i.y <> '' THEN TRY_CAST(i.y || '-' || lpad(i.m, 2, '0') || '-' || lpad(i.d, 2, '0') AS DATE)
        WHEN s.y <> '' THEN TRY_CAST(CASE WHEN length(s.y) = 4 THEN s.y WHEN TRY_CAST(s.y AS INTEGER) < 70 THEN '20' || s.y ELSE '19' || s.y END || '-' || lpad(s.m, 2, '0') || '-' || lpad(s.d, 2, '0') AS DATE)
        WHEN n.y <> '' THEN TRY_CAST(n.y || '-' || lpad(CAST(list_position({MONTHS}, lower(n.m)) AS VARCHAR), 2, '0') || '-' || lpad(n.d, 2, '0') AS DATE) END AS found FROM parts""")
def date_from_text(t: Tables) -> DataFrame:
    """Dates out of lines that write a case's date in several ways, some of them of no day at all."""
    n, day = F.col("case_id"), lambda f: F.date_format("case_date", f)
    line = (
        F.when(n % 5 == 0, F.concat(F.lit("due "), day("yyyy-MM-dd"), F.lit(" or 1/1/2001")))
        .when(n % 5 == 1, F.concat(day("d/M/yy"), F.lit(" noted")))
        .when(n % 5 == 2, F.concat(F.lit("on "), day("dd.MM.yyyy")))
        .when(n % 5 == 3, F.concat(F.lit("by "), day("d MMMM yyyy"), F.lit(".")))
        .otherwise(F.concat(F.lit("on 31/"), (n % 14).cast("string"), F.lit("/2020")))
    )
    return t.headers.select("case_id", date_in(line, months=MONTHS).alias("found"))


@query(""", notes AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '')) AS w FROM conversations), tok AS (SELECT conv_id, turn, unnest(w) AS word FROM notes),
    df AS (SELECT word, count(*) AS df FROM tok GROUP BY 1), s AS (SELECT conv_id, turn, round(sum(ln(((SELECT count(*) FROM notes) + 1) / (df + 1))), 6) AS score FROM tok JOIN df USING (word) GROUP BY 1, 2)
    SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS place FROM s QUALIFY place <= 3""")
def idf_top_notes(t: Tables) -> DataFrame:
    notes = t.conversations.select("conv_id", "turn", F.array_distinct(F.filter(F.split(F.lower(body()), "[^a-z]+"), lambda x: x != "")).alias("w"))
    words = notes.select("conv_id", "turn", F.explode("w").alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(notes.agg(F.count("*").alias("total"))))
    idf = F.log((F.col("total") + 1) / (F.col("df") + 1))
    scored = words.join(df, "word").groupBy("conv_id", "turn").agg(F.round(F.sum(idf), 6).alias("score"))
    return best(scored, ["conv_id"], [F.desc("score"), F.asc("turn")], 3, "place")


SPELLINGS = [("u0", "base", 1.0), ("base", "base", 1.0), ("u1", "piece", 1.0), ("dozen", "piece", 12.0)]


@query(", spellings AS (SELECT * FROM (VALUES " + ", ".join(map(str, SPELLINGS)) + """) v(spelling, unit, times)),
    raws AS (SELECT raw, count(*) AS n, trim(lower(raw), ' .') AS plain FROM (SELECT CASE line % 4 WHEN 0 THEN upper(unit) || '.' WHEN 1 THEN unit WHEN 2 THEN unit || 's ' ELSE 'Dozens' END AS raw FROM items) GROUP BY 1)
    SELECT raw, coalesce(a.unit, b.unit, plain) AS unit, CAST(coalesce(a.times, b.times) AS DOUBLE) AS times, coalesce(a.unit, b.unit) IS NOT NULL AS known, CASE WHEN coalesce(a.unit, b.unit) IS NULL THEN CASE WHEN plain = '' THEN 'empty' ELSE 'unlisted' END END AS reason, n
    FROM raws LEFT JOIN spellings a ON a.spelling = plain LEFT JOIN spellings b ON b.spelling || 's' = plain""")
def canonical_unit(t: Tables) -> DataFrame:
    spellings = t.spark.createDataFrame(SPELLINGS, "spelling string, unit string, times double")
    n = F.col("line") % 4
    raw = F.when(n == 0, F.concat(F.upper("unit"), F.lit("."))).when(n == 1, F.col("unit")).when(n == 2, F.concat("unit", F.lit("s "))).otherwise("Dozens")
    return X.canonical_units(t.items.select(raw.alias("raw")), spellings)


@query("SELECT case_id, string_agg(slot || ': ' || names, '; ' ORDER BY slot) AS line FROM (SELECT case_id, slot, string_agg(DISTINCT family, ', ' ORDER BY family) AS names FROM named_items GROUP BY 1, 2) GROUP BY 1")
def retrieval_text(t: Tables) -> DataFrame:
    names = t.named_items.groupBy("case_id", "slot").agg(F.array_join(F.array_sort(F.collect_set("family")), ", ").alias("names"))
    parts = F.array_sort(F.collect_list(F.concat("slot", F.lit(": "), "names")))
    return names.groupBy("case_id").agg(F.array_join(parts, "; ").alias("line"))


# Privacy.
DETECTORS = {"email": MAIL, "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "phone": r"\+?[0-9][0-9() -]{8,}[0-9]", "url": LINK, "year": r"\b(19|20)[0-9]{2}\b"}
FIELDS = {"documents.text": ("documents", "text"), "pages.url": ("pages", "url"), "conversations.text": ("conversations", "text")}
_HITS = " UNION ALL ".join(f"SELECT '{f}' AS field, '{n}' AS detector, regexp_extract_all(coalesce({c}, ''), '{p}') AS h FROM {tab}" for f, (tab, c) in FIELDS.items() for n, p in DETECTORS.items())


@query(f", hits AS ({_HITS}), counts AS (SELECT field, detector, count(*) FILTER (WHERE len(h) > 0) AS n_rows, CAST(sum(len(h)) AS BIGINT) AS n_hits FROM hits GROUP BY 1, 2), each AS (SELECT field, detector, count(DISTINCT x) AS n_distinct FROM (SELECT field, detector, unnest(h) AS x FROM hits) GROUP BY 1, 2) SELECT field, detector, n_rows, n_hits, coalesce(n_distinct, 0) AS n_distinct FROM counts LEFT JOIN each USING (field, detector)")
def pii_scan(t: Tables) -> DataFrame:
    """Personal data by field: rows, hits and how many different ones."""
    fields = [t.table(table).select(F.lit(f).alias("field"), F.col(column).alias("text")) for f, (table, column) in FIELDS.items()]
    return X.scan_fields(reduce(DataFrame.unionByName, fields), DETECTORS)


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{MAIL}', '<email>', 'g'), '{DETECTORS['ip']}', '<ip>', 'g')) AS digest FROM documents WHERE regexp_matches(text, '{MAIL}') OR regexp_matches(text, '{DETECTORS['ip']}')")
def substitute_pii(t: Tables) -> DataFrame:
    out = F.regexp_replace(F.regexp_replace("text", MAIL, "<email>"), DETECTORS["ip"], "<ip>")
    return t.documents.filter(F.col("text").rlike(MAIL) | F.col("text").rlike(DETECTORS["ip"])).select("doc_id", F.md5(out).alias("digest"))


@query("SELECT c_custkey, left(c_name, 1) || repeat('*', CAST(length(c_name) - 1 AS INTEGER)) AS masked FROM customer")
def mask_tokens(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.concat(F.left("c_name", F.lit(1)), F.expr("repeat('*', length(c_name) - 1)")).alias("masked"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE k = 1) AS n_unique, round(count(*) FILTER (WHERE k = 1) / count(*), 6) AS share FROM (SELECT count(*) OVER (PARTITION BY segment, nation, floor(balance / 500)) AS k FROM profiles)")
def quasi_identifier_uniqueness(t: Tables) -> DataFrame:
    k = t.profiles.groupBy("segment", "nation", F.floor(F.col("balance") / 500).alias("band")).agg(F.count("*").alias("k"))
    unique = F.count_if(F.col("k") == 1)
    return k.agg(F.sum("k").alias("n"), unique.alias("n_unique"), F.round(unique / F.sum("k"), 6).alias("share"))


@query(r""", tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS w FROM documents),
    names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_extract(url, '://([^/?#]*)', 1)), '[a-z]{5,}')) AS w FROM pages), digests AS (SELECT sha256('salt' || w) AS digest FROM names)
    SELECT doc_id, count(*) FILTER (WHERE sha256('salt' || w) IN (SELECT digest FROM digests)) AS n_hits, count(*) AS n_words FROM tok GROUP BY 1""")
def hashed_dictionary_hits(t: Tables) -> DataFrame:
    """The names of hosts, as a dictionary of salted digests, in the words of documents."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    names = t.pages.select(F.explode(F.regexp_extract_all(host, F.lit("[a-z]{5,}"), F.lit(0))).alias("w")).distinct()
    return X.hashed_hits(t.documents, names.select(X.salted(F.col("w"), "salt").alias("digest")), key="doc_id", text="text", salt="salt")


@query(f"SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '[0-9]{{3,}}') AS sensitive, CASE WHEN NOT regexp_matches(coalesce(text, ''), '[0-9]{{3,}}') THEN md5(coalesce(text, '')) END AS public FROM conversations")
def split_sensitive(t: Tables) -> DataFrame:
    sensitive = body().rlike("[0-9]{3,}")
    return t.conversations.select("conv_id", "turn", sensitive.alias("sensitive"), F.when(~sensitive, F.md5(body())).alias("public"))


@query("SELECT doc_id, length(coalesce(text, '')) >= 20000 OR coalesce(text, '') LIKE '%Licensed under%' AS carryover FROM documents")
def carryover_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ((F.length(body()) >= 20000) | body().like("%Licensed under%")).alias("carryover"))


@query(r""", words AS (SELECT page_id, list_filter(string_split_regex(lower(coalesce(url, '')), '[^\p{L}]+'), lambda x: x <> '') AS w FROM pages),
    allowed AS (SELECT word FROM (SELECT DISTINCT page_id, unnest(w) AS word FROM words) GROUP BY 1 HAVING count(*) >= 5),
    each AS (SELECT page_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words)
    SELECT p.page_id, coalesce(string_agg(CASE WHEN a.word IS NULL THEN left(sha256('salt' || e.word), 8) ELSE e.word END, ' ' ORDER BY pos) FILTER (WHERE e.word IS NOT NULL), '') AS masked, count(*) FILTER (WHERE e.word IS NOT NULL AND a.word IS NULL) AS n_masked
    FROM words p LEFT JOIN each e USING (page_id) LEFT JOIN allowed a ON a.word = e.word GROUP BY 1""")
def allowlist_mask(t: Tables) -> DataFrame:
    """URLs of which only the words stay that at least five pages have."""
    return X.mask_unlisted(t.pages, X.common_words(t.pages, text="url", least=5), key="page_id", text="url", salt="salt")


@query("SELECT text AS note, count(*) AS n, count(DISTINCT conv_id) AS n_cases FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def note_statistics(t: Tables) -> DataFrame:
    return t.conversations.filter("text IS NOT NULL").groupBy(F.col("text").alias("note")).agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_cases"))


THEMES = {"licence": "licensed under [a-z]+", "insult": "idiot|moron|clown|stupid", "address": "[a-z0-9.]+@[a-z0-9-]+[.][a-z]+"}
_SAID = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS theme, regexp_extract_all(lower(coalesce(text, '')), '{p}') AS w FROM documents" for n, p in THEMES.items())


@query(f", said AS (SELECT DISTINCT doc_id, theme, trim(unnest(w)) AS wording FROM ({_SAID})), counts AS (SELECT theme, wording, count(*) AS n FROM said GROUP BY 1, 2), usual AS (SELECT theme, wording AS usual, n AS n_usual FROM counts QUALIFY row_number() OVER (PARTITION BY theme ORDER BY n DESC, wording) = 1) SELECT s.theme, count(DISTINCT doc_id) AS support, count(DISTINCT wording) AS wordings, any_value(usual) AS usual, any_value(n_usual) AS n_usual FROM said s JOIN usual u ON u.theme = s.theme GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def canonical_themes(t: Tables) -> DataFrame:
    return X.theme_wordings(t.documents, THEMES, key="doc_id", text="text", least=2)


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS n_labelled, count(*) FILTER (WHERE l.quality = 1) AS n_good, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_zero FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def reconciliation(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality", F.lit(True).alias("marked")), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("marked").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("marked").isNull()).alias("n_zero"))

"""The queries of this package: thin applications of its operators to the given tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import row_hash
from casework.llm.embedding_dedup import embedding_dedup
from casework.llm.exact_dedup import exact_dedup
from casework.llm.language_model import lm_scores
from casework.llm.lexical_search import lexical_search
from casework.llm.licences import known_digests, licence_scan
from casework.llm.line_dedup import line_decisions
from casework.llm.mixing import mix_sources
from casework.llm.near_dedup import near_dedup
from casework.llm.packing import pack_documents
from casework.llm.quality import quality_scores
from casework.llm.spelling import spelling_variants
from casework.llm.token_counts import redacted_token_counts
from casework.llm.url_filter import url_verdicts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return redacted_token_counts(
        _table(spark, sf_dir, "documents"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    counts = docs.select("doc_id", row_hash("text").alias("text_hash"), lines.alias("n_lines"))
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return counts.join(line_decisions(docs), ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), F.array_join(dropped, ",").alias("dropped_lines")
    )


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_scan(_table(spark, sf_dir, "documents"), known_digests(spark))
    return found.withColumn("licences", F.array_join("licences", ","))


#: Fixed values of the query: verdict, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Which pages make up the list of URLs to block: the URLs as they stand whose MD5 begins so.
LISTED_MD5 = "0"


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.md5(F.encode("url", "UTF-8")).startswith(LISTED_MD5)).select("url")
    return url_verdicts(pages, listed, URL_RULES)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), size=4)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer=word_tokenizer())


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return lm_scores(_table(spark, sf_dir, "documents"), learn=tenth != 0, tune=tenth == 1)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = (
    op1_quality_classifier,
    op2_exact_dedup,
    op3_token_counts,
    op4_line_dedup,
    op5_licence_scan,
    op6_url_filter,
    op7_mix_sources,
    op8_minhash_near_dedup,
    op9_best_fit_packing,
    op10_embedding_dedup,
    op11_lm_scores,
    op12_spelling_variants,
    op13_lexical_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


ORACLES = {
    "op13_lexical_search": r"""
        WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        all_docs AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
        counts AS (SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY doc_id, term),
        weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, all_docs GROUP BY term),
        adds AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))) AS adds
            FROM counts JOIN weights USING (term) JOIN lengths USING (doc_id), all_docs),
        scores AS (SELECT item_id, doc_id, sum(adds)::BIGINT AS score FROM asked JOIN adds USING (term) GROUP BY item_id, doc_id)
        SELECT item_id, row_number() OVER best AS rank, doc_id, score FROM scores WHERE score > 0
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 20
    """,
    # A page is listed when its canonical URL is that of a URL whose MD5 begins with 0.
    "op6_url_filter": r"""
        WITH cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        parts AS (SELECT page_id, url, rest,
            coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
        rules AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
            ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS r(verdict, rule_host, rule_path)),
        fits AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                        arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM parts JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
        asked AS (SELECT page_id, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS q FROM parts WHERE rest IS NOT NULL),
        forms AS (SELECT page_id, url, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
                || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM parts JOIN asked USING (page_id)),
        listed AS (SELECT DISTINCT canonical FROM forms WHERE starts_with(md5(url), '0'))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
               l.canonical IS NOT NULL AS listed
        FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id LEFT JOIN forms c ON p.page_id = c.page_id
            LEFT JOIN listed l ON c.canonical = l.canonical
    """,
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

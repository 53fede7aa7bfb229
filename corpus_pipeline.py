"""Corpus pipeline: quality classifier, line dedup, near dedup, mixing, packing, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import WORD, plain_text, stored
from casework.llm.line_dedup import line_dedup
from casework.llm.mixing import mix_sources
from casework.llm.near_dedup import near_dedup
from casework.llm.packing import pack_documents
from casework.llm.quality import with_quality
from casework.llm.queries import word_tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, whole and unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_quality(docs, labels).filter("predicted = 1").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, n_chars follows; a document goes when all its lines stand in others, not when it had none."""
    rows = docs.select("doc_id", "text", F.length("text").alias("before"), F.struct("*").alias("row"))
    left = line_dedup(rows).filter("NOT coalesce(text = '' AND before > 0, false)")
    now = F.col("row").withField("text", F.col("text")).withField("n_chars", F.length("text").cast("long"))
    return left.select(now.alias("row")).select("row.*")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, the first as the rows are read. Rows are told apart by a number that is
    written with them, so repeated and null ids lose nothing but copies, and no column name can clash."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")))
    kept = near_dedup(rows.select("number", "row.text"), id_col="number").filter("kept").select(F.col("doc_id").alias("number"))
    return rows.join(kept, "number", "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents of one source, id and size are taken alike."""
    copies = mix_sources(docs).filter("copies > 0").select("source", "doc_id", "size", "copies").distinct()
    size = F.regexp_count(plain_text(), F.lit(WORD)).cast("long")
    rows = docs.select(F.col("source").alias("of"), F.col("doc_id").alias("id"), size.alias("words"), F.struct("*").alias("row"))
    same = F.col("source").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("words"))
    turns = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.join(copies, same).select("row", turns.alias("turn")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer=word_tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mix_sources", mix),
    ("pack", pack),
]

#: The classifier and the hashes of the other stages cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written once to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs

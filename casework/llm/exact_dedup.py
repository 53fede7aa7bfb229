"""Exact de-duplication of whole texts with skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import plain_text


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text. The row with the largest id of a group stays.
    Three combining steps, each grouping by digest *and* whole text, so equal digests never decide alone:
    map-side (each task merges its own copies), per salt (a hot text is spread over ``salts`` reducers), and
    across salts (at most ``salts`` rows per text). Each document then looks its group up by digest, length and a
    second hash; AQE splits the hot key of that join, which carries no text.

    Defined results: rows that repeat both id and text all count in group_size and are all kept when theirs is the
    largest id; null ids rank below all others, and a group of null ids only keeps them; an empty table gives an
    empty result; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"))
    by_text = [F.sha2("text", 256).alias("text_sha256"), F.col("text")]
    salted = rows.groupBy(*by_text, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("n")
    )
    groups = (
        salted.groupBy("text_sha256", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .select("text_sha256", F.length("text").alias("n_chars"), F.xxhash64("text").alias("second"), "keep_id", "group_size")
    )
    keyed = rows.select("doc_id", by_text[0], F.length("text").alias("n_chars"), F.xxhash64("text").alias("second"))
    return keyed.join(groups, ["text_sha256", "n_chars", "second"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )

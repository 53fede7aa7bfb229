"""Pieces that several operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a side of a join may have to be broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 50_000


def plain_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_hash(text_col: str = "text") -> Column:
    """What tells rows of one id apart, as ids may be repeated or null: a hash of the text."""
    return F.xxhash64(F.lit("row"), plain_text(text_col))


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the folder in spark.checkpoint.dir; only a local session (tests) may go without and gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="casework-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute the rows once and cut their lineage, in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a side whose counted rows are few; a larger one keeps Spark's shuffled join, which splits skewed keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unit_interval(*columns: Column | int) -> Column:
    """A number in [0, 1) that depends on the arguments only."""
    return F.pmod(F.xxhash64(*[F.lit(c) if isinstance(c, int) else c for c in columns]), F.lit(1 << 53)) / F.lit(float(1 << 53))


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as compressed Parquet into the shared checkpoint folder and read them back: for wide rows that
    several jobs read. The folder is deleted when the application ends."""
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)

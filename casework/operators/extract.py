"""Measurements read out of report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ``name value unit low-high`` and ``name low-high value``.
FULL = r"^\s*(\p{L}[\p{L}_ ]*?)\s+(\d+(?:[.,]\d+)?)\s+([^\s\d]\S*)\s+(\d+(?:[.,]\d+)?)\s*-\s*(\d+(?:[.,]\d+)?)\s*$"
SHORT = r"^\s*(\p{L}[\p{L}_ ]*?)\s+(\d+(?:[.,]\d+)?)\s*-\s*(\d+(?:[.,]\d+)?)\s+(\d+(?:[.,]\d+)?)\s*$"


def extract_measure_rows(reports: DataFrame, *, id_col: str = "id", text_col: str = "text", enough: int = 8) -> DataFrame:
    """(id, pos, name, value, unit, low, high, level, reason, unreliable): the lines of a report that are measurements.

    Level 1 is below the range, 2 within, 3 above, with the reason in words. A report of fewer than ``enough`` such lines is
    marked unreliable. Other lines, ranges whose low is above their
    high, null and empty reports give no row."""
    lines = reports.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), r"\r?\n")).alias("pos", "line"))
    full, short = F.regexp_extract("line", FULL, 1) != "", F.regexp_extract("line", SHORT, 1) != ""

    def part(in_full: int, in_short: int | None):
        other = F.lit(None).cast("string") if in_short is None else F.when(short, F.regexp_extract("line", SHORT, in_short))
        return F.when(full, F.regexp_extract("line", FULL, in_full)).otherwise(other)

    number = lambda text: F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    rows = lines.filter(full | short).select(
        "id", F.col("pos").cast("int").alias("pos"), F.lower(part(1, 1)).alias("name"), number(part(2, 4)).alias("value"), part(3, None).alias("unit"), number(part(4, 2)).alias("low"), number(part(5, 3)).alias("high")
    )
    rows = rows.filter("low <= high")
    level = F.when(F.col("value") < F.col("low"), 1).when(F.col("value") > F.col("high"), 3).otherwise(2)
    reason = F.when(level == 1, "below the range").when(level == 3, "above the range").otherwise("within the range")
    few = F.count("*").over(Window.partitionBy("id")) < enough
    return rows.select("*", level.alias("level"), reason.alias("reason"), few.alias("unreliable"))

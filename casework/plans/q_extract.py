"""Queries of measurements read out of reports. Reports are written from each entity's readings of one day; the SQL twin never
parses but says what they were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators import extract as X
from casework.plans.registry import query
from casework.sources.tables import Tables


def reports(t: Tables) -> DataFrame:
    """(id, text): one report for each entity, a line for each reading in two shapes, and lines that are no measurements."""
    value = F.format_string("%.2f", F.col("value"))
    line = F.when(F.col("event_id") % 2 == 0, F.format_string("%s %s mg/l 10.00-60.00", F.initcap("marker"), value)).otherwise(F.format_string("%s 10,0 - 60,0 %s", F.col("marker"), value))
    rows = t.series.filter("value >= 0").select("entity_id", "event_id", line.alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"])
    return rows.groupBy(F.col("entity_id").alias("id")).agg(F.concat(F.lit("Report of the laboratory\n"), F.array_join(lines, "\n"), F.lit("\nsigned 12")).alias("text"))


@query(""", numbered AS (SELECT entity_id AS id, event_id, marker, CAST(printf('%.2f', value) AS DOUBLE) AS value, row_number() OVER (PARTITION BY entity_id ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY entity_id) AS n
        FROM series WHERE value >= 0)
    SELECT id, CAST(pos AS INT) AS pos, lower(marker) AS name, value, CASE WHEN event_id % 2 = 0 THEN 'mg/l' END AS unit, 10.0::DOUBLE AS low, 60.0::DOUBLE AS high, CASE WHEN value < 10 THEN 1 WHEN value > 60 THEN 3 ELSE 2 END AS level,
        CASE WHEN value < 10 THEN 'below the range' WHEN value > 60 THEN 'above the range' ELSE 'within the range' END AS reason, n < 8 AS unreliable FROM numbered""")
def extract_measure_rows(t: Tables) -> DataFrame:
    return X.extract_measure_rows(reports(t))

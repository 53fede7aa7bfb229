"""Consensus over what the neighbours' cases say in words: by theme, then by wording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A theme: its name, the pattern that its wordings match, and the text that stands for it.
Theme = tuple[str, str, str]


def plain_note(note: Column) -> Column:
    """Lower case, single spaces, trimmed: notes that are equal so are one."""
    return F.lower(F.trim(F.regexp_replace(note, r"\s+", " ")))


def themes_in(plain: Column, themes: Sequence[Theme]) -> Column:
    """The names of the themes whose pattern a plain note matches."""
    return F.array_compact(F.array(*[F.when(plain.rlike(pattern), F.lit(name)) for name, pattern, _ in themes]).cast("array<string>"))


def note_consensus(
    neighbours: DataFrame, notes: DataFrame, themes: Sequence[Theme], *, share: float, floor: int = 2, least: int = 0, artefact: str | None = None
) -> DataFrame:
    """The notes that enough neighbours of each query agree on: query_id, place (from 1), source, text, support, best_rank.

    ``neighbours``: query_id, case_id, rank; ``notes``: case_id, note. A theme counts once a case however it is worded; it
    is said, in its own words, when at least ``share`` of the query's neighbours and at least ``floor`` have it. What no theme
    covers competes as wording, under the same two bounds; with fewer than ``least`` notes in all, the next wordings that
    ``floor`` cases share fill up. Themes come first, each part by falling support, then by the best rank of a neighbour that
    has it, then by name. A text that two would say is said once, where it comes first.

    No note of fewer than ``floor`` cases is ever said, so no single person's sentence goes into another's plan. The work
    is a join of neighbours with their notes and two grouped counts; themes are matched once for each different note.
    Null and blank notes and those that match ``artefact`` are left out; a query whose neighbours say nothing gives no row."""
    k = neighbours.groupBy("query_id").agg(F.count("*").alias("k"))
    said = notes.select("case_id", F.trim("note").alias("wording"), plain_note(F.col("note")).alias("plain")).filter("plain <> ''")
    if artefact is not None:
        said = said.filter(~F.col("plain").rlike(artefact))
    once = said.groupBy("case_id", "plain").agg(F.min("wording").alias("wording")).withColumn("themes", themes_in(F.col("plain"), themes))
    held = neighbours.select("query_id", "case_id", "rank").join(once, "case_id")

    counted = [F.count_distinct("case_id").alias("support"), F.min("rank").alias("best_rank")]
    enough = (F.col("support") >= F.lit(share) * F.col("k") - 1e-9) & (F.col("support") >= floor)
    words = {name: text for name, _, text in themes}
    canonical = F.coalesce(*[F.when(F.col("name") == n, F.lit(text)) for n, text in words.items()], F.lit(None).cast("string"))
    by_theme = held.select("query_id", "case_id", "rank", F.explode("themes").alias("name")).groupBy("query_id", "name").agg(*counted)
    by_theme = by_theme.join(k, "query_id").filter(enough).withColumn("text", canonical)
    first = Window.partitionBy("query_id", plain_note(F.col("text"))).orderBy(F.desc("support"), "best_rank", "name")
    by_theme = by_theme.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")

    literal = held.filter(F.size("themes") == 0).groupBy("query_id", F.col("plain").alias("name"))
    # The wording of the closest neighbour that has it stands for all that are equal but for case and spaces.
    literal = literal.agg(*counted, F.min_by("wording", F.struct("rank", "case_id")).alias("text")).filter(F.col("support") >= floor)
    order = Window.partitionBy("query_id").orderBy(F.desc("support"), "best_rank", "name")
    n_themes = by_theme.groupBy("query_id").agg(F.count("*").alias("n_themes"))
    literal = literal.join(k, "query_id").join(n_themes, "query_id", "left").withColumn("at", F.row_number().over(order))
    literal = literal.filter(enough | (F.col("at") + F.coalesce("n_themes", F.lit(0)) <= least))
    said_already = by_theme.select("query_id", plain_note(F.col("text")).alias("name"))
    literal = literal.join(said_already, ["query_id", "name"], "left_anti")

    columns = ["query_id", "name", "text", "support", "best_rank"]
    both = by_theme.select(*columns, F.lit("theme").alias("source")).unionByName(literal.select(*columns, F.lit("wording").alias("source")))
    place = Window.partitionBy("query_id").orderBy("source", F.desc("support"), "best_rank", "name")
    return both.withColumn("place", F.row_number().over(place)).select("query_id", "place", "source", "text", "support", "best_rank")

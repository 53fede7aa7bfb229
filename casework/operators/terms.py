"""Words against lists of words with room for slips: an index of deletions, joined by equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def deletions(word: Column, most: int) -> Column:
    """The word and what is left of it without any one character (``most`` 1), or any one or two (2).

    Two words within ``most`` edits of each other share one of these, whatever the edit and wherever it is."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    safe = lambda w: F.when(F.length(w) > 0, without(w)).otherwise(F.array().cast("array<string>"))
    out, last = F.array(word), F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, safe)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def within_edits(words: DataFrame, terms: DataFrame, *, word: str = "word", term: str = "term", most: int = 2) -> DataFrame:
    """(word, term, edits): the words at most ``most`` edits from a term; equal ones included, with 0.

    Both sides are tables of different words. Each is exploded into its deletions, met by equality and confirmed by the edit distance,
    so a word meets only terms it may be close to: no side is compared throughout, and slips in the first letters count like others."""
    one = words.select(F.col(word).alias("word")).distinct().select("word", F.explode(deletions(F.col("word"), most)).alias("key"))
    other = terms.select(F.col(term).alias("term")).distinct().select("term", F.explode(deletions(F.col("term"), most)).alias("key"))
    met = one.join(other, "key").select("word", "term").distinct()
    return met.withColumn("edits", F.levenshtein("word", "term").cast("long")).filter(F.col("edits") <= most)


def room(term: Column) -> Column:
    """How many slips a term of its length may have: none under four letters, one under seven, else two."""
    return F.when(F.length(term) < 4, 0).when(F.length(term) < 7, 1).otherwise(2)


def read_categories(texts: DataFrame, terms: DataFrame, *, key: str, text: str, measures: dict[str, tuple[str, float, float]] | None = None) -> DataFrame:
    """(key, category, secondary, clean, *measures): what a short text says it is, slips included.

    ``terms``: category, term (folded, several for a category). The category of the word that comes first counts, ``secondary`` is the
    next other one; ``clean`` says that the text is one word which is a term as it stands. ``measures`` rescues numbers that
    were written into the text: a pattern with the number as its first group, and the range that it must lie in. Different
    words are looked up once each, however many texts have them. Null and empty texts have no category and are not clean."""
    folded = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = texts.select(F.col(key).alias("__key"), F.posexplode(F.filter(F.split(folded, r"[^\p{L}]+"), lambda w: w != "")).alias("at", "word"))
    listed = terms.select("category", "term").distinct()
    near = within_edits(words.select("word"), listed).filter(F.col("edits") <= room(F.col("term"))).join(listed, "term")
    closest = near.groupBy("word").agg(F.min_by("category", F.struct("edits", "term", "category")).alias("category"), F.min("edits").alias("edits"))
    hits = words.join(closest, "word").groupBy("__key", "category").agg(F.min("at").alias("at"), F.min("edits").alias("edits"))
    order = Window.partitionBy("__key").orderBy("at", "category")
    ranked = hits.withColumn("n", F.row_number().over(order))
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    read = ranked.groupBy("__key").agg(pick(1, "category").alias("category"), pick(2, "category").alias("secondary"), pick(1, "edits").alias("edits"))
    rescued = []
    for name, (pattern, low, high) in (measures or {}).items():
        value = F.replace(F.regexp_extract(folded, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        rescued.append(F.when(value.between(low, high), value).alias(name))
    alone = F.size(F.filter(F.split(folded, r"[^\p{L}]+"), lambda w: w != "")) == 1
    rows = texts.select(F.col(key).alias("__key"), alone.alias("alone"), *rescued).join(read, "__key", "left")
    clean = F.coalesce(F.col("alone") & (F.col("edits") == 0), F.lit(False))
    return rows.select(F.col("__key").alias(key), "category", "secondary", clean.alias("clean"), *(measures or {}))


def synonym_audit(forms: DataFrame, *, units: Sequence[str] = (), least: int = 5) -> DataFrame:
    """(form, canonical, kind, other): what is doubtful in a list of synonyms. ``forms``: canonical, form, n (how often it occurs).

    ``slip``: one or two edits from a form that occurs more often (words of ``least`` letters at least); ``split``: two words that
    together are another form; ``glued``: one word that is two other forms, or a form and a unit, run together; ``unit``: a word for an amount; ``shared``: listed under several names;
    ``name``: it is itself the name of another entry. Forms that tie are no slips of each other."""
    rows = forms.groupBy("form", "canonical").agg(F.sum("n").alias("n"))
    each = rows.groupBy("form").agg(F.sum("n").alias("n"))
    single = each.filter(~F.contains("form", F.lit(" ")) & (F.length("form") >= least))
    slips = within_edits(single, single, word="form", term="form").filter("edits > 0").select(F.col("word").alias("form"), F.col("term").alias("other"))
    counts = each.select(F.col("form").alias("other"), F.col("n").alias("m"))
    slips = slips.join(each, "form").join(counts, "other").filter("n < m").select("form", "other", F.lit("slip").alias("kind"))
    joined = F.concat(*[F.element_at(F.split("form", " "), i) for i in (1, 2)])
    split = each.filter(F.size(F.split("form", " ")) == 2).select("form", joined.alias("other")).join(each.select(F.col("form").alias("other")), "other").select("form", "other", F.lit("split").alias("kind"))
    cuts = F.explode(F.sequence(F.lit(2), F.length("form") - 2))
    pieces = each.filter(~F.contains("form", F.lit(" ")) & (F.length("form") >= 4)).select("form", cuts.alias("at")).select("form", F.substring("form", F.lit(1), F.col("at")).alias("head"), F.substring("form", F.col("at") + 1, F.length("form")).alias("tail"))
    words = each.select("form").unionByName(forms.sparkSession.createDataFrame([(u,) for u in units], "form string")).distinct()
    glued = pieces.join(each.select(F.col("form").alias("head")), "head").join(words.select(F.col("form").alias("tail")), "tail").select("form", F.concat_ws(" ", "head", "tail").alias("other"), F.lit("glued").alias("kind"))
    unit = each.filter(F.col("form").isin(list(units))).select("form", F.lit(None).cast("string").alias("other"), F.lit("unit").alias("kind"))
    shared = rows.groupBy("form").agg(F.count("*").alias("k"), F.min("canonical").alias("other")).filter("k > 1").select("form", "other", F.lit("shared").alias("kind"))
    name = rows.join(rows.select(F.col("canonical").alias("other")).distinct(), F.col("form") == F.col("other")).filter("canonical <> other").select("form", "other", F.lit("name").alias("kind")).distinct()
    found = slips
    for part in (split, glued, unit, shared, name):
        found = found.unionByName(part.select("form", "other", "kind"))
    return rows.select("form", "canonical").join(found, "form").filter("kind <> 'name' OR canonical <> other").select("form", "canonical", "kind", "other")

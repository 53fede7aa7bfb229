"""Texts against tables of words, patterns and spellings that the user brings; what no entry covers is always part of the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def salted(word: Column, salt: str) -> Column:
    """What stands for a word in a dictionary that must not show its words."""
    return F.sha2(F.concat(F.lit(salt), word), 256)


def label_by_patterns(texts: DataFrame, rules: Sequence[tuple[str, str, int]], *, key: str, text: str) -> DataFrame:
    """(key, labels, main, compound, covered): the labels whose pattern a text matches. ``rules``: label, pattern, priority; several may have a label.

    Labels come by falling priority, then in the order given; ``main`` is the first, ``compound`` says there are others, ``covered`` that there is any."""
    order = sorted(range(len(rules)), key=lambda i: (-rules[i][2], i))
    hits = F.array(*[F.when(_text(text).rlike(rules[i][1]), F.lit(rules[i][0])) for i in order]).cast("array<string>")
    rows = texts.select(F.col(key), F.array_distinct(F.array_compact(hits)).alias("l"))
    return rows.select(key, F.array_join("l", ",").alias("labels"), F.get("l", F.lit(0)).alias("main"), (F.size("l") > 1).alias("compound"), (F.size("l") > 0).alias("covered"))


def label_by_signals(texts: DataFrame, signals: Sequence[tuple[str, str, int]], *, key: str, text: str, most: int = 4, names: str | None = None, overrides: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(key, label, score): the label whose signals weigh most in a text. ``signals``: label, pattern (on the text in lower case), weight; several may have a label.

    A signal counts its hits up to ``most`` times its weight. No hit gives ``unclassified``, two labels of the same highest score ``ambiguous``.
    ``overrides``: pattern, label; the first that the column ``names`` matches decides instead, whatever the text says."""
    weights: dict[str, list[Column]] = {}
    for label, pattern, weight in signals:
        weights.setdefault(label, []).append(F.least(F.regexp_count(F.lower(_text(text)), F.lit(pattern)), F.lit(most)) * weight)
    scores = F.array_sort(F.array(*[F.struct((-sum(parts[1:], parts[0])).alias("less"), F.lit(label).alias("label")) for label, parts in sorted(weights.items())]))
    named = [] if names is None else [F.when(_text(names).rlike(pattern), F.lit(label)) for pattern, label in overrides]
    rows = texts.select(key, scores.alias("s"), (F.coalesce(*named) if named else F.lit(None).cast("string")).alias("named"))
    first, tied = F.col("s")[0], F.col("s")[0]["less"] == F.get("s", F.lit(1))["less"]
    label = F.when(F.col("named").isNotNull(), F.col("named")).when(first["less"] == 0, "unclassified").when(tied, "ambiguous").otherwise(first["label"])
    return rows.select(key, label.alias("label"), (-first["less"]).alias("score"))


def first_rule(rows: DataFrame, rules: Sequence[tuple[str, str, str]], *, column: str, other: str = "unmapped") -> DataFrame:
    """The rows with ``class`` and ``reason`` of the first rule (pattern, class, reason) that the column matches, else ``other`` without a reason."""
    first = F.coalesce(*[F.when(_text(column).rlike(p), F.struct(F.lit(k).alias("class"), F.lit(why).alias("reason"))) for p, k, why in rules])
    held = rows.withColumn("__rule", first)
    return held.withColumn("class", F.coalesce(F.col("__rule.class"), F.lit(other))).withColumn("reason", F.col("__rule.reason")).drop("__rule")


def screen_terms(texts: DataFrame, terms: DataFrame, *, key: str, text: str, limit: int, mask: str = "***") -> DataFrame:
    """(key, mentions, terms, weight, dropped, redacted): texts that hold listed terms. ``terms``: term (lower case), weight.

    Words meet the list by an equi-join, so it may be of any length. A text whose mentions weigh ``limit`` or more is dropped;
    ``redacted`` has every term replaced by ``mask`` and all else, case and spaces included, as it was. Texts without a term are not in the result."""
    pieces = texts.select(F.col(key), F.posexplode(F.regexp_extract_all(_text(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))).alias("pos", "piece"))
    listed = terms.groupBy(F.col("term").alias("folded")).agg(F.max("weight").alias("weight"))
    found = pieces.withColumn("folded", F.lower("piece")).join(listed, "folded", "left")
    # A text's own pieces in order: one row again for each text.
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("weight").isNotNull(), F.lit(mask)).otherwise(F.col("piece")).alias("piece")))), lambda x: x["piece"]), "")
    counted = found.groupBy(key).agg(F.count("weight").alias("mentions"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("weight").isNotNull(), F.col("folded")))), ",").alias("terms"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), whole.alias("redacted"))
    return counted.filter("mentions > 0").select(key, "mentions", "terms", "weight", (F.col("weight") >= limit).alias("dropped"), "redacted")


def hashed_hits(texts: DataFrame, digests: DataFrame, *, key: str, text: str, salt: str) -> DataFrame:
    """(key, n_hits, n_words): how many of a text's different words are in a dictionary of salted digests (column ``digest``), of how many. Each different word is
    hashed once, however many texts hold it."""
    words = texts.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(_text(text)), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    known = words.select("word").distinct().withColumn("digest", salted(F.col("word"), salt)).join(digests.select("digest").distinct(), "digest", "left_semi").select("word", F.lit(1).alias("hit"))
    return words.join(known, "word", "left").groupBy(key).agg(F.count("hit").alias("n_hits"), F.count("*").alias("n_words"))


def mask_unlisted(texts: DataFrame, allowed: DataFrame, *, key: str, text: str, salt: str, digits: int = 8) -> DataFrame:
    """(key, masked, n_masked): a text's words in order, those that ``allowed`` (column ``word``) does not list as the first digits of a salted digest."""
    words = F.filter(F.split(F.lower(_text(text)), r"[^\p{L}]+"), lambda w: w != "")
    rows = texts.select(F.col(key), F.posexplode_outer(words).alias("pos", "word")).join(allowed.select("word", F.lit(True).alias("known")).distinct(), "word", "left")
    shown = F.when(F.col("known"), F.col("word")).otherwise(F.left(salted(F.col("word"), salt), F.lit(digits)))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", shown.alias("w"))))), lambda x: x["w"]), " ")
    return rows.groupBy(key).agg(line.alias("masked"), F.count_if(F.col("word").isNotNull() & F.col("known").isNull()).alias("n_masked"))


def common_words(texts: DataFrame, *, text: str, least: int) -> DataFrame:
    """(word, n): the words that at least ``least`` texts hold: a list of what is safe to show, mined from the texts themselves."""
    words = texts.select(F.explode(F.array_distinct(F.filter(F.split(F.lower(_text(text)), r"[^\p{L}]+"), lambda w: w != ""))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def scan_fields(fields: DataFrame, detectors: dict[str, str]) -> DataFrame:
    """(field, detector, n_rows, n_hits, n_distinct): what personal data there is by field. ``fields``: field, text.

    Every hit is a row of its digest only, so hits are counted and told apart without being kept; fields without any have a row of zeros."""
    each = F.array(*[F.struct(F.lit(n).alias("detector"), F.regexp_extract_all(_text("text"), F.lit(p), F.lit(0)).alias("hits")) for n, p in detectors.items()])
    rows = fields.select("field", F.explode(each).alias("d")).select("field", "d.detector", F.transform("d.hits", lambda h: F.xxhash64(h)).alias("hits"))
    counts = rows.groupBy("field", "detector").agg(F.count_if(F.size("hits") > 0).alias("n_rows"), F.sum(F.size("hits")).cast("long").alias("n_hits"))
    different = rows.select("field", "detector", F.explode("hits").alias("h")).groupBy("field", "detector").agg(F.count_distinct("h").alias("n_distinct"))
    return counts.join(different, ["field", "detector"], "left").select("field", "detector", "n_rows", "n_hits", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def theme_wordings(texts: DataFrame, themes: dict[str, str], *, key: str, text: str, least: int) -> DataFrame:
    """(theme, support, wordings, usual, n_usual): for each theme's pattern the texts that say it, in how many wordings, and the one that most
    texts use (ties by name); themes of fewer than ``least`` texts are left out."""
    hits = F.array(*[F.struct(F.lit(n).alias("theme"), F.regexp_extract_all(F.lower(_text(text)), F.lit(p), F.lit(0)).alias("w")) for n, p in themes.items()])
    said = texts.select(F.col(key), F.explode(hits).alias("h")).select(key, "h.theme", F.explode(F.array_distinct(F.transform("h.w", lambda w: F.trim(w)))).alias("wording"))
    counts = said.groupBy("theme", "wording").agg(F.count_distinct(key).alias("n"))
    first = Window.partitionBy("theme").orderBy(F.desc("n"), "wording")
    usual = counts.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("theme", F.col("wording").alias("usual"), F.col("n").alias("n_usual"))
    support = said.groupBy("theme").agg(F.count_distinct(key).alias("support"), F.count_distinct("wording").alias("wordings"))
    return support.filter(F.col("support") >= least).join(usual, "theme")


def canonical_units(raw: DataFrame, spellings: DataFrame, *, column: str = "raw") -> DataFrame:
    """(raw, unit, times, known, reason, n): spellings of units counted and brought to one. ``spellings``: spelling (lower case, without dots), unit, times.

    A plural in s counts as its singular; what is not listed stays as it is, in lower case, with the reason: empty or unlisted."""
    counts = raw.groupBy(F.col(column).alias("raw")).agg(F.count("*").alias("n"))
    plain = F.btrim(F.lower(F.coalesce("raw", F.lit(""))), F.lit(" ."))
    rows = counts.withColumn("spelling", plain)
    one = rows.join(spellings.select("spelling", "unit", "times"), "spelling", "left")
    singular = spellings.select(F.concat("spelling", F.lit("s")).alias("spelling"), F.col("unit").alias("unit_s"), F.col("times").alias("times_s"))
    both = one.join(singular, "spelling", "left")
    unit = F.coalesce("unit", "unit_s")
    reason = F.when(unit.isNotNull(), F.lit(None)).when(F.col("spelling") == "", "empty").otherwise("unlisted")
    return both.select("raw", F.coalesce(unit, "spelling").alias("unit"), F.coalesce("times", "times_s").alias("times"), unit.isNotNull().alias("known"), reason.alias("reason"), "n")

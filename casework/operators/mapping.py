"""Names written freely, resolved to a catalogue or to a list of excluded things."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.functions.columns import fold_text


def _first(hits: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def resolve_excluded(names: DataFrame, excluded: DataFrame, *, id_col: str = "id", text_col: str = "name") -> DataFrame:
    """(id, key, how): which excluded key a name falls under: its whole folded text, else its first two words, else its first
    word, else a distinctive word (``token``) anywhere in it; names under none are left out.

    ``excluded``: key, token (null where no single word is distinctive). Four equi-joins as one: each name is exploded into
    its few possible keys, each with its place in that order."""
    words = F.split(fold_text(F.col(text_col)), " ")
    whole, two, one = F.array_join(words, " "), F.array_join(F.slice(words, 1, 2), " "), F.element_at(words, 1)
    heads = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(how).alias("how"), value.alias("word")) for n, (how, value) in enumerate((("whole", whole), ("two_words", two), ("head", one)))])
    tries = F.concat(heads, F.transform(F.array_distinct(words), lambda w: F.struct(F.lit(3).alias("place"), F.lit("token").alias("how"), w.alias("word"))))
    each = names.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.inline(tries))
    keys = excluded.select(fold_text(F.col("key")).alias("word"), "key", F.lit(False).alias("by_token")).unionByName(
        excluded.filter("token IS NOT NULL").select(fold_text(F.col("token")).alias("word"), "key", F.lit(True).alias("by_token"))
    )
    hits = each.join(keys, "word").filter((F.col("how") == "token") == F.col("by_token"))
    return _first(hits, ["id"], [F.asc("place"), F.asc("key")]).select("id", "key", "how")


def map_items(components: DataFrame, catalogue: DataFrame, excluded: DataFrame) -> DataFrame:
    """Every component with its catalogue entry, or the reason that it has none.

    ``components``: line_id, alt_no, comp_no, name; ``catalogue``: key, product_id, generic. Adds component_index (from 0 over
    the line), product_id, generic and reason: mapped, excluded, no_name or unknown."""
    place = Window.partitionBy("line_id").orderBy("alt_no", "comp_no")
    rows = components.select("line_id", "alt_no", "comp_no", "name", (F.row_number().over(place) - 1).alias("component_index"), fold_text(F.col("name")).alias("folded"))
    known = catalogue.select(fold_text(F.col("key")).alias("folded"), "product_id", "generic")
    known = _first(known, ["folded"], [F.asc("product_id")])
    names = rows.filter("folded IS NOT NULL").select(F.col("folded").alias("id"), F.col("folded").alias("name")).distinct()
    out = resolve_excluded(names, excluded).select(F.col("id").alias("folded"), F.lit(True).alias("out"))
    joined = rows.join(known, "folded", "left").join(out, "folded", "left")
    reason = F.when(F.col("name").isNull(), "no_name").when(F.col("product_id").isNotNull(), "mapped").when(F.col("out"), "excluded").otherwise("unknown")
    return joined.select("line_id", "alt_no", "comp_no", "component_index", "name", "product_id", F.coalesce("generic", F.lit(False)).alias("generic"), reason.alias("reason"))


def mine_catalogue(names: DataFrame, catalogue: DataFrame, excluded: DataFrame, *, least_share: float, descriptors: Sequence[str] = (), refused: str = r"^\W*$|^\w$|\d", most_words: int = 6, name: str = "name") -> DataFrame:
    """(key, n, state, canonical): every different folded name, how often it is written, and what becomes of it.

    ``descriptor_only``: nothing but ``descriptors``, or empty; ``excluded``: see resolve_excluded, with the key it falls under;
    ``exact``: a key of the ``catalogue`` (column key); ``prefix``: begins with the words of one, the longest; ``promoted``: none of these, but
    at least ``least_share`` of all names, of at most ``most_words`` words and not of a ``refused`` shape: it may stand in the catalogue by its
    commonest writing in lower case (ties: the first in order); else ``unmapped``. Null names are not counted.

    Names are counted before anything else, so that all joins are between different names and keys, by equality."""
    folded = fold_text(F.col(name))
    written = names.filter(F.col(name).isNotNull()).groupBy(folded.alias("key"), F.lower(name).alias("written")).agg(F.count("*").alias("c"))
    counted = written.groupBy("key").agg(F.sum("c").alias("n"), F.min_by("written", F.struct(-F.col("c"), "written")).alias("common"))
    words = F.split("key", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda j: F.array_join(F.slice(words, 1, j), " "))
    known = catalogue.select(fold_text(F.col("key")).alias("start")).distinct()
    begins = counted.select("key", F.explode(starts).alias("start")).join(known, "start").groupBy("key").agg(F.max_by("start", F.length("start")).alias("start"))
    out = resolve_excluded(counted.select("key"), excluded, id_col="key", text_col="key").select(F.col("id").alias("key"), F.col("key").alias("under"))
    rows = counted.join(begins, "key", "left").join(out, "key", "left").crossJoin(F.broadcast(counted.agg(F.sum("n").alias("all"))))
    plain = F.forall(words, lambda w: (w == "") | w.isin(*descriptors)) if descriptors else F.col("key") == ""
    fit = (F.col("n") >= F.lit(least_share) * F.col("all")) & (F.size(words) <= most_words) & ~F.col("key").rlike(refused)
    state = F.when(plain, "descriptor_only").when(F.col("under").isNotNull(), "excluded").when(F.col("start") == F.col("key"), "exact")
    state = state.when(F.col("start").isNotNull(), "prefix").when(fit, "promoted").otherwise("unmapped")
    rows = rows.withColumn("state", state)
    canonical = F.when(F.col("state") == "excluded", F.col("under")).when(F.col("state").isin("exact", "prefix"), F.col("start")).when(F.col("state") == "promoted", F.col("common"))
    return rows.select("key", "n", "state", canonical.alias("canonical"))


def match_free_text(texts: DataFrame, catalogue: DataFrame, *, id_col: str = "id", text_col: str = "text", splits: str = r"\s*(?:,|;|\.|\s+(?:and|y|et|und)\s+)\s*") -> DataFrame:
    """(id, pos, fragment, product_id, how): the fragments of a text against catalogue names: equal, else equal in the
    singular, else a catalogue name's words stand together in it (the longest counts); unmatched ones stay with how null.

    ``catalogue``: key, product_id. Containment is an equi-join too: a fragment is exploded into its runs of each number of
    words that a name has, however long, so no fragment meets every name."""
    singular = lambda text: F.regexp_replace(text, r"(?<=\w{3})s\b", "")
    cleaned = F.filter(F.transform(F.split(fold_text(F.col(text_col)), splits), lambda p: F.btrim(p)), lambda p: p != "")
    parts = texts.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(cleaned).alias("pos", "fragment"))
    names = catalogue.select(fold_text(F.col("key")).alias("key"), "product_id").filter("key <> ''")
    names = _first(names, ["key"], [F.asc("product_id")]).withColumn("words", F.size(F.split("key", " ")))
    by_singular = _first(names.withColumn("one", singular(F.col("key"))), ["one"], [F.asc("product_id")]).select("one", "product_id", F.lit(0).alias("words"))
    words = F.split("fragment", " ")
    known = sorted(row["words"] for row in names.select("words").distinct().collect())  # one row for each length that a name has
    lengths = F.filter(F.array(*[F.lit(n) for n in known or [0]]), lambda n: (n > 0) & (n <= F.size(words)))
    runs = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    exact = parts.join(names.withColumnRenamed("key", "fragment"), "fragment").select("id", "pos", "product_id", F.lit(0).alias("place"), F.lit(0).alias("words"), F.lit("exact").alias("how"))
    single = parts.withColumn("one", singular(F.col("fragment"))).join(by_singular, "one").select("id", "pos", "product_id", F.lit(1).alias("place"), "words", F.lit("singular").alias("how"))
    inside = parts.select("id", "pos", F.explode(F.array_distinct(runs)).alias("key")).join(names, "key").select("id", "pos", "product_id", F.lit(2).alias("place"), "words", F.lit("contained").alias("how"))
    found = _first(reduce(DataFrame.unionByName, [exact, single, inside]), ["id", "pos"], [F.asc("place"), F.desc("words"), F.asc("product_id")])
    return parts.join(found.select("id", "pos", "product_id", "how"), ["id", "pos"], "left").select("id", F.col("pos").cast("int").alias("pos"), "fragment", "product_id", "how")


def token_overlap_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, shared, how): each left text's one right text: the same set of words, else at least two shared
    words and no other right text with as many; a right text goes to its best left one. ``left``, ``right``: id, text.

    Texts meet on pairs of words, not on single ones, so a word that stands everywhere joins nothing by itself."""

    def words(rows: DataFrame, side: str) -> DataFrame:
        return rows.filter("text IS NOT NULL").select(F.col("id").alias(f"{side}_id"), F.array_sort(F.array_distinct(F.filter(F.split(fold_text(F.col("text")), " "), lambda w: w != ""))).alias(f"{side}_words"))

    def pairs(rows: DataFrame, side: str) -> DataFrame:
        own = f"{side}_words"
        two = F.flatten(F.transform(own, lambda a: F.transform(F.filter(own, lambda b: b > a), lambda b: F.concat(a, F.lit(" "), b))))
        return rows.select(f"{side}_id", own, F.explode(two).alias("pair"))

    a, b = words(left, "left"), words(right, "right")
    same = a.join(b, F.col("left_words") == F.col("right_words")).select("left_id", "right_id", F.size("left_words").alias("shared"), F.lit("same").alias("how"))
    one_same = _first(same, ["left_id"], [F.asc("right_id")])
    rest = a.join(one_same.select("left_id"), "left_id", "left_anti")
    met = pairs(rest, "left").join(pairs(b, "right"), "pair").select("left_id", "right_id", F.size(F.array_intersect("left_words", "right_words")).alias("shared")).distinct()
    top = Window.partitionBy("left_id")
    clear = met.withColumn("most", F.max("shared").over(top)).filter("shared = most").withColumn("n", F.count("*").over(top)).filter("n = 1")
    both = one_same.unionByName(clear.select("left_id", "right_id", "shared", F.lit("overlap").alias("how")))
    return _first(both, ["right_id"], [F.desc(F.col("how") == "same"), F.desc("shared"), F.asc("left_id")])

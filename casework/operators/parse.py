"""Item lines into components: a line becomes a table of tokens, words get their roles by a join, and what belongs together is found
by running counts over the tokens of a line."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.functions.columns import fold_text
from casework.functions.lexicon import CHOICES, TOGETHER, word_table
from casework.sources.storage import written

#: Lines that a task reads at most in the mean.
LINES_PER_TASK = 20_000

#: Tokens: a time of day, a simple fraction, a share, a number, a quarter sign, a word, a mark that separates.
TOKEN = r"\d{1,2}:\d{2}(?!\d)|(?<![\d/])[1-9]/[2-9](?![\d/])|\d+(?:[.,]\d+)?%|\d+(?:[.,]\d+)?|[½¼¾]|\p{L}+(?:['’-]\p{L}+)*|[/+,:–-]"
_LINE = ["line_id", "line", "copy_no"]
_TEXT = ["line"]
_PART = [*_TEXT, "alt", "comp"]


def _has(role: str, roles: str | Column = "roles") -> Column:
    return F.coalesce(F.array_contains(roles, role), F.lit(False))


def _number(token: Column) -> Column:
    """What a number, a fraction or a quarter sign is worth; null for anything else."""
    top, below = (F.regexp_extract(token, r"^(\d+)/(\d+)$", g).try_cast("double") for g in (1, 2))
    sign = F.when(token == "½", 0.5).when(token == "¼", 0.25).when(token == "¾", 0.75)
    return F.coalesce(F.when(token.rlike(r"^\d+([.,]\d+)?$"), F.replace(token, F.lit(","), F.lit(".")).try_cast("double")), top / below, sign)


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows, dealt over tasks by their number: the tables of a task and all its sorts then fit its memory, however many rows there are."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / LINES_PER_TASK))
    return rows.repartition(tasks, *rows.columns)


def _tokens(rows: DataFrame, words: DataFrame) -> DataFrame:
    """A row for each token of each text: pos, tok, folded, roles, value (of a number), unit."""
    # What stands in brackets behind an amount is what it is an amount of; any other bracket is a note.
    opened = F.regexp_replace("line", r"(\d\s*\p{L}+\s*)\(([^()]*)\)", "$1$2")
    notes = F.filter(F.transform(F.regexp_extract_all(opened, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda n: F.btrim(n)), lambda n: n != "")
    body = F.regexp_replace(opened, r"\([^()]*\)", " ")
    each = rows.select(*_TEXT, F.nullif(F.array_join(notes, " | "), F.lit("")).alias("note"), F.posexplode_outer(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    each = each.withColumn("folded", fold_text(F.col("tok")))
    named = each.join(words, F.col("folded") == F.col("word"), "left").drop("word")
    return named.select(*_TEXT, "note", "pos", "tok", "folded", "roles", F.col("value").alias("worth"), F.col("stands_for"), _number(F.col("tok")).alias("number"))


def _without_second_numbers(tokens: DataFrame) -> DataFrame:
    """A range before a word is its mean; of several numbers with one unit the first counts."""
    w = Window.partitionBy(*_TEXT).orderBy("pos")
    near = lambda c, n: F.lead(c, n).over(w) if n > 0 else F.lag(c, -n).over(w)
    is_word = F.col("tok").rlike(r"^\p{L}")
    t = tokens.withColumn("is_word", F.coalesce(is_word, F.lit(False)))
    between = lambda n: near("folded", n).isin("o", "u", "a", "-", "–", "/")
    low = F.col("number").isNotNull() & between(1) & near("number", 2).isNotNull() & near("is_word", 3)
    t = t.withColumn("low", F.coalesce(low, F.lit(False)))
    passed = F.coalesce(near("low", -1) | near("low", -2), F.lit(False))
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    run_ends_in_unit = F.first(F.when(F.col("number").isNull() & (F.col("tok") != ","), _has("unit")), ignorenulls=True).over(ahead)
    listed = ((F.col("tok") == ",") & near("number", -1).isNotNull() & near("number", 1).isNotNull()) | (F.col("number").isNotNull() & (near("tok", -1) == ",") & near("number", -2).isNotNull())
    value = F.when(F.col("low"), (F.col("number") + near("number", 2)) / 2).otherwise(F.col("number"))
    gone = passed | F.coalesce(listed & run_ends_in_unit, F.lit(False))
    return t.withColumns({"mean": value, "gone": gone}).filter("NOT gone").withColumn("number", F.col("mean")).drop("mean", "gone", "low")


def _without_label(tokens: DataFrame) -> DataFrame:
    """What stands before the first colon goes when it holds a heading or a time, or no word at all."""
    line = Window.partitionBy(*_TEXT)
    colon = F.min(F.when(F.col("tok") == ":", F.col("pos"))).over(line)
    t = tokens.withColumn("colon", colon)
    before = F.col("pos") < F.col("colon")
    heading = F.max((before & (_has("heading") | F.col("tok").contains(":")))).over(line)
    silent = ~F.coalesce(F.max(before & F.col("is_word")).over(line), F.lit(False))
    label = F.col("colon").isNotNull() & (F.coalesce(heading, F.lit(False)) | silent)
    t = t.withColumn("label", label)
    # A line's last token stays as an empty one, so that a line of a label alone is still there.
    stays = F.coalesce(~(F.col("label") & (F.col("pos") <= F.col("colon"))) & (F.col("tok") != ":"), F.lit(True))
    last = F.col("pos") == F.max("pos").over(line)
    kept = t.withColumns({"stays": stays, "last": last}).filter("stays OR last")
    return kept.withColumns({c: F.when(F.col("stays"), F.col(c)) for c in ("tok", "folded", "roles", "number", "worth", "stands_for")}).drop("colon", "label", "stays", "last")


def _parted(tokens: DataFrame, choices: Sequence[str], together: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds ``alt`` and ``comp``, the numbers of the alternative and of the component in it that a token belongs to, and ``sep``, whether it only parts."""
    w = Window.partitionBy(*_TEXT).orderBy("pos")
    lag, lead = (lambda c, n=1: F.lag(c, n).over(w)), (lambda c, n=1: F.lead(c, n).over(w))
    amount = F.col("number").isNotNull() & F.coalesce(_has("unit", lead("roles")) | _has("vessel", lead("roles")), F.lit(False))
    t = tokens.withColumn("amount", F.coalesce(amount, F.lit(False)))
    kept_pair = F.lit(False)
    for a, b in together:
        kept_pair = kept_pair | ((lag("folded") == a) & (lead("folded") == b))
    joins = (_has("both") | (F.col("tok") == "+")) & ~F.coalesce(kept_pair, F.lit(False))
    joins = joins | ((F.col("folded").isin("en", "mas")) & lead("amount"))
    kind = F.when(_has("either") | (F.col("tok") == "/"), "either").when(joins, "both").when(F.col("tok") == ",", "comma")
    t = t.withColumn("kind", kind)
    # Without any mark: an amount behind a name, and the name of a thing behind that of another.
    behind = F.coalesce(lag("is_word") & ~_has("link", lag("roles")) & lag("kind").isNull() & ~_has("unit", lag("roles")), F.lit(False))
    own_kind = F.when(_has("head"), F.col("stands_for"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # The last head, null again once a word that ties or parts follows it.
    tie = F.when(_has("head"), F.struct(F.col("stands_for").alias("k"))).when(F.col("kind").isNotNull() | _has("link") | _has("aside"), F.struct(F.lit(None).cast("string").alias("k")))
    t = t.withColumn("tie", tie)
    last_kind = F.last("tie", ignorenulls=True).over(before)["k"]
    t = t.withColumns({"last_kind": F.when(own_kind.isNotNull(), last_kind), "behind": behind, "own_kind": own_kind})
    # A number before the second head goes with it.
    first_number = F.col("number").isNotNull() & ~F.col("amount") & _has("head", lead("roles")) & lead("last_kind").isNotNull()
    glued = F.when(first_number, F.when(lead("own_kind") == lead("last_kind"), lead("own_kind")).otherwise("")).when(
        F.col("last_kind").isNotNull() & ~F.coalesce(lag("number").isNotNull(), F.lit(False)), F.when(F.col("own_kind") == F.col("last_kind"), F.col("own_kind")).otherwise("")
    )
    implied = F.when(F.col("amount") & F.col("behind"), "both").when(glued.isin(*choices), "either").when(glued.isNotNull(), "both")
    t = t.withColumn("cut", F.coalesce("kind", implied))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("piece", F.count("cut").over(running))
    inside = Window.partitionBy(*_TEXT, "piece")
    names = F.col("is_word") & F.col("kind").isNull()
    says = F.coalesce(F.max(names).over(inside), F.lit(False))
    only_traits = F.coalesce(F.min(F.when(names, _has("trait") | _has("link") | _has("aside"))).over(inside), F.lit(False))
    opens = F.first(F.when(F.col("kind").isNull(), _has("aside")), ignorenulls=True).over(inside.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("real", F.col("cut").isNotNull() & says & ~only_traits & ~F.coalesce(opens, F.lit(False)))
    chooses = F.max(F.col("real") & (F.col("cut") == "either")).over(Window.partitionBy(*_TEXT))
    either = (F.col("cut") == "either") | ((F.col("cut") == "comma") & F.coalesce(chooses, F.lit(False)))
    t = t.withColumn("new_alt", F.col("real") & either).withColumn("new_comp", F.col("real") & ~either)
    t = t.withColumn("alt", F.sum(F.col("new_alt").cast("int")).over(running))
    within = Window.partitionBy(*_TEXT, "alt").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("comp", F.sum(F.col("new_comp").cast("int")).over(within))
    # A mark that parts nothing goes too, a word that parts nothing stays in the name.
    sep = F.col("kind").isNotNull() & (F.col("real") | ~F.col("is_word") | _has("both")) & ~F.coalesce(kept_pair, F.lit(False))
    return t.withColumn("sep", sep)


def _read(parts: DataFrame) -> DataFrame:
    """Each component's amount, unit and name from its tokens in order."""
    token = F.struct("pos", "tok", "folded", "roles", "number", "worth", "stands_for", "is_word")
    rows = parts.groupBy(*_PART).agg(F.first("note").alias("note"), F.array_sort(F.collect_list(F.when(~F.col("sep") & F.col("tok").isNotNull(), token))).alias("t"))
    at = lambda i: F.get("t", i if isinstance(i, Column) else F.lit(i))
    has = lambda i, role: _has(role, at(i)["roles"])
    spelt = has(0, "number") & (F.size("t") > 1)
    value = F.coalesce(at(0)["number"], F.when(spelt, at(0)["worth"]))
    # "1 ½" is one and a half.
    half = at(0)["number"].isNotNull() & at(1)["tok"].isin("½", "¼", "¾")
    rows = rows.withColumn("value", value + F.when(half, at(1)["number"]).otherwise(0.0)).withColumn("i", F.when(half, 2).when(value.isNotNull(), 1).otherwise(0))
    i = F.col("i")
    unit = F.when(has(i, "unit") & (F.col("value").isNotNull() | ((F.length(at(i)["tok"]) > 2) & (F.size("t") > 1))), at(i)["stands_for"])
    vessel = F.when(has(i, "vessel") & F.col("value").isNotNull(), at(i)["stands_for"])
    timed = F.col("value").isNotNull() & has(i, "time")
    # Behind a spoon or a vessel its size may follow, also as "de postre".
    far = F.when((at(i + 1)["folded"] == "de") & has(i + 2, "small") & (F.size("t") > i + 3), 2).when(has(i + 1, "small") | has(i + 1, "full"), 1).otherwise(0)
    spoon = unit.isin("tablespoon", "teaspoon") | vessel.isNotNull()
    small = (unit == "tablespoon") & (F.when(far == 2, True).when(far == 1, has(i + 1, "small")).otherwise(False))
    rows = rows.withColumns({"unit0": unit, "vessel": vessel, "timed": timed, "small": F.coalesce(small, F.lit(False))})
    taken = i + F.when(F.col("unit0").isNotNull() | F.col("vessel").isNotNull(), 1 + F.when(spoon, far).otherwise(0)).otherwise(0)
    rows = rows.withColumn("taken", taken).withColumn("rest", F.slice("t", F.col("taken") + 1, F.greatest(F.lit(0), F.size("t") - F.col("taken"))))
    ties = F.when(F.get("rest", F.lit(0))["folded"] == "de", F.when(F.get("rest", F.lit(1))["folded"].isin("la", "las", "los"), 2).otherwise(1)).when(F.get("rest", F.lit(0))["folded"] == "del", 1).otherwise(0)
    drop = F.when(F.col("taken") > F.when(F.col("value").isNotNull(), 1).otherwise(0), ties).otherwise(0)
    rows = rows.withColumn("rest", F.slice("rest", drop + 1, F.greatest(F.lit(0), F.size("rest") - drop)))
    words = lambda c: F.array_join(F.transform(c, lambda x: x["tok"]), " ")
    named = F.exists("rest", lambda x: x["is_word"])
    # A unit with nothing behind it is itself what is counted.
    alone = F.slice("t", i + 1, F.greatest(F.lit(0), F.size("t") - i))
    name = F.when(named, words(F.col("rest"))).when(F.col("unit0").isNotNull() & F.exists(alone, lambda x: x["is_word"]), words(alone))
    opener = F.get("rest", F.lit(0))
    advises = _has("advice", opener["roles"]) | F.col("timed")
    unit = F.when(F.col("small"), "teaspoon").when(F.col("unit0").isNotNull() & named, F.col("unit0")).when(F.col("value").isNotNull() & F.col("vessel").isNull() & name.isNotNull(), "piece")
    scale = F.when(F.col("unit0").isNotNull() & named, F.coalesce(at(i)["worth"], F.lit(1.0))).otherwise(1.0)
    litre = F.coalesce(at(i)["folded"].startswith("litro"), F.lit(False))
    residue = F.forall(F.filter("t", lambda x: x["is_word"]), lambda x: _has("residue", x["roles"]))
    return rows.select(
        *_PART, "note", F.coalesce(advises, F.lit(False)).alias("advises"), F.col("value").isNotNull().alias("counted"), litre.alias("litre"), residue.alias("residue"),
        (F.col("value") * scale).alias("quantity"), unit.alias("unit"), F.col("vessel").alias("raw_unit"), name.alias("name"),
    )


def parse_components(
    lines: DataFrame, words: DataFrame | None = None, *, id_col: str = "line_id", text_col: str = "line", choices: Sequence[str] = CHOICES, together: Sequence[tuple[str, str]] = TOGETHER
) -> DataFrame:
    """(line_id, line, copy_no, alt_no, comp_no, alternatives, components, quantity, unit, raw_unit, name, note, is_noise, is_advice) per component.

    ``words`` says what words do (see functions/lexicon.py). ``a / b`` and ``a o b`` are alternatives, ``a y b``, ``a con b``, ``a + b`` and
    ``a, b`` are things taken together; with alternatives in a line its commas part alternatives. What only describes parts nothing. An amount behind a name, and a thing named
    right behind another, begin a component without any mark, two things of one kind in ``choices`` alternatives. A label before a colon goes, brackets become notes. A component
    is a number, a unit or vessel, and a name; a number alone counts pieces. A line that opens with advice is advice, but for alternatives that
    begin with a number (amounts in litres are advice too); so is a component whose name opens with advice, and a stretch of time. Lines of residue are noise.

    A text is read once, however many lines say it; one shuffle brings its tokens together, every later step keeps that partitioning, and the
    lines take what their text says by a join. Null lines give no row, lines with
    nothing in them one row without a name; equal rows are told apart by copy_no."""
    words = word_table(lines.sparkSession) if words is None else words
    lines = written(lines.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("line_id"), F.col(text_col).alias("line")))
    tokens = _without_label(_without_second_numbers(_tokens(_dealt(written(lines.select("line").distinct())), words)))
    read = _read(_parted(tokens, choices, together))
    line, alt = Window.partitionBy(*_TEXT), Window.partitionBy(*_TEXT, "alt")
    noise = F.min("residue").over(line)
    first = (F.col("alt") == 0) & (F.col("comp") == 0)
    advice_line = F.max(first & F.col("advises") & ~F.col("counted")).over(line)
    starts = F.max((F.col("comp") == 0) & F.col("counted") & ~F.col("advises") & ~F.col("litre")).over(alt)
    read = read.withColumns({"noise": noise, "advice_line": advice_line, "starts": starts})
    rescued = F.max("starts").over(line)
    read = read.withColumn("rescued", F.col("advice_line") & rescued)
    stays = F.when(F.col("noise") | (F.col("advice_line") & ~F.col("rescued")), first).when(F.col("rescued"), F.col("starts")).otherwise(True)
    read = read.filter(stays)
    alt_no = F.dense_rank().over(line.orderBy("alt")) - 1
    read = read.withColumns({"alt_no": alt_no, "components": F.count("*").over(alt)})
    read = read.withColumn("alternatives", F.max("alt_no").over(line) + 1).withColumn("comp_no", F.row_number().over(alt.orderBy("comp")) - 1)
    told = ~F.col("noise") & (F.col("advises") | (F.col("advice_line") & ~F.col("rescued")) | (F.col("name").isNull() & F.col("quantity").isNull()))
    silent = F.col("noise") | told
    said = read.select(
        *_TEXT, "alt_no", "comp_no", "alternatives", F.col("components").cast("int").alias("components"),
        *[F.when(~silent, F.col(c)).alias(c) for c in ("quantity", "unit", "raw_unit", "name")], "note", F.col("noise").alias("is_noise"), told.alias("is_advice"),
    )
    copies = _dealt(lines).groupBy("line_id", "line").agg(F.count("*").cast("int").alias("n"))
    each = copies.select("line_id", "line", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    return each.join(said, "line").select(*_LINE, *[c for c in said.columns if c not in _LINE])


def propagate_quantity(components: DataFrame) -> DataFrame:
    """Alternatives of one part and without a quantity take that of the line's first component. Lines of one id are told apart."""
    whole = Window.partitionBy(*_LINE)
    lead = F.max(F.when((F.col("alt_no") == 0) & (F.col("comp_no") == 0), F.struct("quantity", "unit", "raw_unit"))).over(whole)
    takes = F.col("quantity").isNull() & F.col("name").isNotNull() & (F.col("alternatives") > 1) & (F.col("components") == 1) & (F.col("alt_no") > 0) & F.col("lead.quantity").isNotNull()
    given = components.withColumn("lead", lead)
    return given.withColumns({c: F.when(takes, F.col(f"lead.{c}")).otherwise(F.col(c)) for c in ("quantity", "unit", "raw_unit")}).drop("lead")


def promote_embedded_quantity(components: DataFrame, units: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """One piece of a thing whose name holds exactly one mass or volume becomes that much of the thing, whose name loses it."""
    units = units or {"g": ("gram", 1.0), "gr": ("gram", 1.0), "kg": ("gram", 1000.0), "ml": ("millilitre", 1.0), "l": ("millilitre", 1000.0)}
    amount = rf"(?i)(?<![\p{{L}}\d])(\d+(?:[.,]\d+)?) ?({'|'.join(sorted(units, key=len, reverse=True))})(?![\p{{L}}\d])"
    raw = F.lower(F.regexp_extract("name", amount, 2))
    table = F.create_map(*[x for u, (unit, times) in units.items() for x in (F.lit(u), F.struct(F.lit(unit).alias("unit"), F.lit(times).alias("times")))])
    meant = F.try_element_at(table, raw)
    value = F.replace(F.regexp_extract("name", amount, 1), F.lit(","), F.lit(".")).try_cast("double") * meant["times"]
    words = F.filter(F.split(F.regexp_replace("name", amount, " "), " "), lambda x: x != "")
    dangling = F.lower(F.element_at(words, -1)).isin("de", "del")
    left = F.array_join(F.when(dangling, F.slice(words, 1, F.size(words) - 1)).otherwise(words), " ")
    found = (F.col("unit") == "piece") & (F.col("quantity") == 1) & (F.regexp_count("name", F.lit(amount)) == 1) & (value > 0) & left.rlike(r"\p{L}{3}")
    fits = F.coalesce(found, F.lit(False))
    changed = {"quantity": value, "unit": meant["unit"], "raw_unit": raw, "name": left}
    return components.select(*[F.when(fits, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in components.columns])

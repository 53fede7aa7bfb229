"""Spelling variants: words at one edit meet in the sorted rotations of the words, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import cut, plain_text, stored

#: What ends a word before it is rotated; no word holds it.
END = "$"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, *, least_length: int = 7, least_count: int = 2, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts with at least that length and count.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where the crc32 of ``<doc_id>:<run>`` is
    divisible by ``noise``, the run first loses the character at crc32 % length. All these characters are one UTF-16 unit,
    so positions are code points. Shorter runs never become words and are not looked at."""
    runs = F.regexp_extract_all(plain_text(text_col), F.lit(r"([A-Za-zÀ-ÿ]{%d,})" % least_length), F.lit(1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _rotations(words: DataFrame) -> DataFrame:
    """The rotations of each word with its end mark, once whole and once without the last character: (turn, last, opens, n).

    ``turn`` is what two words at one edit share: the rotation that begins behind the edited character, which is left out.
    ``last`` is the code point left out, null where the rotation is whole; ``opens`` says that the character before it
    in the word differs, so of several equal ones in a row one stands for the deletion."""
    spots = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    head, tail = F.substring("word", F.lit(1), F.col("i")), F.substring("word", F.col("i") + 1, F.length("word"))
    one = F.substring("word", F.col("i") + 1, F.lit(1))
    behind = F.concat(F.substring("word", F.col("i") + 2, F.length("word")), F.lit(END), head)
    whole = F.struct(F.concat(tail, F.lit(END), head).alias("turn"), F.lit(None).cast("int").alias("last"), F.lit(False).alias("opens"))
    opens = (F.col("i") == 0) | (F.substring("word", F.col("i"), F.lit(1)) != one)
    without = F.struct(behind.alias("turn"), F.ascii(one).alias("last"), opens.alias("opens"))
    both = F.when(F.col("i") < F.length("word"), F.array(whole, without)).otherwise(F.array(whole))
    return spots.select("n", F.inline(both))


def _word(last: Column) -> Column:
    """The word that a rotation and the character left out of it came from."""
    return F.concat(F.substring_index("turn", END, -1), F.coalesce(F.char(last), F.lit("")), F.substring_index("turn", END, 1))


def near_words(words: DataFrame, *, factor: int = 10) -> DataFrame:
    """(word, n_near, form, form_n) of the words that differ from another by exactly one character inserted, deleted or replaced.

    All rotations are sorted by what is left when the edited character is skipped. The words of one such range are one
    short word, if it is one, and those with one more character at that place: never more than there are
    characters, whatever the number of words. Each is near to all others there; a scan of the range gives each of its
    rows the count and the most frequent of the others. A pair that one replacement links meets in one range, one
    that a deletion links in a range for each character of a run of equal ones, of which the first counts."""
    turned = _rotations(words)
    group = Window.partitionBy("turn")
    longer = F.col("last").isNotNull()
    # Of the longer words of a range the one with most occurrences, ties by the smallest character: both in one number.
    rank = F.when(longer, F.col("n") * F.lit(65536) + (F.lit(65535) - F.col("last")))
    seen = turned.select(
        "turn", "last", "opens", "n",
        F.count("last").over(group).alias("longer"),
        F.sum(F.col("opens").cast("long")).over(group).alias("opened"),
        F.count("*").over(group).alias("all"),
        F.max(rank).over(group).alias("top"),
        F.max(F.when(~longer, F.col("n"))).over(group).alias("short_n"),
    ).filter("all > 1")
    top_n, top_last = F.shiftrightunsigned("top", 16), (F.lit(65535) - F.col("top").bitwiseAND(F.lit(65535))).cast("int")
    near = F.when(longer, F.col("longer") - 1 + F.when(F.col("opens") & F.col("short_n").isNotNull(), 1).otherwise(0)).otherwise(F.col("opened"))
    enough = F.col("n") * factor
    by_longer = F.when(top_n >= enough, F.struct((-top_n).alias("minus"), _word(top_last).alias("form")))
    by_short = F.when(longer & (F.col("short_n") >= enough), F.struct((-F.col("short_n")).alias("minus"), _word(F.lit(None).cast("int")).alias("form")))
    found = seen.select(_word(F.col("last")).alias("word"), near.alias("near"), F.least(by_longer, by_short).alias("best"))
    counts = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return counts.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def _roots(forms: DataFrame, factor: int) -> DataFrame:
    """(word, root) for the rows (word, form, form_n): where following forms ends. A form occurs ``factor`` times as often as
    its word, so chains are short; each round doubles the steps."""
    paths = cut(forms.select("word", F.col("form").alias("root")))
    most = forms.agg(F.max("form_n")).first()[0] or 0
    steps = 1
    while factor**steps <= most:  # a chain of more steps would end at a word that occurs more often than any
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        paths = cut(paths.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        steps *= 2
    return paths


def spelling_variants(
    docs: DataFrame, *, least_length: int = 7, least_count: int = 2, factor: int = 10, noise: int = 31, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per word (see word_counts): word, n, n_near (words at exactly one edit), form (of those the one with the
    largest n, ties by the smallest, if that is at least ``factor`` times the word's n), form_n, root (where following
    forms ends; the word itself if it has none).

    Candidates and decisions come from the same sorted rotations (see near_words), so each pair found is exact and none
    is lost; the work is in proportion to the characters of the different words, as a range holds no more words than there
    are characters. Words are counted before anything is shuffled; of a hot word only its counts meet.

    Defined results: null and empty texts have no words; a null doc_id counts as an empty one in the crc32; rows that
    repeat count each; an empty table gives an empty result; other columns are ignored. A very long text is searched in
    one task, in memory of some 60 bytes for each of its words; a word may be of any length, with one rotation for each
    of its characters."""
    if factor < 2:
        raise ValueError("a form must occur at least twice as often as its word")
    words = stored(word_counts(docs, least_length=least_length, least_count=least_count, noise=noise, id_col=id_col, text_col=text_col))
    near = stored(near_words(words, factor=factor))
    roots = _roots(near.filter("form IS NOT NULL"), factor)
    joined = words.join(near.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")

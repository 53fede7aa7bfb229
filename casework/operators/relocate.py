"""Blocks of lines that stand under the wrong heading: decided over the whole corpus, moved, and checked line by line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What may become of a label: pattern on its key, fate (move, keep, note, drop) and, for a move, the slot it goes to.
Rule = tuple[str, str, str | None]

_OPEN = r"\([^()]*\)|\[[^\[\]]*\]"


def label_key(line: Column) -> Column:
    """The key of a label line: what stands before a colon outside brackets, in lower case, without brackets, times and numbers; null
    where there is no such colon, no letter before it, more than 60 characters, or a number first."""
    plain = F.regexp_replace(F.lower(line), _OPEN, " ")
    head = F.when(F.contains(plain, F.lit(":")), F.substring_index(F.regexp_replace(plain, r"([0-9]):([0-9])", "$1.$2"), ":", 1))
    key = F.trim(F.regexp_replace(F.regexp_replace(head, r"[0-9]+([.,][0-9]+)?\s*(h|min)?\b", " "), r"[^\p{L} ]+|\s+", " "))
    key = F.trim(F.regexp_replace(key, r" +", " "))
    fits = (F.length(F.trim(head)) <= 60) & ~F.trim(head).rlike(r"^[0-9½¼¾]") & (key != "") & head.rlike(r"\p{L}")
    return F.when(fits, key)


def label_blocks(lines: DataFrame, known: Sequence[str]) -> DataFrame:
    """The lines with ``label``, the key of the block that they are in: null before the first label line of their slot. A label line opens its own
    block; keys that begin like a ``known`` slot are no labels. ``lines``: doc_id, slot, pos, line."""
    key = label_key(F.col("line"))
    for slot in known:
        key = F.when(key.startswith(slot.lower()), F.lit(None)).otherwise(key)
    marked = lines.withColumn("mark", key)
    w = Window.partitionBy("doc_id", "slot").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("block", F.count("mark").over(w)).withColumn("label", F.last("mark", ignorenulls=True).over(w))


def label_decisions(blocks: DataFrame, rules: Sequence[Rule], counted: str) -> DataFrame:
    """(label, blocks, components, fate, target): one decision for each label, from all places where it occurs.

    The first rule whose pattern the label matches decides. A label without a rule is a note when its blocks hold, over the whole corpus, fewer than one
    line each that begins like a component (``counted``); else it stays."""
    inside = F.col("line").rlike(counted) & F.col("mark").isNull()
    found = blocks.filter("label IS NOT NULL").groupBy("label").agg(F.count("mark").alias("blocks"), F.count_if(inside).alias("components"))
    fate = F.when(F.col("components") < F.col("blocks"), "note").otherwise("keep")
    target = F.lit(None).cast("string")
    for pattern, what, where in reversed(rules):
        hit = F.col("label").rlike(pattern)
        fate, target = F.when(hit, what).otherwise(fate), F.when(hit, F.lit(where)).otherwise(target)
    return found.select("label", "blocks", "components", fate.alias("fate"), target.alias("target"))


def relocate_blocks(lines: DataFrame, rules: Sequence[Rule], *, known: Sequence[str] = (), counted: str = r"^\s*([0-9]|[½¼¾])") -> DataFrame:
    """(doc_id, part, slot, place, pos, line): every line where it belongs after the decisions: ``part`` is text, note or dropped.

    ``lines``: doc_id, slot, slot_no (the order of slots), pos, line. A block that moves goes to the end of its target slot, blocks in the order in which they
    stood; a target that the document lacks comes right behind the slot the first such block came from. Notes keep the order of the document. Every line comes out exactly
    once (see lost_lines); lines before the first label and blocks that stay keep their place. Labels are decided once, over all
    documents, by a join on the label."""
    blocks = label_blocks(lines, known)
    decided = label_decisions(blocks, rules, counted)
    rows = blocks.join(decided.select("label", "fate", "target"), "label", "left")
    moved = (F.col("fate") == "move") & (F.col("target") != F.col("slot"))
    rows = rows.withColumn("moved", F.coalesce(moved, F.lit(False)))
    part = F.when(F.col("fate") == "note", "note").when(F.col("fate") == "drop", "dropped").otherwise("text")
    rows = rows.withColumn("part", part).withColumn("to", F.when(F.col("moved"), F.col("target")).otherwise(F.col("slot")))
    own = lines.groupBy("doc_id", F.col("slot").alias("to")).agg(F.min("slot_no").alias("own_no"))
    hosts = rows.filter("moved").groupBy("doc_id", "to").agg(F.min("slot_no").alias("host_no"))
    order = own.join(hosts, ["doc_id", "to"], "full_outer").select("doc_id", "to", F.coalesce(F.col("own_no").cast("double"), F.col("host_no") + 0.5).alias("to_no"))
    placed = rows.join(order, ["doc_id", "to"], "left")
    in_text = [F.when(F.col("part") == "text", F.col(c)) for c in ("to_no", "to")]
    w = Window.partitionBy("doc_id", "part").orderBy(*in_text, F.when(F.col("part") == "text", F.col("moved").cast("int")), "slot_no", "pos")
    return placed.select("doc_id", "part", F.when(F.col("part") == "text", F.col("to")).alias("slot"), F.row_number().over(w).alias("place"), "pos", "line")


def rebuilt(placed: DataFrame) -> DataFrame:
    """(doc_id, text, notes): each document's slots, ``slot: line | line``, a line each, and its notes. A document is one row, so its lines are gathered."""
    texts = placed.filter("part = 'text'").groupBy("doc_id", "slot").agg(F.min("place").alias("at"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    slots = texts.select("doc_id", "at", F.concat("slot", F.lit(": "), F.array_join(F.col("l.line"), " | ")).alias("row"))
    text = slots.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"]), "\n").alias("text"))
    notes = placed.filter("part = 'note'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), " ").alias("notes"))
    return text.join(notes, "doc_id", "full_outer")


def lost_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, line, n): lines that a document has fewer (n > 0) or more (n < 0) of after than before; empty when nothing was lost."""
    count = lambda df, sign: df.groupBy("doc_id", "line").agg((F.count("*") * sign).alias("n"))
    return count(before, 1).unionByName(count(after, -1)).groupBy("doc_id", "line").agg(F.sum("n").alias("n")).filter("n <> 0")

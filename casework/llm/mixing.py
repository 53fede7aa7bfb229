"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.llm.common import WORD, cut, plain_text, small, unit_interval


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Per source: source_size, n_docs, target, rate (copies per document, at most ``cap``).

    Sources take the weights in turn, by code point, null last. They share ``share`` times all sizes by weight; no
    target exceeds ``cap`` times its source, and what exceeds it is shared again by weight. That fixed point is one
    water level: with sources ordered by cap/weight, the level of a prefix that is full is (rest of the total) /
    (weights of the others), and the right level is the largest that its own source can still take. The windows have
    one row per source, never one per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(turn, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    full = ranked.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    spent = F.coalesce(F.sum("most").over(by_level), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))
    level = full.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - spent) / heavy)
    chosen = level.withColumn("level", F.max(F.when(F.col("full_at") >= F.col("level"), F.col("level"))).over(everything))
    filled = F.col("level").isNull() | (F.col("full_at") <= F.col("level"))
    return chosen.select(
        "source",
        "source_size",
        "n_docs",
        F.when(filled, F.col("most")).otherwise(F.col("level") * F.col("weight")).alias("target"),
        F.when(filled, F.lit(float(cap))).otherwise(F.col("level") * F.col("weight") / F.col("source_size")).alias("rate"),
    )


def _pivot(seed: int, level: int):
    """One step of pivotal rounding between the unit that is carried and the next: word mass p * mass moves from one
    to the other, in a direction drawn so that both expectations hold, until one has p = 0 or 1 and is settled."""

    def step(state: Column, b: Column) -> Column:
        a = state["carry"]
        pa, ma, pb, mb = a["p"], a["mass"], b["p"], b["mass"]
        up = F.least(ma * (1 - pa), mb * pb)
        down = F.least(ma * pa, mb * (1 - pb))
        rises = (up + down == 0) | (unit_interval(F.lit(seed), F.lit(level), a["doc_id"], ma, b["doc_id"], mb) * (up + down) < down)
        # When a rises, either a reaches 1 or b falls to 0; when it falls, either a reaches 0 or b rises to 1.
        a_ends = F.when(rises, ma * (1 - pa) <= mb * pb).otherwise(ma * pa <= mb * (1 - pb))
        taken = F.when(a_ends == rises, F.lit(1)).otherwise(F.lit(0))
        left_a = F.when(rises, pa + up / ma).otherwise(pa - down / ma)
        left_b = F.when(rises, pb - up / mb).otherwise(pb + down / mb)
        settled = F.struct(
            F.when(a_ends, a["doc_id"]).otherwise(b["doc_id"]).alias("doc_id"),
            F.when(a_ends, a["size"]).otherwise(b["size"]).alias("size"),
            taken.alias("extra"),
        )
        carry = F.struct(
            F.when(a_ends, mb).otherwise(ma).alias("mass"),
            F.when(a_ends, b["doc_id"]).otherwise(a["doc_id"]).alias("doc_id"),
            F.when(a_ends, b["size"]).otherwise(a["size"]).alias("size"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(a_ends, left_b).otherwise(left_a))).alias("p"),
        )
        return F.struct(carry.alias("carry"), F.concat(state["settled"], F.array(settled)).alias("settled"))

    return step


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20240501,
    block: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, copies, taken (= copies * size).

    Every document of a source has the same expected number of copies. Its whole part is certain; the fractions are
    rounded by the pivotal method. A reduction tree does it: units fall by hash into blocks of about ``block`` within
    their source, a block folds its units from large to small and leaves one fractional unit, and these meet in
    blocks again until one is left per source, which is drawn on its own. Mass is words, so the words taken differ
    from the target by one document at most. Draws are hashes of ids, so reruns and recomputed tasks agree.

    Defined results: null or empty texts have size 0 and take nothing; a null source is a source of its own, last in
    order; rows that repeat source, id and size are one unit and get the same number of copies each; an empty table
    gives an empty result; other columns are ignored.
    """
    # One count per row of text; everything below works on these narrow rows.
    sizes = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(plain_text(text_col), F.lit(WORD)).cast("long").alias("size"),
        )
    )
    sources = cut(source_targets(sizes, weights=weights, share=share, cap=cap))
    n_sources, most_docs = sources.agg(F.count("*"), F.max("n_docs")).first()
    sources = small(sources.withColumnRenamed("source", "of_source"), n_sources)
    joined = sizes.join(sources, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    units = (
        joined.filter((F.col("size") > 0) & (F.col("rate") != F.floor("rate")))
        .groupBy("source", "doc_id", "size", "n_docs", (F.col("rate") - F.floor("rate")).alias("p"))
        .agg((F.count("*") * F.col("size")).cast("double").alias("mass"))
    )
    settled, level, blocks = None, 0, max(1, math.ceil((most_docs or 0) / block))
    while True:
        own = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(float(block ** (level + 1)))))
        folded = cut(
            units.groupBy("source", "n_docs", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size"), own).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("mass", "doc_id", "size", "p")), asc=False).alias("units"))
            .select(
                "source",
                "n_docs",
                F.aggregate(
                    F.slice("units", 2, F.greatest(F.lit(0), F.size("units") - 1)),
                    F.struct(
                        F.element_at("units", 1).alias("carry"),
                        F.array().cast("array<struct<doc_id:bigint,size:bigint,extra:int>>").alias("settled"),
                    ),
                    _pivot(seed, level),
                ).alias("state"),
            )
        )
        part = folded.select("source", F.explode("state.settled").alias("unit")).select("source", "unit.*")
        settled = part if settled is None else settled.unionByName(part)
        units = folded.select("source", "n_docs", "state.carry.*")
        if blocks <= 1:
            break
        blocks, level = math.ceil(blocks / block), level + 1
    last = units.select("source", "doc_id", "size", (unit_interval(F.lit(seed), F.lit(-1), F.col("doc_id")) < F.col("p")).cast("int").alias("extra"))
    extra = settled.unionByName(last).select(
        F.col("source").alias("x_source"), F.col("doc_id").alias("x_id"), F.col("size").alias("x_size"), "extra"
    )
    same = (
        F.col("source").eqNullSafe(F.col("x_source")) & F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("size") == F.col("x_size"))
    )
    copies = F.when(F.col("size") > 0, F.floor("rate") + F.coalesce(F.col("extra"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    return joined.join(extra, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )

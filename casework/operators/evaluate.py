"""Leave-one-out evaluation: what is said about a query from other entities' cases, against what its own case holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.operators.stats import md5_number


def without_twins(pool: DataFrame, twins: DataFrame) -> DataFrame:
    """A ranked pool without the cases that are near-duplicates of the query's own (twins: a, b), ranked again."""
    both = twins.select(F.col("a").alias("query_id"), F.col("b").alias("case_id")).unionByName(twins.select(F.col("b").alias("query_id"), F.col("a").alias("case_id")))
    left = pool.join(both, ["query_id", "case_id"], "left_anti").withColumnRenamed("rank", "before")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("before"))).drop("before")


def strangers(queries: DataFrame, cases: DataFrame, *, block: int = 64, seed: str = "floor") -> DataFrame:
    """(query_id, kind, case_id): for each query another entity's case, drawn by a hash, of any objective (``any``), of the query's (``same``) and of
    another (``other``).

    Cases are dealt into blocks of about ``block`` by a hash, queries too; each query takes from its block the first case that fits by
    a hash of both. Every case can be drawn, whatever the ids are, and a query meets one block only. Where a block has no case of a kind there is no row."""
    blocks = max(1, cases.count() // block)
    dealt = cases.select("case_id", "entity_id", "objective", (md5_number(F.lit(seed), F.col("case_id")) % blocks).alias("block"))
    asked = queries.select("query_id", "q_entity_id", "q_objective", (md5_number(F.lit(seed + "3"), F.col("query_id")) % blocks).alias("block"))
    met = asked.join(dealt, "block").filter("entity_id <> q_entity_id").withColumn("order", md5_number(F.lit(seed + "2"), F.col("query_id"), F.col("case_id")))
    same = F.col("objective").eqNullSafe(F.col("q_objective"))
    kinds = met.select("query_id", "case_id", "order", F.explode(F.array(F.lit("any"), F.when(same, "same").otherwise("other"))).alias("kind"))
    return kinds.groupBy("query_id", "kind").agg(F.min_by("case_id", F.struct("order", "case_id")).alias("case_id"))


def said_against_held(said: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """Per query and variant (``by``): common, n_said, n_held, jaccard, precision and recall of two element tables.

    ``said``: *by, element; ``held``: query_id, element. One equi-join on query and element; sizes are plain counts."""
    sizes = held.groupBy("query_id").agg(F.count("*").alias("n_held"))
    hits = said.join(held.withColumn("hit", F.lit(1)), ["query_id", "element"], "left")
    counted = hits.groupBy(*by).agg(F.count("hit").alias("common"), F.count("*").alias("n_said")).join(sizes, "query_id")
    c, a, b = (F.col(x).cast("double") for x in ("common", "n_said", "n_held"))
    return counted.select(*by, "common", "n_said", "n_held", F.round(c / (a + b - c), 6).alias("jaccard"), F.round(c / a, 6).alias("precision"), F.round(c / b, 6).alias("recall"))


def composed(rows: DataFrame, by: list[str], share: Column, threshold: Column) -> DataFrame:
    """The elements whose share reaches the threshold: (*by, element). ``share`` is an aggregate of the neighbours' rows."""
    return rows.groupBy(*by, "element").agg(F.round(share, 6).alias("share"), F.max(threshold).alias("__least")).filter("share >= __least").select(*by, "element")


def variants(near: DataFrame, sets: DataFrame, strange: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(query_id, variant, element): the nearest case copied, the consensus of all neighbours, the best single neighbour
    (ceiling) and a stranger's case (floor; floor_same and floor_other by its objective)."""
    k = near.groupBy("query_id").agg(F.count("*").alias("k"))
    rows = near.select("query_id", "case_id", "rank").join(sets, "case_id").join(k, "query_id")
    each = said_against_held(rows.select("query_id", "case_id", "element"), held, ["query_id", "case_id"])
    best = each.groupBy("query_id").agg(F.min_by("case_id", F.struct(-F.col("jaccard"), "case_id")).alias("case_id"))
    parts = {
        "copy": rows.filter("rank = 1").select("query_id", "element"),
        "composed": composed(rows, ["query_id"], F.count("*") / F.max("k"), F.lit(threshold)),
        "ceiling": rows.join(best, ["query_id", "case_id"], "left_semi").select("query_id", "element"),
        **{name: strange.filter(F.col("kind") == kind).join(sets, "case_id").select("query_id", "element") for name, kind in (("floor", "any"), ("floor_same", "same"), ("floor_other", "other"))},
    }
    out = None
    for name, part in parts.items():
        part = part.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def arms(near: DataFrame, sets: DataFrame, held: DataFrame, threshold: float, *, by: str = "arm", least: int = 1) -> DataFrame:
    """(by, query_id, composed, copied): how near to the held elements (Jaccard) each arm comes with the consensus of its
    neighbours and with the first of them copied. What says nothing counts 0; a query with fewer than ``least`` neighbours
    in an arm is not in it, nor is one that holds nothing.

    ``near``: by, query_id, case_id, rank, of all arms. One join brings the elements of all arms' neighbours."""
    k = near.groupBy(by, "query_id").agg(F.count("*").alias("k")).filter(F.col("k") >= least)
    rows = near.select(by, "query_id", "case_id", "rank").join(k, [by, "query_id"]).join(sets, "case_id")
    said = composed(rows, [by, "query_id"], F.count("*") / F.max("k"), F.lit(threshold)).withColumn("variant", F.lit("composed"))
    first = rows.filter("rank = 1").select(by, "query_id", "element", F.lit("copied").alias("variant"))
    scored = said_against_held(said.unionByName(first), held, [by, "query_id", "variant"])
    names = ("composed", "copied")
    wide = scored.groupBy(by, "query_id").agg(*[F.max(F.when(F.col("variant") == v, F.col("jaccard"))).alias(v) for v in names])
    asked = k.select(by, "query_id").join(held.select("query_id").distinct(), "query_id")
    return asked.join(wide, [by, "query_id"], "left").select(by, "query_id", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in names])


def against_arm(scores: DataFrame, base: str, *, by: str = "arm", value: str = "composed") -> DataFrame:
    """(by, n, mean, difference, wins, losses): each arm against the arm ``base``, paired by query; only queries of both count."""
    other = scores.filter(F.col(by) == base).select("query_id", F.col(value).alias("__base"))
    gain = F.round(F.col(value) - F.col("__base"), 6)
    return scores.join(other, "query_id").groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 5).alias("mean"), F.round(F.avg(gain), 5).alias("difference"), F.count_if(gain > 0).alias("wins"), F.count_if(gain < 0).alias("losses")
    )


def distinct_grid(grid: Mapping[str, Sequence[float]]) -> Mapping[str, Sequence[float]]:
    """The grid itself; an error if two of its names weigh alike, as the same would be measured twice."""
    seen: dict[tuple[float, ...], str] = {}
    for name, weights in grid.items():
        shares = tuple(round(w / sum(weights), 9) for w in weights)
        if shares in seen:
            raise ValueError(f"{name} weighs as {seen[shares]} does")
        seen[shares] = name
    return grid


def half_of(entity: Column, *, share: int = 6, seed: str = "half") -> Column:
    """``dev`` for about ``share`` tenths of the entities, else ``holdout``; all queries of an entity are on one side."""
    return F.when(md5_number(F.lit(seed), entity) % 10 < share, "dev").otherwise("holdout")


def sweep_table(scores: DataFrame, halves: DataFrame, *, by: str = "weights") -> DataFrame:
    """(by, half, n, composed, copied, chosen): means of each half, and which of the grid is best on the development half
    (ties: the first name). ``halves``: query_id, half."""
    means = scores.join(halves, "query_id").groupBy(by, "half").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in ("composed", "copied")])
    top = means.filter("half = 'dev'").agg(F.min_by(by, F.struct(-F.col("composed"), by)).alias("__top"))
    return means.crossJoin(F.broadcast(top)).withColumn("chosen", F.coalesce(F.col(by) == F.col("__top"), F.lit(False))).drop("__top")


def per_slot(said: DataFrame, held: DataFrame) -> DataFrame:
    """(variant, slot, n, present, jaccard): over the slots that queries hold, how often a variant says anything in the slot, and
    the mean Jaccard there; nothing said counts 0.

    ``said``: query_id, variant, slot, element; ``held``: query_id, slot, element."""
    at = F.struct("query_id", "slot")
    scored = said_against_held(said.select(at.alias("query_id"), "variant", "element"), held.select(at.alias("query_id"), "element"), ["query_id", "variant"])
    asked = held.select("query_id", "slot").distinct().crossJoin(F.broadcast(said.select("variant").distinct()))
    flat = scored.select("query_id.query_id", "query_id.slot", "variant", "jaccard")
    rows = asked.join(flat, ["query_id", "slot", "variant"], "left")
    return rows.groupBy("variant", "slot").agg(
        F.count("*").alias("n"), F.round(F.count("jaccard") / F.count("*"), 5).alias("present"), F.round(F.avg(F.coalesce("jaccard", F.lit(0.0))), 5).alias("jaccard")
    )


def own_history(cases: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, case_id, back): the ``k`` latest strictly earlier versions of each query's entity, ``back`` 1 for the one before.

    One window over the versions of an entity; a query never meets a later version, its own case, or more than ``k``."""
    before = Window.partitionBy("entity_id").orderBy("version").rowsBetween(-k, -1)
    listed = cases.select(F.col("case_id").alias("query_id"), F.collect_list("case_id").over(before).alias("ids"))
    asked = listed.join(queries.select("query_id"), "query_id", "left_semi").filter(F.size("ids") > 0)
    return asked.select("query_id", F.posexplode(F.reverse("ids")).alias("at", "case_id")).select("query_id", "case_id", (F.col("at") + 1).alias("back"))


def recurrent_variants(near: DataFrame, mixed: DataFrame, previous: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(query_id, variant, element) for queries with an earlier version: ``copy_previous``; ``cold``, the consensus of other
    entities' cases; ``history``, that of the nearest cases with the entity's own earlier ones among them; ``renewed``, what of the
    previous version any of those holds too, with what they agree on; ``routed``: renewed where the objective stays, else history.

    ``near``, ``mixed``: query_id, case_id; ``previous``: query_id, case_id, changed."""
    had = previous.join(sets, "case_id").select("query_id", "element")

    def rows(neighbours: DataFrame) -> DataFrame:
        k = neighbours.groupBy("query_id").agg(F.count("*").alias("k"))
        asked = neighbours.select("query_id", "case_id").join(previous.select("query_id"), "query_id", "left_semi")
        return asked.join(sets, "case_id").join(k, "query_id")

    votes, among = F.count("*") / F.max("k"), rows(mixed)
    agreed = composed(among, ["query_id"], votes, F.lit(threshold))
    others = mixed.join(previous.select("query_id", "case_id"), ["query_id", "case_id"], "left_anti")
    backed = had.join(rows(others).select("query_id", "element").distinct(), ["query_id", "element"], "left_semi")
    renewed = backed.unionByName(agreed).distinct()
    changed = previous.filter("changed").select("query_id")
    routed = renewed.join(changed, "query_id", "left_anti").unionByName(agreed.join(changed, "query_id", "left_semi"))
    parts = {"copy_previous": had, "cold": composed(rows(near), ["query_id"], votes, F.lit(threshold)), "history": agreed, "renewed": renewed, "routed": routed}
    out = None
    for name, part in parts.items():
        part = part.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out

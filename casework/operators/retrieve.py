"""Retrieval of the most similar past cases for many queries at once."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from casework.functions.columns import decay, equality, weighted_score

#: Rows of a stated query set that are broadcast at a time.
BLOCK = 2_000

#: Weights of the delivered score: objective, segment, nation, region, balance.
WEIGHTS = (0.45, 0.15, 0.20, 0.10, 0.10)


def against_all(queries: DataFrame, candidates: DataFrame, *, on: Column | None = None, key: str = "query_id", block: int = BLOCK) -> DataFrame:
    """Every row of a stated query set beside every candidate that meets ``on``, in blocks of at most ``block`` queries,
    so that what is broadcast has a fixed size. Each candidate meets the whole block, so candidates are first dealt evenly
    over all cores: narrow rows that move once, against work that is ``block`` times theirs."""
    blocks = max(1, math.ceil(queries.count() / block))
    candidates = candidates.repartition(2 * queries.sparkSession.sparkContext.defaultParallelism)
    out = None
    for n in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == n)
        rows = candidates.crossJoin(F.broadcast(part)) if on is None else candidates.join(F.broadcast(part), on)
        out = rows if out is None else out.unionByName(rows)
    return out


def best(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes per task before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


#: Traits that match or not, and beside them the balance, whose match falls off over this span.
TRAITS = ("objective", "segment", "nation", "region")
SPAN = 5000.0

#: Cases that a cell holds at most in the mean, and into how many parts a band is divided to come to it.
FULL, PARTS = 64, 4


def _score(balance: Column, q: str = "q_", weights: Sequence[float] = WEIGHTS) -> Column:
    """Weighted mean of the trait matches and the given match of balances; unknown traits count a half, those of weight 0 are not looked at."""
    matches = [(equality(F.col(c), F.col(q + c)), w, False) for c, w in zip(TRAITS, weights, strict=False) if w > 0]
    return weighted_score([*matches, (balance, weights[4], False)])


def attribute_score(q: str = "q_", weights: Sequence[float] = WEIGHTS) -> Column:
    """The score of a case for a query, rounded before ranking, so that float noise cannot order ties."""
    return F.round(_score(decay(F.col("balance"), F.col(q + "balance"), SPAN), q, weights), 6)


def null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join by equality in which null equals null; the columns of ``on`` are kept once."""
    other = right.withColumnsRenamed({c: f"__{c}" for c in on})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    return left.join(other, same).drop(*[f"__{c}" for c in on])


def attribute_pool(queries: DataFrame, candidates: DataFrame, k: int, *, width: float = 500.0, inside: Column | None = None, carry: tuple[str, ...] = (), weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(query_id, case_id, entity_id, same, score, rank, *carry): the best ``k`` cases of other entities for each query,
    of those combinations of traits that meet ``inside``.

    Queries and cases do not meet all with all. Cases fall into cells: a combination of traits, and a band of ``width`` of
    the balance. Cells are counted, and for each pair of a query's cell and another the score has a lower and an upper
    bound. Down to the bound at which the better cells hold ``k`` cases beside the query's own entity's, cells are
    joined with the queries by equality, and only their cases are scored. Where a band holds more than some ``FULL`` cases, those
    that can reach the best are divided again and again, and of cases that are equal in all of these a query meets as many as
    it may need, so what a query is scored against does not grow with the cases; the
    tables of cells and of their pairs grow with the cases divided by ``FULL``. Traits of weight 0, and a balance of weight 0, part no
    cells: cases that differ in these alone are equal, too. ``inside`` may ask for traits, the query's (q_...), and
    the columns ``carry``. ``weights``: of the traits and of the balance, none negative and not all 0.
    """
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError(f"weights {tuple(weights)}: none may be negative, one must be above 0")
    of_balance = weights[4] / sum(weights)
    weighed = [c for c, w in zip(TRAITS, weights, strict=False) if w > 0]
    traits = weighed if weighed and inside is None else list(TRAITS)
    asked, alike = ["q_" + c for c in traits] + list(carry), [*traits, "balance"] if of_balance else traits
    in_bands = lambda balance, width: F.floor(F.col(balance) / F.lit(width)) if of_balance else F.lit(0).cast("long")
    wide = candidates.groupBy(*traits, in_bands("balance", width).alias("band")).agg(F.count("*").alias("n"))
    counted = wide.agg(F.coalesce(F.sum("n") / F.count("*"), F.lit(0)).alias("mean")).first()
    finer = max(0, math.ceil(math.log(max(counted["mean"], 1) / FULL, PARTS))) if of_balance else 0
    finest = width / PARTS**finer
    band = in_bands("balance", finest)
    cells = candidates.groupBy(*traits, band.alias("band")).agg(F.count("*").alias("n")).persist()
    combos = cells.groupBy(*traits).agg(F.sum("n").alias("n"))
    own = candidates.join(queries.select(F.col("q_entity_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    own = own.groupBy(F.col("entity_id").alias("q_entity_id")).agg(F.count("*").alias("own"))
    wanted = queries.join(own, "q_entity_id", "left").withColumn("need", F.lit(k) + F.coalesce("own", F.lit(0))).withColumn("q_band", in_bands("q_balance", finest))
    wanted = wanted.drop("own").persist()
    # Cases equal in all that has a weight tie for every query and are told apart by their ids: a query's best holds none beyond the first ``need``.
    most = wanted.agg(F.coalesce(F.max("need"), F.lit(0)).alias("most")).first()["most"]
    first = best(candidates.filter("entity_id IS NOT NULL"), alike, [F.asc("case_id")], most, "nth")

    def reached(steps: DataFrame, by: list[str], need: str) -> DataFrame:
        """From counts by lower bound, the bound down to which ``need`` cases lie; 0 where there are too few."""
        summed = steps.withColumn("so_far", F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc("lower"))))
        return summed.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("so_far") >= F.col(need), F.col("lower"))), F.lit(0.0)).alias("down"))

    # Combinations first: without the balance a score is known up to its weight.
    groups = wanted.groupBy(*asked).agg(F.max("need").alias("most"))
    met = groups.crossJoin(combos) if inside is None else groups.join(combos, inside)
    met = met.withColumn("lower", F.round(_score(F.lit(0.0), weights=weights), 6)).persist()
    down = reached(met, asked, "most")
    near = null_safe(met, down, asked).filter(F.col("lower") + of_balance + 1e-6 >= F.col("down")).select(*asked, *traits, F.col("lower").alias("base"))
    # Then their bands, wide ones first; only those that can still hold a query's best are looked at in parts.
    for level in range(finer + 1):
        parts = PARTS ** (finer - level)
        span = finest * parts
        bands = wanted.groupBy(*asked, F.floor(F.col("q_band") / parts).alias("q_band")).agg(F.max("need").alias("most"))
        inner = cells.groupBy(*traits, F.floor(F.col("band") / parts).alias("band")).agg(F.sum("n").alias("n")) if parts > 1 else cells
        if level == 0:
            near = null_safe(null_safe(near, bands, asked), inner, traits)
        else:
            near = near.withColumnsRenamed({"q_band": "q_outer", "band": "outer"}).drop("n", "most", "lower", "upper", "down")
            near = null_safe(near, bands.withColumn("q_outer", F.floor(F.col("q_band") / PARTS)), [*asked, "q_outer"])
            near = null_safe(near, inner.withColumn("outer", F.floor(F.col("band") / PARTS)), [*traits, "outer"])
        apart = F.abs(F.col("band") - F.col("q_band"))
        known = F.coalesce(apart, F.lit(0))
        closest, farthest = (F.greatest(F.lit(0), known - 1) * F.lit(span), (known + 1) * F.lit(span))
        match = lambda d, apart=apart: F.when(apart.isNull(), F.lit(0.5)).otherwise(1.0 - F.least(d, F.lit(SPAN)) / F.lit(SPAN)) * F.lit(of_balance)
        limits = [F.round(F.col("base") + match(farthest), 6).alias("lower"), F.round(F.col("base") + match(closest), 6).alias("upper")]
        bounds = near.select(*asked, "q_band", *traits, "band", "n", "base", "most", *limits).persist()
        if level < finer:
            sums = bounds.groupBy(*asked, "q_band", "most", "lower").agg(F.sum("n").alias("n"))
            near = null_safe(bounds, reached(sums, [*asked, "q_band"], "most"), [*asked, "q_band"]).filter(F.col("upper") + 1e-5 >= F.col("down"))
    bounds = bounds.drop("base", "most")
    levels = null_safe(wanted.select("query_id", "need", *asked, "q_band"), bounds.groupBy(*asked, "q_band", "lower").agg(F.sum("n").alias("n")), [*asked, "q_band"])
    per_query = reached(levels, ["query_id"], "need")
    pairs = null_safe(wanted.join(per_query, "query_id"), bounds.drop("n"), [*asked, "q_band"]).filter(F.col("upper") + 1e-5 >= F.col("down")).drop("lower", "upper", "down")
    rows = null_safe(first.withColumn("band", band), pairs, [*traits, "band"]).filter("entity_id <> q_entity_id AND nth <= need")
    scored = rows.select("query_id", "case_id", "entity_id", (F.col("objective") == F.col("q_objective")).alias("same"), attribute_score(weights=weights).alias("score"), *carry)
    return best(scored, ["query_id"], [F.desc("score"), F.asc("case_id")], k)


def diverse_neighbourhood(pool: DataFrame, k: int) -> DataFrame:
    """From a ranked pool: first one case per entity of the objective, then more cases of the objective, only then
    other objectives; ranked 1..k again."""
    own = Window.partitionBy("query_id", "entity_id", "same").orderBy("rank")
    stage = F.when(~F.col("same"), 2).when(F.row_number().over(own) == 1, 0).otherwise(1)
    staged = pool.withColumn("stage", stage).withColumnRenamed("rank", "pool_rank")
    return best(staged, ["query_id"], [F.asc("stage"), F.asc("pool_rank")], k).select("query_id", "case_id", "entity_id", "same", "score", "stage", "rank")


def one_per_entity(pool: DataFrame, k: int, *, same_only: bool = False) -> DataFrame:
    """The best case of each entity, of the objective only or of any."""
    rows = pool.filter("same") if same_only else pool
    first = best(rows.withColumnRenamed("rank", "pool_rank"), ["query_id", "entity_id"], [F.asc("pool_rank")], 1, "nth").drop("nth")
    return best(first, ["query_id"], [F.asc("pool_rank")], k).select("query_id", "case_id", "entity_id", "score", "rank")


def service_band(neighbourhood: DataFrame) -> DataFrame:
    """Per query the distinct entities of the objective, the share of its cases, and whether to serve."""
    counted = neighbourhood.groupBy("query_id").agg(
        F.count_distinct(F.when(F.col("same"), F.col("entity_id"))).alias("entities"),
        F.round(F.avg(F.col("same").cast("double")), 6).alias("purity"),
    )
    band = F.when((F.col("entities") >= 10) & (F.col("purity") >= 0.8), "serve").when(F.col("entities") >= 3, "declare").otherwise("refuse")
    return counted.withColumn("band", band)


def vote_weights(neighbourhood: DataFrame, power: float) -> DataFrame:
    """Weight of each neighbour: its score against the query's best, to a power, not under 1e-6."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    ratio = F.greatest(F.lit(1e-6), F.coalesce(F.col("score") / F.nullif(top, F.lit(0.0)), F.lit(0.0)))
    return neighbourhood.withColumn("weight", F.round(F.pow(ratio, F.lit(float(power))), 6))


def degrade(neighbourhood: DataFrame, *, least_purity: float, k_small: int) -> DataFrame:
    """Where objectives mix too much, a neighbourhood is cut to its first ``k_small``; with none of the objective, to one."""
    share = F.avg(F.col("same").cast("double")).over(Window.partitionBy("query_id"))
    limit = F.when(share == 0, 1).when(share < least_purity, k_small).otherwise(1 << 30)
    return neighbourhood.withColumn("limit", limit).filter(F.col("rank") <= F.col("limit")).drop("limit")


def vector_scores(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, same, cosine) of a stated query set against all other vectors.

    Every pair is scored, in double precision, by matrix products of an Arrow batch of vectors and a block of queries. Of each
    batch and query those rows are returned that can be among the best ``k``, with the same label, with another and with an
    unknown one, ties of the rounded cosine included, and the least cosine: best ``k``, least and greatest cosine are those of
    all pairs."""
    id_type = vectors.schema["vec_id"].dataType
    def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of ``size`` numbers as rows in double precision, and which of them are such arrays; the others are rows of zeros."""
        rows = column.to_pylist() if column.null_count or column.flatten().null_count or len(set(np.diff(column.offsets.to_numpy()).tolist()) - {size}) else None
        if rows is None:
            return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), size), np.ones(len(column), bool)
        good = np.array([r is not None and len(r) == size and None not in r for r in rows], bool)
        return np.array([r if g else [0.0] * size for r, g in zip(rows, good, strict=True)], "float64").reshape(len(rows), size), good

    def can_be_best(ids: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
        """Places of all rows that can be among the best ``k`` by a rounded cosine and id, and of the least cosine. Unknown ones are -inf."""
        if len(key) <= k:
            return np.arange(len(key))
        kth = np.partition(key, -k)[-k]
        known = np.flatnonzero(key > -np.inf)
        found = known[key[known] >= kth - 1e-5]
        if kth == -np.inf:
            unknown = np.flatnonzero(key == -np.inf)
            found = np.concatenate([found, unknown[np.argsort(ids[unknown], kind="stable")[:k]]])
        least = known[np.argmin(key[known])] if len(known) else found[0]
        return np.union1d(found, least)

    kinds = T.StructType([T.StructField(c, t) for c, t in (("query_id", id_type), ("vec_id", id_type), ("same", T.BooleanType()), ("cosine", T.DoubleType()))])
    names, schema = kinds.names, to_arrow_schema(kinds)
    blocks, out = max(1, math.ceil(queries.count() / BLOCK)), None
    rows = vectors.filter("vec_id IS NOT NULL").select("vec_id", "label", "embedding")
    rows = rows.repartition(2 * queries.sparkSession.sparkContext.defaultParallelism)
    for n in range(blocks):
        part = queries.filter(F.col("query_id").isNotNull() & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n))
        asked = [(r.query_id, r.q_label, r.q_embedding) for r in part.select("query_id", "q_label", "q_embedding").collect()]
        block = queries.sparkSession.sparkContext.broadcast(asked)

        def score(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            sizes: dict[int, list[tuple]] = {}
            for query in block.value:
                known = query[2] is not None and None not in query[2]
                sizes.setdefault(len(query[2]) if known else 0, []).append(query)
            for batch in batches:
                ids, labels = batch.column("vec_id").to_numpy(zero_copy_only=False), np.array(batch.column("label").to_pylist(), dtype=object)
                unlabelled = np.array([x is None for x in labels], bool)
                for size, every in sizes.items():
                    x, good = matrix(batch.column("embedding"), size) if size else (np.zeros((len(ids), 0)), np.zeros(len(ids), bool))
                    for first in range(0, len(every), 128):
                        some = every[first : first + 128]
                        y = np.array([q[2] if size else [] for q in some], "float64").reshape(len(some), size)
                        with np.errstate(all="ignore"):
                            norms = np.sqrt((y * y).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
                            cosine = (y @ x.T) / norms
                        key = np.where(~good[None, :] | (norms == 0), -np.inf, np.where(np.isnan(cosine), np.inf, cosine))
                        found = []
                        for i, (query, label, _) in enumerate(some):
                            other = ids != query
                            unknown = unlabelled | (label is None)
                            same = (labels == label) & ~unknown
                            for which, kind in ((other & same, True), (other & ~same & ~unknown, False), (other & unknown, None)):
                                at = np.flatnonzero(which)
                                at = at[can_be_best(ids[at], key[i, at], k)] if len(at) else at
                                found += [(query, ids[j].item(), kind, None if key[i, j] == -np.inf else cosine[i, j].item()) for j in at]
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in found], schema=schema)

        scored = rows.mapInArrow(score, kinds)
        out = scored if out is None else out.unionByName(scored)
    return out.withColumn("cosine", F.round("cosine", 6))


def hybrid_topk(scored: DataFrame, k: int, alpha: float) -> DataFrame:
    """alpha * min-max-normalised cosine + (1 - alpha) * attribute match, best ``k`` per query; no span counts 0."""
    w = Window.partitionBy("query_id")
    low, high = F.min("cosine").over(w), F.max("cosine").over(w)
    normal = F.when(high > low, (F.col("cosine") - low) / (high - low)).otherwise(0.0)
    mixed = F.round(F.lit(alpha) * normal + F.lit(1 - alpha) * F.col("same").cast("double"), 6)
    return best(scored.withColumn("score", mixed), ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", "vec_id", "score", "rank")


def candidate_counts(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per query how many cases of other entities there are: all (n), free ones (n_free), of its objective (n_same), free ones
    of those (n_same_free), and of its objective and segment (n_archetype).

    Counts by objective and segment, and by those of the query's own entity, are joined by equality; no query meets a case."""
    kinds = ["objective", "segment"]
    asked = queries.select(F.col("q_entity_id").alias("entity_id")).distinct()

    def counts(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("free").alias("n_free"))

    every = counts(candidates, kinds)
    own = counts(candidates.join(asked, "entity_id", "left_semi"), ["entity_id", *kinds]).select(
        F.col("entity_id").alias("q_entity_id"), *kinds, (-F.col("n")).alias("n"), (-F.col("n_free")).alias("n_free")
    )
    heads = queries.select("query_id", "q_entity_id", "q_objective", "q_segment")
    others = heads.crossJoin(F.broadcast(every)).unionByName(heads.join(own, "q_entity_id").select(*heads.columns, *kinds, "n", "n_free"))
    same = F.coalesce(F.col("objective") == F.col("q_objective"), F.lit(False))
    kind = same & F.coalesce(F.col("segment") == F.col("q_segment"), F.lit(False))
    return others.groupBy("query_id").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("n_same"),
        F.coalesce(F.sum(F.when(same, F.col("n_free"))), F.lit(0)).alias("n_same_free"),
        F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0)).alias("n_archetype"),
        F.sum("n_free").alias("n_free"),
    )


def progressive_relaxation(queries: DataFrame, candidates: DataFrame, traits: list[str], k: int) -> DataFrame:
    """(query_id, case_id, score, tier, rank): each query takes the strictest tier that still has ``k`` candidates, or the last,
    and of that its best ``k``. Tier 0 wants the query's objective and segment, tier 1 its objective, tier 2 takes all."""
    counted = candidate_counts(queries, candidates.withColumn("free", F.lit(True)))
    tier = F.when(F.col("n_archetype") >= k, 0).when(F.col("n_same") >= k, 1).otherwise(2)
    tiered = queries.join(counted.select("query_id", tier.alias("tier")), "query_id")
    same = F.col("objective") == F.col("q_objective")
    narrow = reduce(and_, [F.col(c) == F.col("q_" + c) for c in traits], same)
    inside = (F.col("tier") == 2) | ((F.col("tier") == 1) & same) | ((F.col("tier") == 0) & narrow)
    return attribute_pool(tiered, candidates, k, inside=inside, carry=("tier",)).select("query_id", "case_id", "score", "tier", "rank")

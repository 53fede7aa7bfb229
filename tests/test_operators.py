"""Small tables with the nulls, ties and empty sets that the operators define results for."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casework.functions import columns as C
from casework.operators import consensus, joins, linkage, mining, quality, retrieve, rules, stats


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_scores(spark):
    same = C.weighted_score([(F.lit(1.0), 0.5, False), (F.lit(1.0), 0.5, True)])
    assert one(spark, same) == 1.0
    unknown = F.lit(None).cast("double")
    assert one(spark, C.weighted_score([(unknown, 0.5, False), (F.lit(1.0), 0.5, False)])) == 0.75
    assert one(spark, C.weighted_score([(F.lit(1.0), 0.5, False), (unknown, 0.5, True)])) == 1.0
    assert one(spark, C.decay(F.lit(10.0), F.lit(20.0), 10)) == 0.0
    assert one(spark, C.set_jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0.0
    assert one(spark, C.grid_round(F.lit(12.5))) == 10.0 and one(spark, C.grid_round(F.lit(4.0))) == 4.0
    assert one(spark, C.fold_text(F.lit("  Éa\tß "))) == "ea ss"
    assert one(spark, C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, C.regime_overlap(F.lit(1), F.lit(5), F.lit(2), F.lit(3))) == 0.5
    a = F.create_map(F.lit("x"), F.lit(1.0))
    assert one(spark, C.marker_decay(a, F.create_map(F.lit("y"), F.lit(1.0)), 5)) is None
    assert one(spark, C.flag_compatibility(F.array(F.lit("a")), F.array(F.lit("b")))) == 0.3
    assert one(spark, C.half_credit(F.lit("ab"), F.lit("abc"))) == 0.5


def test_asof_is_strict(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    left = spark.createDataFrame([(1, "a", t[1]), (2, "a", t[2]), (3, "a", None), (4, "b", t[3])], "id long, who string, ts timestamp")
    right = spark.createDataFrame([(10, "a", t[0]), (11, "a", t[1]), (12, "a", t[1]), (13, "a", None)], "id long, who string, ts timestamp")
    found = joins.asof_strict(left, right, by=["who"], left_time="ts", right_time="ts", values=["id"], tie="id")
    assert {r.id: r.found_id for r in found.collect()} == {1: 10, 2: 12, 3: None, 4: None}


def test_neighbourhood_prefers_entities_of_the_objective(spark):
    pool = spark.createDataFrame(
        [(1, 10, 100, True, 0.9, 1), (1, 11, 100, True, 0.8, 2), (1, 12, 101, False, 0.7, 3), (1, 13, 102, True, 0.6, 4)],
        "query_id long, case_id long, entity_id long, same boolean, score double, rank int",
    )
    got = [r.case_id for r in retrieve.diverse_neighbourhood(pool, 4).orderBy("rank").collect()]
    assert got == [10, 13, 11, 12]


def test_consensus_needs_two_cases(spark):
    near = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "query_id long, case_id long")
    items = spark.createDataFrame([(10, "A", "x"), (11, "A", "x"), (12, "A", "y"), (10, "B", "x")], "case_id long, slot string, p string")
    rows = consensus.neighbour_items(near, items)
    slots = consensus.slot_consensus(rows, near, 0.3)
    assert [r.slot for r in slots.collect()] == ["A"]
    products = consensus.product_consensus(rows, slots, "p", 0.3).collect()
    assert [(r.p, list(r.case_ids)) for r in products] == [("x", [10, 11])]


def test_accepted_slots(spark):
    supports = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(v).alias("support")) for s, v in (("A", 0.4), ("B", 0.4), ("C", 0.5))])
    assert one(spark, F.array_join(consensus.accepted_slots(supports, F.lit(0.35), 0.1), ",")) == "A,C"


def test_quantity_repair(spark):
    ceilings = spark.createDataFrame([("g", 500.0), ("n", 20.0)], "unit string, ceiling double")
    rows = spark.createDataFrame([(1, "n", 3.0), (2, "n", 100.0), (3, "n", 900.0), (4, "?", 1.0)], "id long, unit string, quantity double")
    got = {r.id: (r.unit, r.quantity) for r in consensus.impossible_quantity_repair(rows, ceilings, "g").collect()}
    assert got == {1: ("n", 3.0), 2: ("g", 100.0), 3: ("g", None), 4: ("?", 1.0)}


def test_rules_without_antecedent_are_null(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "B")], "case_id long, slot string")
    out = rules.item_rules(rows, {"r": (F.bool_or(F.col("slot") == "A"), F.bool_or(F.col("slot") == "C"))})
    assert {r.case_id: r.satisfied for r in out.collect()} == {1: False, 2: None}
    assert rules.compliance(out, "rule").first().n == 1


def test_checks(spark):
    child = spark.createDataFrame([(1,), (1,), (3,)], "k long")
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    assert quality.orphans(child, parent, ["k"], ["id"], "c").first().n == 1
    assert quality.duplicates(child, ["k"], "d").first().n == 1
    problems = quality.schema_conformance(child, {"k": ("int", True), "z": ("string", True)}).collect()
    assert {(r.column, r.problem) for r in problems} == {("k", "type bigint"), ("z", "missing")}


def test_pairs_and_sets(spark):
    sets = spark.createDataFrame([(k, e) for k, s in {1: "abcde", 2: "abcdf", 3: "xyz", 4: "abcde"}.items() for e in s], "id long, e string")
    got = {(r.a, r.b): r.common for r in linkage.overlap_pairs(sets, "id", "e", threshold=0.6).collect()}
    assert got == {(1, 2): 4, (1, 4): 5, (2, 4): 4}
    votes = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (2, 2, 8), (2, 1, 1)], "a long, b long, e long")
    chosen = {(r.a, r.b) for r in linkage.greedy_one_to_one(votes, "a", "b", "e").collect()}
    assert chosen == {(1, 2), (2, 1)}
    assert linkage.greedy_one_to_one(votes.limit(0), "a", "b", "e").count() == 0
    empty = mining.pair_overlap(spark.createDataFrame([(1, 2)], "case_id long, next_id long"), spark.createDataFrame([], "case_id long, p long"), "p").first()
    assert empty.jaccard == 0.0


def test_statistics(spark):
    rows = spark.createDataFrame([("g", float(x), float(y)) for x, y in ((1, 2), (2, 1), (2, 3), (4, 9))], "g string, x double, y double")
    assert stats.spearman(rows, ["g"], "x", "y").first().rho == pytest.approx(0.632456)
    out = stats.wilcoxon(rows, F.col("y") - F.col("x")).first()
    assert (out.n, out.w_plus, out.w_minus) == (4, 8.0, 2.0)
    band = [stats.bootstrap_mean(rows.withColumn("k", F.col("y")), "y", "k", replicates=20, seed=1).first() for _ in range(2)]
    assert band[0] == band[1] and band[0].low <= band[0].mean <= band[0].high


def test_vector_scores_hold_the_best_the_least_and_all_ties(spark):
    import random

    from casework.functions.columns import cosine
    from casework.operators import retrieve as R

    rng = random.Random(4)
    vec = lambda: [float(rng.randrange(-2, 3)) for _ in range(3)]
    odd = [(900, "a", None), (901, "a", [0.0, 0.0, 0.0]), (902, None, [1.0, 1.0, 0.0]), (903, "b", [1.0, None, 0.0]), (904, "b", [1.0, 2.0]), (None, "a", [1.0, 0.0, 0.0])]
    v = spark.createDataFrame([(i, rng.choice("ab"), vec()) for i in range(500)] + odd, "vec_id long, label string, embedding array<float>")
    q = v.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "label AS q_label", "embedding AS q_embedding")
    every = q.join(v, q.query_id != v.vec_id).select("query_id", "vec_id", (F.col("label") == F.col("q_label")).alias("same"), F.round(cosine(F.col("embedding"), F.col("q_embedding")), 6).alias("cosine"))
    found = R.vector_scores(q, v, 10)
    assert found.count() < every.count()
    for order in ([F.desc("cosine"), F.asc("vec_id")], [F.desc("same"), F.desc("cosine"), F.asc("vec_id")]):
        one, other = (sorted(map(repr, R.best(x, ["query_id"], order, 10).collect())) for x in (found, every))
        assert one == other
    one, other = (sorted(map(repr, R.hybrid_topk(x, 10, 0.6).collect())) for x in (found, every))
    assert one == other


def test_pairs_of_the_owners_asked_for(spark):
    rows = [(k, f"e{(k * 3 + j) % 19}") for k in range(120) for j in range(4)]
    sets = spark.createDataFrame(rows, "id long, e string").distinct()
    asked = spark.range(0, 120, 9)
    every = {tuple(r) for r in linkage.overlap_pairs(sets, "id", "e", threshold=0.5).collect()}
    some = [tuple(r) for r in linkage.overlap_pairs(sets, "id", "e", threshold=0.5, asked=asked).collect()]
    assert sorted(some) == sorted(p for p in every if p[0] % 9 == 0 or p[1] % 9 == 0) and any(p[0] % 9 == p[1] % 9 == 0 for p in some)
    assert len(some) < len(every) and all(a < b for a, b, *_ in some)

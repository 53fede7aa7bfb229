"""Leave-one-out parts against plain loops, and their edges."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from casework.operators import evaluate as E
from casework.operators import retrieve as R


def jaccard(a, b):
    return round(len(a & b) / len(a | b), 6) if a | b else 0.0


def made(spark, seed=5):
    """Element sets of 40 cases, and two arms of neighbours of four queries."""
    rng = random.Random(seed)
    sets = {c: {f"e{rng.randrange(12)}" for _ in range(rng.randrange(1, 7))} for c in range(40)}
    near = {(arm, q): rng.sample(range(4, 40), 6 if arm == "wide" else 2) for arm in ("wide", "small") for q in range(4)}
    near_df = spark.createDataFrame([(a, q, c, i + 1) for (a, q), cs in near.items() for i, c in enumerate(cs)], "arm string, query_id int, case_id int, rank int")
    sets_df = spark.createDataFrame([(c, e) for c, es in sets.items() for e in es], "case_id int, element string")
    held_df = spark.createDataFrame([(q, e) for q in range(4) for e in sets[q]], "query_id int, element string")
    return sets, near, near_df, sets_df, held_df


def agreed(sets, cases, least):
    votes = {}
    for c in cases:
        for e in sets[c]:
            votes[e] = votes.get(e, 0) + 1
    return {e for e, n in votes.items() if round(n / len(cases), 6) >= least}


def test_arms_by_plain_loop(spark):
    sets, near, near_df, sets_df, held_df = made(spark)
    found = {(r.arm, r.query_id): (r.composed, r.copied) for r in E.arms(near_df, sets_df, held_df, 0.4).collect()}
    assert found == {key: (jaccard(agreed(sets, cs, 0.4), sets[key[1]]), jaccard(sets[cs[0]], sets[key[1]])) for key, cs in near.items()}
    assert {r.arm for r in E.arms(near_df, sets_df, held_df, 0.4, least=3).collect()} == {"wide"}
    assert E.arms(near_df.limit(0), sets_df, held_df, 0.4).count() == 0
    table = {r.arm: r for r in E.against_arm(E.arms(near_df, sets_df, held_df, 0.4), "wide").collect()}
    gains = [found["small", q][0] - found["wide", q][0] for q in range(4)]
    assert (table["wide"].difference, table["wide"].wins, table["wide"].losses) == (0.0, 0, 0)
    assert (table["small"].n, table["small"].wins, table["small"].losses) == (4, sum(g > 0 for g in gains), sum(g < 0 for g in gains))


def test_a_consensus_that_says_nothing_counts_nought(spark):
    near = spark.createDataFrame([("a", 1, 2, 1), ("a", 1, 3, 2)], "arm string, query_id int, case_id int, rank int")
    sets = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "case_id int, element string")
    held = spark.createDataFrame([(1, "x")], "query_id int, element string")
    assert [tuple(r) for r in E.arms(near, sets, held, 0.9).collect()] == [("a", 1, 0.0, 1.0)]


def test_a_grid_may_not_weigh_alike_twice():
    assert E.distinct_grid({"a": (1, 0), "b": (0, 1)})
    with pytest.raises(ValueError, match="b weighs as a"):
        E.distinct_grid({"a": (1, 3), "b": (2, 6)})


def test_sweep_keeps_an_entity_on_one_side_and_chooses_on_the_other(spark):
    queries = spark.createDataFrame([(q, q % 25) for q in range(200)], "query_id int, entity int")
    halves = queries.select("query_id", "entity", E.half_of(queries["entity"]).alias("half"))
    assert max(r["count"] for r in halves.select("entity", "half").distinct().groupBy("entity").count().collect()) == 1
    dev = {r.query_id for r in halves.filter("half = 'dev'").collect()}
    # b is best where it is held out, a where it is developed: a is chosen.
    scores = spark.createDataFrame([(w, q, float((w == "a") == (q in dev)), 0.0) for q in range(200) for w in "ab"], "weights string, query_id int, composed double, copied double")
    rows = E.sweep_table(scores, halves.select("query_id", "half")).collect()
    assert {(r.weights, r.half, r.composed, r.chosen) for r in rows} == {("a", "dev", 1.0, True), ("a", "holdout", 0.0, True), ("b", "dev", 0.0, False), ("b", "holdout", 1.0, False)}


@pytest.mark.parametrize("weights", [(0.45, 0.15, 0.20, 0.10, 0.10), (0.0, 0.3, 0.3, 0.2, 0.2), (1.0, 0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 4.0)])
def test_pool_of_any_weights_is_that_of_all_pairs(spark, weights):
    rng = random.Random(9)
    cases = [(c, c // 3, rng.choice("xyz"), rng.choice("st"), rng.choice(["n", "m", None]), rng.choice("ab"), round(rng.uniform(-900, 9000), 2)) for c in range(240)]
    names = ("objective", "segment", "nation", "region", "balance")
    candidates = spark.createDataFrame(cases, "case_id int, entity_id int, objective string, segment string, nation string, region string, balance double")
    queries = candidates.filter("case_id % 20 = 0").selectExpr("case_id AS query_id", "entity_id AS q_entity_id", *[f"{c} AS q_{c}" for c in names])
    found = {(r.query_id, r.rank): r.case_id for r in R.attribute_pool(queries, candidates, 5, weights=weights).collect()}

    def score(q, c):
        same = [0.5 if None in (a, b) else float(a == b) for a, b in zip(q[2:6], c[2:6], strict=True)]
        return round(sum(m * w for m, w in zip([*same, 1 - min(abs(q[6] - c[6]), 5000.0) / 5000.0], weights, strict=True)) / sum(weights), 6)

    for q in cases[::20]:
        best = sorted((-score(q, c), c[0]) for c in cases if c[1] != q[1])[:5]
        assert [found[q[0], i + 1] for i in range(5)] == [c for _, c in best]


def test_pool_refuses_weights_that_say_nothing(spark):
    empty = spark.createDataFrame([], "query_id int")
    for weights in ((0, 0, 0, 0, 0), (1, -1, 0, 0, 1)):
        with pytest.raises(ValueError):
            R.attribute_pool(empty, empty, 3, weights=weights)


def test_history_is_strictly_earlier_and_bounded(spark):
    cases = spark.createDataFrame([(10 + v, 1, v) for v in range(1, 8)] + [(30, 2, 1)], "case_id int, entity_id int, version int")
    queries = spark.createDataFrame([(11,), (13,), (17,), (30,)], "query_id int")
    found = sorted(tuple(r) for r in E.own_history(cases, queries, 3).collect())
    assert found == [(13, 11, 2), (13, 12, 1), (17, 14, 3), (17, 15, 2), (17, 16, 1)]
    assert E.own_history(cases.limit(0), queries, 3).count() == 0


def test_recurrent_variants_by_plain_loop(spark):
    sets, near, _, sets_df, _ = made(spark, 8)
    previous = {0: (20, True), 1: (21, False), 2: (22, False)}
    mixed = {q: [*near["wide", q][:3], previous[q][0]] if q in previous else near["wide", q] for q in range(4)}
    mixed = {q: list(dict.fromkeys(cs)) for q, cs in mixed.items()}

    def frame(pairs):
        return spark.createDataFrame(pairs, "query_id int, case_id int")

    out = {}
    said = E.recurrent_variants(
        frame([(q, c) for q in range(4) for c in near["wide", q]]), frame([(q, c) for q, cs in mixed.items() for c in cs]),
        spark.createDataFrame([(q, c, ch) for q, (c, ch) in previous.items()], "query_id int, case_id int, changed boolean"), sets_df, 0.4,
    )
    for r in said.collect():
        assert r.element not in out.setdefault((r.variant, r.query_id), set())
        out[r.variant, r.query_id].add(r.element)
    for q, (before, changed) in previous.items():
        history = agreed(sets, mixed[q], 0.4)
        backed = sets[before] & set().union(*[sets[c] for c in mixed[q] if c != before])
        want = {"copy_previous": sets[before], "cold": agreed(sets, near["wide", q], 0.4), "history": history, "renewed": history | backed, "routed": history if changed else history | backed}
        assert {v: out.get((v, q), set()) for v in want} == want
    assert not any(q == 3 for _, q in out)


def test_slots_by_plain_loop(spark):
    held = {(1, "am"): {"a", "b"}, (1, "pm"): {"c"}, (2, "am"): {"a"}}
    said = {("v", 1, "am"): {"a"}, ("v", 2, "am"): {"b"}, ("w", 1, "pm"): {"c"}, ("w", 2, "pm"): {"d"}}
    held_df = spark.createDataFrame([(q, s, e) for (q, s), es in held.items() for e in es], "query_id int, slot string, element string")
    said_df = spark.createDataFrame([(q, v, s, e) for (v, q, s), es in said.items() for e in es], "query_id int, variant string, slot string, element string")
    found = {(r.variant, r.slot): (r.n, r.present, r.jaccard) for r in E.per_slot(said_df, held_df).collect()}
    assert found == {("v", "am"): (2, 1.0, 0.25), ("v", "pm"): (1, 0.0, 0.0), ("w", "am"): (2, 0.0, 0.0), ("w", "pm"): (1, 1.0, 1.0)}


def test_divided_bands_hold_the_same_best(spark, monkeypatch):
    """With cells of few cases the bands are divided several times; what is retrieved stays that of all pairs."""
    monkeypatch.setattr(R, "FULL", 2)
    rng = random.Random(11)
    facts = {e: (rng.choice(["a", "b"]), rng.choice(["x", None]), "r", rng.choice([None, -300.0, 0.0, round(rng.uniform(-999, 9999), 2)])) for e in range(300)}
    cases = [(i, i % 300, rng.choice("op"), *facts[i % 300]) for i in range(1500)]
    columns = "case_id long, entity_id long, objective string, segment string, nation string, region string, balance double"
    candidates = spark.createDataFrame(cases, columns)
    queries = candidates.filter("case_id % 25 = 0").select(F.col("case_id").alias("query_id"), *[F.col(c).alias("q_" + c) for c in ("entity_id", "objective", "segment", "nation", "region", "balance")])
    found = R.attribute_pool(queries, candidates, 12)
    pairs = queries.join(candidates, queries.q_entity_id != candidates.entity_id).select("query_id", "case_id", R.attribute_score().alias("score"))
    want = R.best(pairs, ["query_id"], [F.desc("score"), F.asc("case_id")], 12)
    assert sorted(map(tuple, found.select("query_id", "case_id", "score", "rank").collect())) == sorted(map(tuple, want.collect()))


def test_equal_cases_meet_a_query_no_oftener_than_it_needs(spark):
    """Cases of equal traits and balance tie for every query: the first by id are kept before the join, own cases beside them."""
    rows = [(i, i % 400 if i % 2 else 7, "o", "s", "n", "r", 100.0 if i % 3 else None) for i in range(3000)]
    candidates = spark.createDataFrame(rows, "case_id long, entity_id long, objective string, segment string, nation string, region string, balance double")
    queries = candidates.filter("case_id IN (0, 1, 4, 2999)").select(F.col("case_id").alias("query_id"), F.col("entity_id").alias("q_entity_id"), *[F.col(c).alias("q_" + c) for c in (*R.TRAITS, "balance")])
    found = R.attribute_pool(queries, candidates, 12)
    pairs = queries.join(candidates, queries.q_entity_id != candidates.entity_id).select("query_id", "case_id", R.attribute_score().alias("score"))
    want = R.best(pairs, ["query_id"], [F.desc("score"), F.asc("case_id")], 12)
    assert sorted(map(tuple, found.select("query_id", "case_id", "score", "rank").collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "nth" in plan


@pytest.mark.parametrize("weights", [(1.0, 0.0, 0.0, 0.0, 0.0), (0.5, 0.0, 0.5, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 1.0)])
def test_cases_that_differ_in_what_has_no_weight_are_equal(spark, monkeypatch, weights):
    rows = [(i, i // 2, "op"[i % 2], "st"[i % 3 % 2], "nm"[i % 5 % 2], None if i % 7 == 0 else "r", float(i % 3) if weights[4] else i * 9.0) for i in range(900)]
    candidates = spark.createDataFrame(rows, "case_id long, entity_id long, objective string, segment string, nation string, region string, balance double")
    queries = candidates.filter("case_id % 300 = 0").select(F.col("case_id").alias("query_id"), F.col("entity_id").alias("q_entity_id"), *[F.col(c).alias("q_" + c) for c in (*R.TRAITS, "balance")])
    met, best = [], R.best
    monkeypatch.setattr(R, "best", lambda rows, by, *rest: (met.append(rows.count()) if by == ["query_id"] else None) or best(rows, by, *rest))
    found = R.attribute_pool(queries, candidates, 12, weights=weights)
    pairs = queries.join(candidates, queries.q_entity_id != candidates.entity_id).select("query_id", "case_id", (F.col("objective") == F.col("q_objective")).alias("same"), R.attribute_score(weights=weights).alias("score"))
    want = best(pairs, ["query_id"], [F.desc("score"), F.asc("case_id")], 12)
    assert sorted(map(tuple, found.select("query_id", "case_id", "same", "score", "rank").collect())) == sorted(map(tuple, want.collect()))
    if not weights[4]:
        assert met[0] <= 3 * (12 + 2)  # what a query needs beside its own entity's two cases


def test_steps_of_retrieval_begin_with_candidates_written_once(spark):
    from casework.plans import q_retrieval
    from casework.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    read = {f for _ in range(2) for f in q_retrieval.stated_queries(t).inputFiles()}
    assert read and read == set(t.once("candidates", lambda: None).inputFiles())
    columns = ["case_id", "entity_id", "objective", "segment", "nation", "region", "balance"]
    assert sorted(map(repr, q_retrieval.known_cases(t).select(columns).collect())) == sorted(map(repr, q_retrieval.candidates(t).select(columns).collect()))


def test_checks_of_proposals_read_them_where_they_are_written(spark):
    from casework.plans import q_validate
    from casework.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    found = q_validate.proposal_conformance(t)
    read, near = set(found.inputFiles()), t.once("neighbourhood", lambda: None).inputFiles()
    assert near and not read & set(near) and read & set(t.once("stay", lambda: None).inputFiles())

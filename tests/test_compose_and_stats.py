"""Order-dependent composition and paired statistics against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casework.operators import compose, consensus, evaluate, mapping, stats


def turned(current, repertoire, habits, refused, budgets, least_n):
    """The rotation, one plan after the other, with all candidates at hand."""
    placed = sorted((f, r, place, p) for p, f, r, place in repertoire)
    known, out = {p: (pers, n, anchor) for p, pers, n, anchor in habits}, []
    plans = defaultdict(list)
    for row in current:
        plans[row[0]].append(row)
    for q, rows in plans.items():
        left = {k: round(s * sum(r[6] == k for r in rows)) for k, s in budgets.items()}
        present, no = {r[3] for r in rows}, {p for query, p in refused if query == q}
        for _, slot, line, p, family, role, kind in sorted(rows, key=lambda r: (known.get(r[3], (0.0, 0, None))[0], r[1], r[2], r[3])):
            _, n, anchor = known.get(p, (0.0, 0, None))
            new, fate = None, "none"
            if anchor:
                fate = "anchor"
            elif n < least_n:
                fate = "rare"
            elif left.get(kind, 0) <= 0:
                fate = "budget"
            else:
                new = next((c for f, r, _, c in placed if (f, r) == (family, role) and c not in present and c not in no), None)
                if new is not None:
                    fate = "renewed"
                    left[kind] -= 1
                    present.add(new)
            out.append((q, slot, line, p, new, fate))
    return sorted(out)


@pytest.mark.parametrize("budgets", [{"main": 0.3, "slow": 0.1}, {"main": 1.0, "slow": 0.5}, {"main": 0.0}])
def test_rotate(spark, budgets):
    rng = random.Random(str(budgets))
    products = [(p, rng.choice("fg"), rng.choice("xy"), rng.choice([1, 2, 3, 3])) for p in range(60)]
    of = {p: (f, r) for p, f, r, _ in products}
    kinds = {p: rng.choice(["main", "main", "slow"]) for p in of}
    current = [(q, rng.choice("AB"), i, p, *of[p], kinds[p]) for q in range(15) for i, p in enumerate(rng.sample(range(60), rng.choice([1, 4, 12])))]
    habits = [(p, rng.choice([0.1, 0.5, 0.5, 0.9]), rng.randrange(5), rng.random() < 0.2) for p in range(50)]
    refused = [(q, rng.randrange(60)) for q in range(15) for _ in range(rng.choice([0, 3, 40]))]
    got = compose.rotate(
        spark.createDataFrame(current, "query_id long, slot string, line_no int, product long, family string, role string, kind string"),
        spark.createDataFrame(products, "product long, family string, role string, place int"),
        spark.createDataFrame(habits, "product long, persistence double, n int, anchor boolean"),
        spark.createDataFrame(refused, "query_id long, product long"),
        budgets=budgets, least_n=2,
    )
    want = turned(current, products, habits, refused, budgets, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    new = Counter((r[0], r[4]) for r in want if r[4] is not None)
    assert all(n == 1 for n in new.values())


def test_compound_partition(spark):
    rng = random.Random(6)
    chain = [(f"c{i:03}", f"c{i + 1:03}", 3, 4) for i in range(45)]
    rows = chain + [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}", rng.randrange(4), 4) for _ in range(40)] + [("p", "q", 1, 1), ("x", "y", 9, 9)]
    rows = [r for r in rows if r[0] != r[1]]
    got = {r.node: r.component for r in compose.compound_partition(
        spark.createDataFrame(rows, "a string, b string, together long, shared long"), least=2, alternatives=spark.createDataFrame([("y", "x")], "a string, b string")
    ).collect()}
    label = {n: n for r in rows for n in r[:2]}
    for _ in label:
        for a, b, together, shared in rows:
            if together >= 2 and together >= 0.5 * shared and {a, b} != {"x", "y"}:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label and got["c045"] == "c000" and got["q"] == "q" and got["y"] == "y"


def test_alternative_groups(spark):
    rng = random.Random(7)
    names = [f"p{i}" for i in range(12)]
    pairs = {(a, b) for a in names for b in names if a != b and rng.random() < 0.4}
    pairs |= {(b, a) for a, b in pairs}
    products = [(q, s, p, rng.choice([0.4, 0.5, 0.9])) for q in range(4) for s in "AB" for p in rng.sample(names, rng.choice([1, 5, 12]))]
    got = compose.alternative_groups(spark.createDataFrame(products, "query_id long, slot string, family string, support double"), spark.createDataFrame(sorted(pairs), "a string, b string"), most=3)
    want = set()
    for q in range(4):
        for s in "AB":
            groups = []
            for p in sorted((x for x in products if x[:2] == (q, s)), key=lambda x: (-x[3], x[2])):
                home = next((n for n, g in enumerate(groups) if len(g) < 3 and sum((p[2], m) in pairs for m in g) >= 0.5 * len(g)), None)
                if home is None:
                    home = len(groups)
                    groups.append([])
                groups[home].append(p[2])
                want.add((q, s, p[2], home))
    assert {tuple(r) for r in got.collect()} == want


def test_repeat_penalty(spark):
    rng = random.Random(8)
    rows = [(i, [(s, rng.random()) for s in "abcdef"[: rng.randrange(7)]]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, supports array<struct<slot:string,support:double>>")
    got = {r.id: list(r.slots) for r in frame.select("id", consensus.accepted_slots(F.col("supports"), F.lit(0.3), 0.2).alias("slots")).collect()}
    for i, supports in rows:
        done = []
        for slot, support in supports:
            if support >= 0.3 + 0.2 * len(done):
                done.append(slot)
        assert got[i] == done


def test_long_names_are_found(spark):
    names = [("ring", 1), ("steel ring", 2), ("blue steel ring with lid", 3), ("a b c d e f g h i", 4)]
    texts = [(1, "my blue steel ring with lid please"), (2, "a steel ring"), (3, "so a b c d e f g h i"), (4, None), (5, ""), (6, "Rings")]
    got = mapping.match_free_text(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "key string, product_id long"), splits=",").collect()
    assert {r.id: (r.product_id, r.how) for r in got} == {1: (3, "contained"), 2: (2, "contained"), 3: (4, "contained"), 6: (1, "singular")}
    none = mapping.match_free_text(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "key string, product_id long"))
    assert {r.how for r in none.collect()} == {None}


def test_strangers(spark):
    rng = random.Random(9)
    cases = [(i * 97, rng.randrange(50), rng.choice("xyz")) for i in range(600)]
    queries = [(q, e, o) for q, e, o in rng.sample(cases, 80)]
    got = evaluate.strangers(spark.createDataFrame(queries, "query_id long, q_entity_id long, q_objective string"), spark.createDataFrame(cases, "case_id long, entity_id long, objective string")).collect()
    of, asked = {c: (e, o) for c, e, o in cases}, {q: (e, o) for q, e, o in queries}
    assert Counter(r.kind for r in got) == {"any": 80, "same": 80, "other": 80}
    for r in got:
        entity, objective = of[r.case_id]
        assert entity != asked[r.query_id][0] and (r.kind == "any" or (objective == asked[r.query_id][1]) == (r.kind == "same"))
    drawn = [r.case_id for r in got if r.kind == "same"]
    assert len(set(drawn)) > 40 and max(drawn) > 97 * 400


def test_exact_binomial_and_normal_tail(spark):
    pairs = [(0, 0), (5, 0), (3, 3), (1, 9), (40, 60), (700, 800)]
    frame = spark.createDataFrame(pairs, "w long, l long")
    got = {(r.w, r.l): r.p for r in frame.select("w", "l", stats.binomial_two_sided(F.col("w"), F.col("l")).alias("p")).collect()}
    for w, l in pairs:
        n = w + l
        assert got[w, l] == pytest.approx(min(1.0, 2 * sum(math.comb(n, k) for k in range(min(w, l) + 1)) / 2**n), rel=1e-9)
    zs = [0.0, 0.5, 1.96, -1.96, 4.0]
    tails = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(stats.normal_tail(F.col("z")).alias("p")).collect()]
    assert tails == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], abs=2e-7)


def test_bootstrap_of_a_mean(spark):
    rows = [(i, (i % 7) / 10 - 0.2) for i in range(300)] + [(999, None)]
    got = stats.bootstrap_mean(spark.createDataFrame(rows, "id long, d double"), "d", "id", replicates=200).first()
    values = [d for _, d in rows if d is not None]
    mean = sum(values) / len(values)
    spread = 1.96 * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values) / len(values))
    assert got.n == 300 and got.mean == pytest.approx(mean)
    assert got.low == pytest.approx(mean - spread, abs=0.3 * spread) and got.high == pytest.approx(mean + spread, abs=0.3 * spread)


def test_rotate_lists_candidates_once(spark):
    """Candidates come from one list for each family and role, and no grouped function is started for each plan."""
    from casework.operators import compose

    current = spark.createDataFrame([(q, "s", n, n, "f", "r", "main") for q in range(5) for n in range(4)], "query_id long, slot string, line_no int, product long, family string, role string, kind string")
    places = spark.range(400).selectExpr("id AS product", "'f' AS family", "'r' AS role", "id AS place")
    habits = spark.range(400).selectExpr("id AS product", "id / 400 AS persistence", "5 AS n", "false AS anchor")
    refused = spark.createDataFrame([(0, 4), (0, 5), (1, 4)], "query_id long, product long")
    out = compose.rotate(current, places, habits, refused, budgets={"main": 0.5})
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    renewed = {(r.query_id, r.old): r.new for r in out.collect() if r.fate == "renewed"}
    assert renewed == {(0, 0): 6, (0, 1): 7, (1, 0): 5, (1, 1): 6} | {(q, n): 4 + n for q in (2, 3, 4) for n in (0, 1)}
    assert out.filter("fate = 'budget'").count() == 10

"""Interval joins, votes, relabelling, slips, schedules and relocation against plain loops."""

from __future__ import annotations

import datetime as dt
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casework.operators import extract
from casework.operators import joins as J
from casework.operators import linkage as L
from casework.operators import relocate as R
from casework.operators import schedule as S
from casework.operators import terms as W

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def test_readings_in_overlapping_windows(spark):
    rng = random.Random(1)
    spans = [(i, rng.choice(["a", "b", "c"]), a := rng.randrange(40), a + rng.randrange(0, 15)) for i in range(60)] + [(90, "a", None, 5), (91, "a", 3, None), (92, None, 1, 9), (93, "z", 0, 99)]
    readings = [(rng.choice(["a", "b"]), rng.randrange(50), float(rng.randrange(9))) for _ in range(120)] + [("a", None, 1.0), (None, 3, 2.0), ("b", 20, None)]
    got = J.readings_in_window(
        spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in spans], "id long, k string, a timestamp, b timestamp"),
        spark.createDataFrame([(k, at(t), v) for k, t, v in readings], "k string, t timestamp, v double"),
        by="k", start="a", stop="b", time="t", value="v",
    )
    rows = {r.id: (r.n, r.first_value, r.last_value) for r in got.collect()}
    low = lambda v: -1.0 if v is None else v
    for i, k, a, b in spans:
        inside = sorted(((t, low(v), v) for key, t, v in readings if None not in (k, a, b, t) and key == k and a <= t < b), key=lambda x: x[:2])
        assert rows[i] == ((len(inside), inside[0][2], inside[-1][2]) if inside else (0, None, None)), i


def test_nearest_by_time(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), rng.choice([None, *range(12)])) for i in range(40)]
    right = [(100 + i, rng.choice("ab"), rng.choice([None, *range(12)])) for i in range(60)]
    make = lambda rows: spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], "id long, k string, t timestamp")
    got = J.nearest_by_time(make(left), make(right), by="k", left_id="id", left_time="t", right_id="id", right_time="t", k=4)
    want = []
    for i, k, t in left:
        near = sorted((abs(t - u) * 3_600_000_000, j) for j, key, u in right if key == k and u is not None) if t is not None else []
        want += [(i, j, gap, n) for n, (gap, j) in enumerate(near[:4], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_votes_of_shingles_that_many_hold(spark):
    rows = [(i, "x", f"s{k}") for i in range(60) for k in range(6)] + [(100, "y", f"s{k}") for k in range(5)] + [(200, "z", "s5"), (200, "z", "own")]
    got = L.owned_votes(spark.createDataFrame(rows, "d long, o string, s string"), doc="d", owner="o", shingle="s", least=3).collect()
    assert {(r.a, r.b): (r.evidence, r.containment) for r in got} == {(i, "y"): (5, round(5 / 6, 6)) for i in range(60)}


def test_greedy_one_to_one(spark):
    rng = random.Random(3)
    votes = {(rng.randrange(15), rng.randrange(15)): rng.randrange(6) for _ in range(90)}
    votes |= {(100 + i, 100 + i): 50 - i for i in range(6)} | {(101 + i, 100 + i): 50 - i for i in range(6)}  # a falling chain of ties
    want, left, right = set(), set(), set()
    for (a, b), n in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
        if a not in left and b not in right:
            want.add((a, b, n))
            left.add(a)
            right.add(b)
    got = L.greedy_one_to_one(spark.createDataFrame([(a, b, n) for (a, b), n in votes.items()], "a long, b long, n long"), "a", "b", "n")
    assert {tuple(r) for r in got.collect()} == want
    assert L.greedy_one_to_one(spark.createDataFrame([], "a long, b long, n long"), "a", "b", "n").count() == 0


def test_relabelled(spark):
    old = {"A": [1, 2, 3], "B": [4, 5], "C": [6, 7, 8, 9], "D": [10, 11], "E": [12]}
    new = {"p": [1, 2, 3], "q": [4], "r": [5], "s": [6, 7, 8, 9, 10], "t": [20, 21], "u": [11, 30]}
    frame = lambda groups: spark.createDataFrame([(m, g) for g, ms in groups.items() for m in ms], "member long, group string")
    got = {(r.group, r.was): (r.label, r.n, r.shared, r.kind) for r in L.relabelled(frame(old), frame(new)).collect()}
    assert got == {
        ("p", "A"): ("A", 3, 3, "same"),
        ("q", "B"): ("B", 1, 1, "split"),
        ("r", "B"): ("r", 1, 1, "split"),
        ("s", "C"): ("C", 5, 4, "merged"),
        ("t", None): ("t", 2, 0, "new"),
        ("u", "D"): ("u", 2, 1, "split"),
        (None, "D"): ("D", 2, 0, "gone"),
        (None, "E"): ("E", 1, 0, "gone"),
    }


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_within_edits(spark, most):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(90)}
    terms = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(40)}
    got = W.within_edits(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"), most=most)
    want = {(w, t, d) for w, t in itertools.product(words, terms) if (d := edits(w, t)) <= most}
    assert {tuple(r) for r in got.collect()} == want


def test_read_categories(spark):
    terms = spark.createDataFrame([("slim", "ectomorph"), ("strong", "mesomorph"), ("round", "endomorph"), ("strong", "fit")], "category string, term string")
    rows = [(1, "Ectomorph"), (2, "estomorph type, 178 cm"), (3, "rather a mesomrph than endomorph 81,5 kg"), (4, "fit"), (5, "fat"), (6, None), (7, ""), (8, "ectomorph ectomorph 999 kg"), (9, "ectomorphic")]
    got = W.read_categories(spark.createDataFrame(rows, "id long, t string"), terms, key="id", text="t", measures={"cm": (r"([0-9]{3}) ?cm", 140, 220), "kg": (r"([0-9]{2,3}(?:[.,][0-9])?) ?kg", 30, 250)})
    assert {r.id: tuple(r)[1:] for r in got.collect()} == {
        1: ("slim", None, True, None, None),
        2: ("slim", None, False, 178.0, None),
        3: ("strong", "round", False, None, 81.5),
        4: ("strong", None, True, None, None),
        5: (None, None, False, None, None),
        6: (None, None, False, None, None),
        7: (None, None, False, None, None),
        8: ("slim", None, False, None, None),
        9: ("slim", None, False, None, None),
    }


def test_synonym_audit(spark):
    forms = [("oil", "olive oil", 9), ("oil", "oliveoil", 1), ("bread", "bread", 30), ("bread", "braed", 2), ("roll", "bread", 3), ("bread", "xread", 1), ("roll", "rollgram", 1), ("roll", "roll", 9), ("oil", "gram", 1)]
    got = {(r.form, r.canonical, r.kind, r.other) for r in W.synonym_audit(spark.createDataFrame(forms, "canonical string, form string, n long"), units=["gram"]).collect()}
    assert got == {
        ("olive oil", "oil", "split", "oliveoil"),
        ("braed", "bread", "slip", "bread"),
        ("xread", "bread", "slip", "bread"),
        ("rollgram", "roll", "glued", "roll gram"),
        ("gram", "oil", "unit", None),
        ("bread", "bread", "shared", "bread"),
        ("bread", "roll", "shared", "bread"),
        ("bread", "roll", "name", "bread"),
    }


WORDS = S.ScheduleWords(r"([0-9]) (?:days|times) (?:a|per) week", ["monday", "friday"], r"(?:^|\n)session ([a-z0-9])\b", {"run": "running", "lift": "weights"}, {"legs": "legs"})


def test_extract_schedule(spark):
    rows = [(1, "5 days a week\nMonday: running"), (2, "FRIDAY legs, Monday legs, friday"), (3, "Session A: weights\nsession b\nSession A"), (4, "nothing"), (5, None), (6, "mondays 12 days a weekend")]
    got = {r.id: tuple(r)[1:] for r in S.extract_schedule(spark.createDataFrame(rows, "id long, t string"), WORDS, key="id", text="t").collect()}
    assert got == {
        1: (5, "stated", "monday", 0, "run", ""),
        2: (2, "days", "monday,friday", 0, "", "legs"),
        3: (2, "sessions", "", 2, "lift", ""),
        4: (None, None, "", 0, "", ""),
        5: (None, None, "", 0, "", ""),
        6: (2, "stated", "", 0, "", ""),
    }


def test_date_in(spark):
    months = ["january", "march", "may"]  # a name's place in the list is its month
    cases = {
        "on 2024-02-29 and 1/1/2020": dt.date(2024, 2, 29), "1/3/24": dt.date(2024, 3, 1), "01.12.1998": dt.date(1998, 12, 1), "5-6-71": dt.date(1971, 6, 5), "5-6-69": dt.date(2069, 6, 5),
        "31/2/2024": None, "12 March 2020": dt.date(2020, 2, 12), "12345-01-01": None, "none": None, "": None, None: None, "1/2/345": None,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, t string")
    got = {r.id: r.d for r in rows.select("id", S.date_in(F.col("t"), months=months).alias("d")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_dated_measures(spark):
    text = "01/02/2024 weight: 81,5 kg fat 20%\n02/02/2024 weight 300\nweight 80\n03/02/1890 weight 80\n04/02/2024 fat 90 weight 79"
    measures = {"kg": (r"weight\D{0,4}([0-9]{2,3}(?:,[0-9])?)", 30, 250), "fat": (r"fat\D{0,4}([0-9]{1,2})", 3, 70)}
    got = S.dated_measures(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), measures, key="id", text="t", first_year=1990, last_year=2030)
    assert [tuple(r) for r in got.orderBy("line").collect()] == [(1, 0, dt.date(2024, 2, 1), 81.5, 20.0), (1, 4, dt.date(2024, 2, 4), 79.0, None)]


def test_relocate_blocks(spark):
    lines = [
        (1, "lunch", 1, 0, "100 g rice"), (1, "lunch", 1, 1, "After training (18:30):"), (1, "lunch", 1, 2, "1 shake"), (1, "lunch", 1, 3, "Remember: drink"), (1, "lunch", 1, 4, "much water"),
        (1, "lunch", 1, 5, "Option b:"), (1, "lunch", 1, 6, "2 eggs"), (1, "dinner", 2, 0, "fish"), (1, "dinner", 2, 1, "Page: 2"),
        (2, "snack", 1, 0, "Remember 2 h: sleep"), (2, "snack", 1, 1, "12:30 tea"), (2, "snack", 1, 2, "Snack: 1 nut"), (3, "training", 3, 0, "3 dates"), (3, "early", 1, 0, "After training: 1 banana"), (3, "early", 1, 1, None),
    ]
    frame = spark.createDataFrame(lines, "doc_id long, slot string, slot_no int, pos int, line string")
    rules = [("^after training", "move", "training"), ("^page", "drop", None)]
    decided = {r.label: (r.blocks, r.components, r.fate) for r in R.label_decisions(R.label_blocks(frame, ["snack"]), rules, r"^\s*[0-9]").collect()}
    assert decided == {"after training": (2, 1, "move"), "remember": (2, 1, "note"), "option b": (1, 1, "keep"), "page": (1, 0, "drop")}
    placed = R.relocate_blocks(frame, rules, known=["snack"])
    got = defaultdict(list)
    for r in placed.orderBy("place").collect():
        got[r.doc_id, r.part, r.slot].append(r.line)
    assert dict(got) == {
        (1, "text", "lunch"): ["100 g rice", "Option b:", "2 eggs"],
        (1, "text", "training"): ["After training (18:30):", "1 shake"],
        (1, "text", "dinner"): ["fish"],
        (1, "note", None): ["Remember: drink", "much water"],
        (1, "dropped", None): ["Page: 2"],
        (2, "note", None): ["Remember 2 h: sleep", "12:30 tea", "Snack: 1 nut"],
        (3, "text", "training"): ["3 dates", "After training: 1 banana", None],
    }
    assert R.lost_lines(frame, placed).count() == 0
    assert R.lost_lines(frame, placed.filter("part <> 'note'")).count() == 5
    texts = {r.doc_id: (r.text, r.notes) for r in R.rebuilt(placed).collect()}
    assert texts[1] == ("lunch: 100 g rice | Option b: | 2 eggs\ntraining: After training (18:30): | 1 shake\ndinner: fish", "Remember: drink much water") and texts[2][0] is None
    assert Counter(r.doc_id for r in placed.collect()) == Counter(x[0] for x in lines)


def test_extract_measure_rows(spark):
    text = "Iron 12,5 ug/dl 10 - 60\nzinc 60-10 12\nSodium 130 - 145 150\nnote 5\nHdl 9 mg/dl 10-60"
    got = extract.extract_measure_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), enough=3).orderBy("pos").collect()
    assert [(r.id, r.pos, r["name"], r.value, r.unit, r.level, r.unreliable) for r in got] == [(1, 0, "iron", 12.5, "ug/dl", 2, False), (1, 2, "sodium", 150.0, None, 3, False), (1, 4, "hdl", 9.0, "mg/dl", 1, False)]


def test_votes_move_each_shingle_once(spark):
    rows = spark.createDataFrame([(i, "xyz"[i % 3], f"s{k}") for i in range(9) for k in range(i % 3, 6)] + [(1, "y", "s5"), (30, None, "s0")], "d long, o string, s string")
    sizes = spark.createDataFrame([(i, 100) for i in range(9)], "d long, size long")
    votes = L.owned_votes(rows, doc="d", owner="o", shingle="s", least=1, sizes=sizes)
    assert {tuple(r) for r in votes.collect()} == {(i, "y", 1, 0.01) for i in (0, 3, 6)}
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("hashpartitioning(s#") == 1


def test_cross_entity_pairs_are_all_pairs_of_a_day(spark, tmp_path):
    from casework.plans.q_joins import cross_entity_pairs
    from casework.sources.tables import Tables

    rows = [(i, i % 7, "ab"[i % 2], f"1995-01-0{1 + i % 3}", 1.0) for i in range(90)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = {(a, b, oa == ob) for a, ea, oa, da, _ in rows for b, eb, ob, db, _ in rows if a < b and da == db and ea != eb}
    assert {tuple(r) for r in cross_entity_pairs(Tables(spark, str(tmp_path))).collect()} == want

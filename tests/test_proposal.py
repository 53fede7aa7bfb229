"""Whole plans against a plain loop over each query's neighbours."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from statistics import median

import pytest

from casework.operators.proposal import compose_plan, settle_loose

CEILINGS = {"g": 100.0, "pc": 6.0}
BANDS = {("a", "g"): (10.0, 40.0), ("b", "pc"): (1.0, 3.0), ("c", "g"): (20.0, 90.0)}


RULES = [("first", "a", None), ("second", "a", "X"), ("third", "b", "Y")]


def settled(rows, loose):
    """Items of the loose slot moved by the votes of the same query's cases."""
    votes = defaultdict(lambda: defaultdict(set))
    for q, c, s, f, _, _ in rows:
        if s != loose:
            votes[q, f][s].add(c)
    out = []
    for q, c, s, f, unit, quantity in rows:
        if s == loose and votes[q, f]:
            (first, slot), *rest = sorted((-len(cs), slot) for slot, cs in votes[q, f].items())
            if -first >= 2 and -first + (rest[0][0] if rest else 0) >= 2:
                s = slot
        out.append((q, c, s, f, unit, quantity))
    return out


def looped(rows, near, share, floor, penalty, required, never, step, loose, least_ratio):
    out = []
    rows = settled(rows, loose)
    queries = defaultdict(set)
    for q, c in near:
        queries[q].add(c)
    for q, cases in queries.items():
        own = [r for r in rows if r[0] == q and (r[2], r[3]) not in never]
        k = len(cases)
        in_slot, holds = defaultdict(set), defaultdict(set)
        for _, c, s, f, _, _ in own:
            in_slot[s].add(c)
            holds[s, f].add(c)
        slots = {s for s, cs in in_slot.items() if round(len(cs) / k, 6) >= share and len(cs) >= min(floor, k)}
        support = {(s, f): round(len(cs) / len(in_slot[s]), 6) for (s, f), cs in holds.items() if s in slots}
        reason, before = {}, Counter()
        for s, f in sorted(support):
            if support[s, f] >= share and len(holds[s, f]) >= min(floor, k) and support[s, f] >= share + penalty * before[f]:
                reason[s, f] = "consensus"
                before[f] += 1
        for s, f in support:
            if (s, f) not in reason and any(f == g and t in (None, s) for t, g in required):
                reason[s, f] = "required"
        for s in slots:
            need = int(median(len({r[3] for r in own if r[1] == c and r[2] == s}) for c in in_slot[s]))
            rest = sorted(((-len(holds[x]), x[1]) for x in support if x[0] == s and x not in reason and len(holds[x]) >= floor))
            short = need - sum(x[0] == s for x in reason)
            for _, f in rest[: max(0, short)]:
                reason[s, f] = "topped up"
        for s in slots:
            amounts = {}
            order = sorted((x for x in reason if x[0] == s), key=lambda x: (["consensus", "required", "topped up"].index(reason[x]), -support[x], x[1]))
            for position, x in enumerate(order, 1):
                units = defaultdict(list)
                for _, _, slot, f, unit, quantity in own:
                    if (slot, f) == x:
                        units[unit].append(quantity)
                unit = min(units, key=lambda u: (-len(units[u]), u))
                quantity, change = median(units[unit]), "kept"
                if quantity > CEILINGS[unit]:
                    change = "kept" if unit == "g" else "other unit"
                    unit, quantity = "g", quantity if quantity <= CEILINGS["g"] else None
                if quantity is None:
                    change = "unknown"
                elif (x[1], unit) in BANDS:
                    low, high = BANDS[x[1], unit]
                    if not low <= quantity <= high:
                        quantity, change = min(max(quantity, low), high), "clamped" if change == "kept" else change
                amounts[position, x] = [unit, quantity, change]
            for (position, x), (unit, quantity, change) in amounts.items():
                least = least_ratio * max((a[1] for a in amounts.values() if a[0] == unit and a[1] is not None), default=0)
                if quantity is not None and quantity < least:
                    quantity, change = least, "raised"
                if quantity is not None and quantity > step:
                    quantity = round(quantity / step) * step
                names = [n for n, f, where in RULES if f == x[1] and where in (None, s)]
                out.append((q, s, position, x[1], len(holds[x]), support[x], reason[x], unit, quantity, change, names))
    return out


@pytest.mark.parametrize(("share", "floor", "penalty"), [(0.3, 2, 0.0), (0.4, 2, 0.3), (0.6, 3, 0.1), (0.2, 1, 0.9)])
def test_compose_plan(spark, share, floor, penalty):
    rng = random.Random(share)
    near = [(q, c) for q in range(12) for c in rng.sample(range(60), rng.choice([1, 2, 5, 9]))]
    items = {c: [(rng.choice("XXYZ"), rng.choice("aabcd"), rng.choice(["g", "g", "pc"]), float(rng.choice([1, 2, 7, 12, 33, 60, 140]))) for _ in range(rng.choice([0, 2, 6]))] for c in range(60)}
    rows = [(q, c, *item) for q, c in near for item in items[c]]
    required, never = [(None, "d"), ("Y", "b")], [("X", "c")]
    got = compose_plan(
        spark.createDataFrame(rows, "query_id long, case_id long, slot string, family string, unit string, quantity double"),
        spark.createDataFrame(near, "query_id long, case_id long"),
        spark.createDataFrame([(*k, *v) for k, v in BANDS.items()], "family string, unit string, p05 double, p95 double"),
        spark.createDataFrame([*CEILINGS.items()], "unit string, ceiling double"),
        share=share, floor=floor, penalty=penalty, required=required, never=never, base_unit="g",
        loose="Z", least_ratio=0.3, rules=spark.createDataFrame(RULES, "rule string, family string, slot string"),
    )
    want = looped(rows, near, share, floor, penalty, required, never, 5.0, "Z", 0.3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len({r[6] for r in want}) > 1 and len(want) > 10


def test_a_plan_moves_by_clear_votes_only(spark):
    rows = [(1, c, "X", "a", "g", 1.0) for c in (1, 2, 3)] + [(1, 4, "Y", "a", "g", 1.0), (1, 5, "Z", "a", "g", 1.0)]
    rows += [(1, 1, "X", "b", "g", 1.0), (1, 2, "X", "b", "g", 1.0), (1, 3, "Y", "b", "g", 1.0), (1, 5, "Z", "b", "g", 1.0), (1, 5, "Z", "c", "g", 1.0), (2, 5, "Z", "a", "g", 1.0)]
    df = spark.createDataFrame(rows, "query_id long, case_id long, slot string, family string, unit string, quantity double")
    got = sorted(tuple(r) for r in settle_loose(df, "Z").filter("case_id = 5").select("query_id", "family", "slot").collect())
    assert got == [(1, "a", "X"), (1, "b", "Z"), (1, "c", "Z"), (2, "a", "Z")]
    assert settle_loose(df.limit(0), "Z").count() == 0

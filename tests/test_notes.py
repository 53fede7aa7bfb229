"""Note consensus against a plain loop over small neighbourhoods."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from casework.operators.notes import note_consensus

THEMES = [("water", r"\b(water|drink)", "Drink enough."), ("rest", "sleep|rest", "Rest well."), ("rest2", "pause", "rest  well."), ("salt", "salt", "Little salt.")]


def plain(note):
    return re.sub(r"\s+", " ", note).strip().lower()


def looped(neighbours, notes, share, floor, least):
    out = []
    by_query = defaultdict(list)
    for q, case, rank in neighbours:
        by_query[q].append((rank, case))
    for q, cases in by_query.items():
        theme, literal, text = defaultdict(set), defaultdict(set), {}
        for rank, case in sorted(cases):
            for note in sorted(x.strip(" ") for c, x in notes if c == case and x and plain(x) and not re.match("^[^a-z]*$", plain(x))):
                found = [n for n, p, _ in THEMES if re.search(p, plain(note))]
                for n in found:
                    theme[n].add((rank, case))
                if not found:
                    literal[plain(note)].add((rank, case))
                    text.setdefault(plain(note), note)
        order = lambda d: sorted(d, key=lambda n: (-len(d[n]), min(d[n])[0], n))
        rows = []
        for n in order(theme):
            words = next(c for m, _, c in THEMES if m == n)
            if len(theme[n]) >= floor and len(theme[n]) >= share * len(cases) - 1e-9 and plain(words) not in [plain(r[2]) for r in rows]:
                rows.append((q, "theme", words, len(theme[n]), min(theme[n])[0]))
        said, themes = {plain(r[2]) for r in rows}, len(rows)
        for at, n in enumerate([n for n in order(literal) if len(literal[n]) >= floor], 1):
            if (len(literal[n]) >= share * len(cases) - 1e-9 or at + themes <= least) and n not in said:
                rows.append((q, "wording", text[n], len(literal[n]), min(literal[n])[0]))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(rows, 1)]
    return out


@pytest.mark.parametrize(("share", "floor", "least"), [(0.5, 2, 0), (0.5, 2, 6), (0.0, 3, 2), (0.9, 1, 3)])
def test_note_consensus(spark, share, floor, least):
    rng = random.Random(2)
    pool = ["Drink water", "drink  WATER!", "Sleep", "a pause", "No sugar", "no  sugar ", "walk", "Walk", "salt", "12:", "", None, "rest well.", "Little fat", "bread", "fruit"]
    neighbours = [(q, case, rank) for q in range(12) for rank, case in enumerate(rng.sample(range(40), rng.choice([1, 2, 6])), 1)]
    notes = [(case, rng.choice(pool)) for case in range(35) for _ in range(rng.randint(0, 6))]
    got = note_consensus(
        spark.createDataFrame(neighbours, "query_id long, case_id long, rank int"),
        spark.createDataFrame(notes, "case_id long, note string"),
        THEMES, share=share, floor=floor, least=least, artefact="^[^a-z]*$",
    )
    assert sorted(map(tuple, got.collect())) == sorted(looped(neighbours, notes, share, floor, least))


def test_nothing_said(spark):
    none = spark.createDataFrame([], "query_id long, case_id long, rank int")
    notes = spark.createDataFrame([(1, "x")], "case_id long, note string")
    assert note_consensus(none, notes, THEMES, share=0.5).count() == 0
    assert note_consensus(spark.createDataFrame([(1, 1, 1)], none.schema), notes.limit(0), THEMES, share=0.5).count() == 0

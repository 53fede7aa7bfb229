"""Text operators with tables of words: nulls, empty texts, ties, entries without effect."""

from __future__ import annotations

import hashlib
import math

import regex
import xxhash

from casework.operators import text as X
from casework.operators.mapping import mine_catalogue


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, t string")


def rows_of(df):
    return {r.id: tuple(r)[1:] for r in df.collect()}


def test_labels_by_priority(spark):
    rules = [("b", "x", 1), ("a", "y", 5), ("a", "z", 5), ("c", "q", 1)]
    got = rows_of(X.label_by_patterns(texts(spark, "x y z", "q x", "none", None, ""), rules, key="id", text="t"))
    assert got == {0: ("a,b", "a", True, True), 1: ("b,c", "b", True, True), **{i: ("", None, False, False) for i in (2, 3, 4)}}


def test_screen_terms(spark):
    terms = spark.createDataFrame([("bad", 2), ("bad", 1), ("éh", 3), ("unused", 9)], "term string, weight long")
    got = rows_of(X.screen_terms(texts(spark, "Bad, bad\n dog!", "ÉH  badly", "fine", None, "", "bad " * 3000), terms, key="id", text="t", limit=4))
    assert got[0] == (2, "bad", 4, True, "***, ***\n dog!") and got[1] == (1, "éh", 3, False, "***  badly")
    assert set(got) == {0, 1, 5} and got[5][:3] == (3000, "bad", 6000) and got[5][4] == "*** " * 3000
    assert X.screen_terms(texts(spark, "bad"), terms.limit(0), key="id", text="t", limit=1).count() == 0


def test_hashed_hits(spark):
    digest = lambda w: hashlib.sha256(("s" + w).encode()).hexdigest()
    digests = spark.createDataFrame([(digest("ann"),), (digest("ann"),), (digest("böb"),)], "digest string")
    got = rows_of(X.hashed_hits(texts(spark, "Ann saw ann", "BÖB, Ann", "no one", None), digests, key="id", text="t", salt="s"))
    assert got == {0: (1, 2), 1: (2, 2), 2: (0, 2)}


def test_mask_unlisted(spark):
    allowed = spark.createDataFrame([("www",), ("www",), ("the",)], "word string")
    short = lambda w: hashlib.sha256(("s" + w).encode()).hexdigest()[:8]
    got = rows_of(X.mask_unlisted(texts(spark, "www.Secret/the", "", None, "1 2"), allowed, key="id", text="t", salt="s"))
    assert got == {0: (f"www {short('secret')} the", 1), 1: ("", 0), 2: ("", 0), 3: ("", 0)}
    assert {r.word: r.n for r in X.common_words(texts(spark, "a b b", "b c", None), text="t", least=2).collect()} == {"b": 2}


def test_scan_fields(spark):
    fields = spark.createDataFrame([("x", "a@b.c a@b.c"), ("x", "d@e.f"), ("x", None), ("y", "none")], "field string, text string")
    got = {(r.field, r.detector): tuple(r)[2:] for r in X.scan_fields(fields, {"mail": r"[a-z]@[a-z.]+", "num": "[0-9]+"}).collect()}
    assert got == {("x", "mail"): (2, 3, 2), ("x", "num"): (0, 0, 0), ("y", "mail"): (0, 0, 0), ("y", "num"): (0, 0, 0)}


def test_theme_wordings(spark):
    got = {r.theme: tuple(r)[1:] for r in X.theme_wordings(texts(spark, "Drink Water", "drink wine drink wine", "drink water", "rest", None), {"d": "drink [a-z]+", "r": "rest"}, key="id", text="t", least=2).collect()}
    assert got == {"d": (3, 2, "drink water", 2)}


def test_canonical_units(spark):
    spellings = spark.createDataFrame([("gram", "g", 1.0), ("kilo", "g", 1000.0)], "spelling string, unit string, times double")
    raw = spark.createDataFrame([("Grams.",), ("kilo",), ("kilo",), ("cups",), (" . ",), (None,)], "raw string")
    got = {r.raw: tuple(r)[1:] for r in X.canonical_units(raw, spellings).collect()}
    assert got == {"Grams.": ("g", 1.0, True, None, 1), "kilo": ("g", 1000.0, True, None, 2), "cups": ("cups", None, False, "unlisted", 1), " . ": ("", None, False, "empty", 1), None: ("", None, False, "empty", 1)}


def test_labels_by_signals(spark):
    signals = [("b", "x", 2), ("a", "y", 1), ("a", "z", 1)]
    df = spark.createDataFrame([(0, "x y", ""), (1, "Y z", "f"), (2, "x y z", None), (3, "none", "f"), (4, None, "f"), (5, "", "doc b"), (6, "x x x x x x", "f")], "id long, t string, file string")
    got = rows_of(X.label_by_signals(df, signals, key="id", text="t", most=3, names="file", overrides=[("^doc", "d"), ("b", "e")]))
    assert got == {0: ("b", 2), 1: ("a", 2), 2: ("ambiguous", 2), 3: ("unclassified", 0), 4: ("unclassified", 0), 5: ("d", 0), 6: ("b", 6)}
    assert rows_of(X.label_by_signals(df, [("only", "x", 1)], key="id", text="t"))[0] == ("only", 1)


def test_first_rule_with_its_reason(spark):
    got = X.first_rule(texts(spark, "ABC:", "abc:", "abc", None, ""), [("^[A-Z]", "section", "capital"), (":$", "field", "colon")], column="t").select("id", "class", "reason")
    assert rows_of(got) == {0: ("section", "capital"), 1: ("field", "colon"), 2: ("unmapped", None), 3: ("unmapped", None), 4: ("unmapped", None)}
    assert X.first_rule(texts(spark, "a"), [("a", "k", "why")], column="t").columns == ["id", "t", "class", "reason"]


def test_catalogue_is_mined(spark):
    names = ["Red Pear"] * 3 + ["red  pear"] + ["Plum"] * 3 + ["PLUM"] + ["plum jam sweet"] + ["Kiwi"] * 4 + ["kíwi"] + ["zinc pill"] * 5 + ["12 pears"] * 9 + ["x"] * 9 + ["big"] * 9 + ["", None, "rare thing"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    keys = spark.createDataFrame([("Plum",), ("plum jam",), ("pear",)], "key string")
    excluded = spark.createDataFrame([("Zinc", "zinc")], "key string, token string")
    got = {r.key: tuple(r)[1:] for r in mine_catalogue(df, keys, excluded, least_share=0.08, descriptors=("big",)).collect()}
    assert got == {
        "red pear": (4, "promoted", "red pear"), "plum": (4, "exact", "plum"), "plum jam sweet": (1, "prefix", "plum jam"), "kiwi": (5, "promoted", "kiwi"), "zinc pill": (5, "excluded", "Zinc"),
        "12 pears": (9, "unmapped", None), "x": (9, "unmapped", None), "big": (9, "descriptor_only", None), "": (1, "descriptor_only", None), "rare thing": (1, "unmapped", None),
    }
    assert mine_catalogue(df.limit(0), keys, excluded, least_share=0.1).count() == 0


def test_hashed_words_of_whole_documents(spark):
    """Every document's buckets, counted in plain Python with the same hash."""
    from casework.plans.registry import queries

    folder = "/root/testdata/sf0.001"
    want = {}
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        cells = {}
        for word in regex.split(r"[^\p{L}]+", (row.text or "").lower()):
            if word:
                h = xxhash.xxh64_intdigest(word.encode(), seed=42)
                cells[h % 64] = cells.get(h % 64, 0) + (1 if (h >> 20) % 2 == 0 else -1)
        norm = math.sqrt(sum(v * v for v in cells.values()))
        want |= {(row.doc_id, b): v / norm for b, v in cells.items() if v}
    got = {(r.doc_id, r.bucket): r.weight for r in queries()["hashing_embedding"](spark, folder).collect()}
    assert got.keys() == want.keys() and len(want) > 1000
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)

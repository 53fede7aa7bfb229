"""Lexical search, spelling variants and language-model scores on small tables, against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.llm.language_model import LEAST, MEANS, PRIORS, STEPS, Part, lm_scores, packed, region, unpacked
from casework.llm.lexical_search import lexical_search
from casework.llm.spelling import near_words, spelling_variants

ODD = [(901, None), (902, ""), (903, " \n\t "), (904, "x"), (904, "x"), (None, "x"), (None, None)]
#: Columns whose names the operators also use for themselves.
EXTRA = {"rank": 0, "score": 1.0, "word": "w", "n": 3, "terms": "t", "block": 9, "query": 1, "row": "r", "gram": 4, "part": 2}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def ranked(docs, items, k):
    """All scores, straight from their definition."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, Counter(term.findall(lower(t or "")))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    count, total, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    found = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in term.findall(lower(text or "")) if c[t])
            scores += [(-score, -1 if i is None else i)] if score else []
        found += [(item, rank, None if i < 0 else i, -score) for rank, (score, i) in enumerate(sorted(scores)[:k], 1)]
    return found


@pytest.mark.parametrize("options", [{}, {"k": 3, "block": 5, "long_share": 3}, {"k": 2, "block": 7, "long_share": 10**6, "at_once": 4}])
def test_lexical_search(spark, options):
    rng = random.Random(3)
    words = ["The", "é1", "of", *[f"w{i}" for i in range(40)]]
    pick = lambda n: rng.choice([" ", ", ", "-", "\x7f"]).join(words[min(int(rng.expovariate(0.2)), 42)] for _ in range(n))
    docs = [(rng.randrange(400), pick(rng.choice([1, 2, 9, 60]))) for _ in range(300)] + [(1000 + i, "the same text, of w1") for i in range(40)]
    docs += [*ODD, (905, "w2 " * 30_000)]
    items = [(i, pick(rng.choice([1, 3, 12]))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (53, "THE the The w1"), (None, "of w3")]
    got = lexical_search(docs_of(spark, docs).repartition(5), docs_of(spark, items).withColumnRenamed("doc_id", "item_id"), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, ranked(docs, items, options.get("k", 20))))


def test_lexical_search_of_nothing(spark):
    items = docs_of(spark, [(1, "x")]).withColumnRenamed("doc_id", "item_id")
    assert lexical_search(docs_of(spark, []), items).count() == 0
    assert lexical_search(docs_of(spark, [(1, "x")]), items.limit(0)).count() == 0


def near(a, b):
    """Exactly one character inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = sorted((a, b), key=len)[::-1]
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(counts):
    found, forms = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * n else None
        found[w] = (n, len(others), forms[w], counts.get(forms[w]))
    for w in found:
        root = w
        while forms[root]:
            root = forms[root]
        found[w] += (root,)
    return found


def test_near_words(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("aabcé") for _ in range(rng.randint(1, 6))) for _ in range(400)} | {"aaaa", "aaaaa", "aaa", "a" * 300, "a" * 301}
    counts = {w: rng.choice([2, 2, 3, 20, 30, 200, 2000, 20_000]) for w in words}
    got = {r.word: (r.n_near, r.form, r.form_n) for r in near_words(spark.createDataFrame([*counts.items()], "word string, n long")).collect()}
    want = {w: (m, form, form_n) for w, (_, m, form, form_n, _) in variants(counts).items() if m}
    assert got == want


def test_spelling_variants(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgÀÿ×") for _ in range(rng.randint(6, 10))) for _ in range(12)]
    docs = []
    for i in range(300):
        words = [rng.choice(base[:3] * 40 + base) for _ in range(30)]
        words = [w if rng.random() > 0.04 else (w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", w[k] * 2]) + w[k + 1 :]) for w in words]
        docs.append((i, "".join(rng.choice([w, w.upper() if w.isascii() else w]) + rng.choice([" ", "9", "_", "Ā", "\n"]) for w in words)))
    docs += [*ODD, (906, "longerword " * 20_000), (907, "longerwrod longerwrod lngerword lngerword")]
    docs += [(910, "chaining " * 3000), (911, "chainings " * 250), (912, "chainingss " * 20)]
    counts = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    got = spelling_variants(docs_of(spark, docs).repartition(6))
    rows = got.collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows} == want and len(rows) == len(want)
    assert sum(x[2] is not None for x in want.values()) > 20 and any(x[4] != x[2] for x in want.values() if x[2])
    assert spelling_variants(docs_of(spark, [])).count() == 0


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    counts = np.minimum(2 + rng.geometric(0.3, len(keys)) ** 4, 2**40)
    words = int(-(-(np.searchsorted(STEPS, counts, side="right") - 1).sum() * 12 // 64))
    part = Part(2, 1, 0, words, region(keys, counts, 2, words))
    true = np.searchsorted(STEPS, counts, side="right")
    assert (part.levels(keys) >= true).all() and (part.levels(keys) == true).mean() > 0.97
    assert (part.levels(rng.integers(0, 2**64, 50_000, dtype=np.uint64)) > 0).mean() < 0.03
    assert all(x <= MEANS[i + 1] for i, x in enumerate(STEPS))


def counted(docs, learned):
    """The token lists of the texts, the n-grams that count, and how many tokens and different ones there are."""
    sents = {i: ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), "</s>"] for i, t in docs}
    grams = Counter(tuple(s[k - n + 1 : k + 1]) for i in learned for s in [sents[i]] for n in (1, 2, 3) for k in range(1, len(s)) if k - n + 1 >= 0)
    grams = {g: c for g, c in grams.items() if c >= LEAST[len(g)]}
    return sents, grams, sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)


def text_logs(sents, grams, total, different, learned, prior, own=0):
    """The log10 probability of each text from exact counts, quantised one by one."""

    def c(gram):
        if gram == ("<s>",):
            return max(len(learned) - own, 0)
        n = grams.get(gram, 0)
        return max(MEANS[sum(s <= n for s in STEPS.tolist())] - own, 0) if n else 0

    def pair_count(v, w):
        return min(c((v, w)), c((w,)), c((v,)))

    out = {}
    for i, s in sents.items():
        log = 0.0
        for k in range(1, len(s)):
            w, v = s[k], s[k - 1]
            p = (pair_count(v, w) + prior[0] * (c((w,)) + 0.1) / max(total + 0.1 * (different + 1) - own, 0.1)) / (c((v,)) + prior[0])
            if k > 1:
                uv = pair_count(s[k - 2], v)
                p = (min(c((s[k - 2], v, w)), pair_count(v, w), uv) + prior[1] * p) / (uv + prior[1])
            log += math.log10(p)
        out[i] = log
    base = {i: (len(s) - 1, sum((w,) in grams for w in s[1:]), sum(math.log10((grams.get((w,), 0) + 0.1) / (total + 0.1 * (different + 1))) for w in s[1:])) for i, s in sents.items()}
    return out, base, total


def test_lm_scores(spark):
    rng = random.Random(8)
    after = {i: rng.sample(range(60), 3) for i in range(60)}
    docs = []
    for i in range(200):
        w, words = rng.randrange(60), []
        for _ in range(rng.choice([1, 5, 40])):
            words.append(f"w{w}" if rng.random() < 0.97 else f"New{i}")
            w = rng.choice(after[w])
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    docs += [(201, None), (202, ""), (203, " \n\t "), (204, "W1 " * 5000), (205, docs[7][1])]
    learn = {i for i, _ in docs if i % 5}
    tune = {i for i in learn if i % 3 == 1}
    sents, *counts = counted(docs, learn)
    tuned = {i: sents[i] for i in tune}
    best = max(PRIORS, key=lambda p: sum(text_logs(tuned, *counts, learn, p, own=1)[0].values()))
    want, base, total = text_logs(sents, *counts, learn, best)
    table = docs_of(spark, docs).repartition(4)
    options = {"learn": F.col("doc_id") % 5 != 0, "tune": F.col("doc_id") % 3 == 1}
    got = {r.doc_id: r for r in lm_scores(table, **options).collect()}
    assert len(got) == len(docs)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 0, *base[i][:2], total)
        assert r.base_score == pytest.approx(base[i][2])
    assert sum(abs(got[i].score - want[i]) <= 0.02 * abs(want[i]) for i in want) > 0.9 * len(want)
    unseen = [r for r in got.values() if r.held_out and r.n_tokens > 30]
    assert all(r.score > r.base_score for r in unseen) and len(unseen) > 5
    parted = {r.doc_id: r for r in lm_scores(table, most_bytes=200, **options).collect()}
    assert {i: round(r.score, 9) for i, r in parted.items()} == {i: round(r.score, 9) for i, r in got.items()}


def test_what_occurs_once_is_learned(spark):
    """Pairs and triples of one occurrence are in the model: a learned order of words is likelier than another one."""
    docs = [(i, f"u{i} v{i} w{i} x{i}") for i in range(40)] + [(100, "u3 v3 w3 x3"), (101, "x3 v3 u3 w3")]
    got = {r.doc_id: r.score for r in lm_scores(docs_of(spark, docs), learn=F.col("doc_id") < 40, tune=F.col("doc_id") < 10).collect()}
    assert got[100] > got[101] + 0.5


def test_packed_keys():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64))
    assert (unpacked(packed(keys)) == keys).all() and unpacked(packed(keys[:0])).tolist() == []


def test_lm_scores_of_odd_rows(spark):
    options = {"learn": F.col("doc_id") % 2 == 0, "tune": F.col("doc_id") % 4 == 0}
    got = lm_scores(docs_of(spark, ODD), **options).collect()
    assert len(got) == len(ODD) and all(r.held_out for r in got if r.doc_id is None) and all(r.score <= 0 for r in got)
    assert {(r.score, r.base_score, r.train_tokens) for r in lm_scores(docs_of(spark, ODD), learn=F.lit(False), tune=F.lit(True)).collect()} == {(0.0, 0.0, 0)}
    assert lm_scores(docs_of(spark, []), **options).count() == 0


def test_lm_scores_keep_the_model_off_the_driver(spark, monkeypatch):
    """Counts are asked for where they are added up: nothing is broadcast, however much is learned. Ids stay whole beside null ones."""

    def refuse(*args):
        raise AssertionError("the model went through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    docs = [(2**62 + i, f"u{i % 7} v{i % 5} w{i}") for i in range(60)] + [(None, "u1 v1 w1")]
    options = {"learn": F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False)), "tune": F.col("doc_id") % 3 == 1}
    got = lm_scores(docs_of(spark, docs).coalesce(1), **options).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(i) for i, _ in docs)

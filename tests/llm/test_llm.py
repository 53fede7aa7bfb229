"""The text-preparation operators on small tables, against brute force or exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.llm import packing, token_counts, url_filter
from casework.llm.components import connected_components
from casework.llm.embedding_dedup import embedding_dedup
from casework.llm.exact_dedup import exact_dedup
from casework.llm.licences import KNOWN, known_digests, licence_scan
from casework.llm.line_dedup import line_decisions, line_dedup
from casework.llm.mixing import mix_sources
from casework.llm.near_dedup import common_cells, near_dedup
from casework.llm.quality import held_out, quality_scores, with_quality
from casework.llm.wordhash import word_hashes

WORDS = [a + b + c for a in "btkmsr" for b in "aeiou" for c in "lnrstx"]
#: Columns whose names operators also use for themselves.
EXTRA = {"keep_id": 1, "score": 2.0, "component_id": "c", "size": "s", "digest": "d", "rank": 0, "level": 3}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()}) if extra else df


ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "x", "b"), (4, "x", "b"), (None, "x", "b"), (None, None, None)]


def components(links):
    """The smallest node that each linked node reaches, by walking breadth-first over the neighbours."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    least = {}
    for start in sorted(near):
        wave = {start} - least.keys()
        while wave:
            least.update(dict.fromkeys(wave, start))
            wave = set().union(*(near[x] for x in wave)) - least.keys()
    return least


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(shape)
    links = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(500, i) for i in range(100)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
        "none": [],
    }[shape]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components([(a, b) for a, b in links if a != b])


def test_exact_dedup(spark):
    rng = random.Random(1)
    base = [prose(rng, 5) for _ in range(20)]
    rows = [(i, rng.choice(base), "a") for i in range(200)] + ODD
    got = exact_dedup(docs_of(spark, rows, extra=True)).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup(docs_of(spark, [])).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_the_tokenizer(tokenizer):
    words, rng = packing.WordIds(tokenizer), random.Random(3)
    odd = ["don't <|endoftext|> can'T!!'s", "a<|b <|startoftext|>x", "\x01 y\x7f", "É́ İstanbul ﬁne", "x'S 'LL12'd3", "ǅ ß ẞ Σας", "", "日本 語", "½² x1y", "´à- Ñandú×"]
    odd += ["".join(rng.choice("aZ'st.!é12 ß-<|>\n") for _ in range(40)) for _ in range(200)]
    for text in odd:
        assert np.frombuffer(words.of_text(text), "<u4").tolist() == words._tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark, tokenizer):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 40, 60])), "a") for i in range(120)] + ODD + [(900, prose(rng, 700), "a")]
    got = packing.pack_documents(docs_of(spark, rows, extra=True), tokenizer=tokenizer, length=128).collect()
    ids = packing.WordIds(tokenizer)
    want = Counter()
    for i, t, _ in rows:
        tokens = ids.of_text(t or "") + b"\0\0\0\0"
        for n, at in enumerate(range(0, len(tokens), 512)):
            want[(i, n, at // 4, len(tokens[at : at + 512]) // 4, zlib.crc32(tokens[at : at + 512]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / 128 * 1.03) + 1
    assert packing.pack_documents(docs_of(spark, []), tokenizer=tokenizer).count() == 0


def test_best_two_fit_beats_greedy_where_two_fit_better():
    bins, offsets = packing.best_two_fit(np.array([60, 30, 25, 15, 70]), 100)
    assert len(set(bins.tolist())) == 2 and offsets.min() == 0


def test_quality(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) if i % 3 else prose(rng, 30).upper().replace(" ", "!! "), "a") for i in range(400)]
    docs = docs_of(spark, rows + ODD, extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400)] + [(None, 1), (7, None), (7, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept_out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id > 4]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in kept_out)
    right = [r.predicted == int(r.doc_id % 3 > 0) for r in kept_out]
    assert sum(right) >= 0.95 * len(right)
    flipped = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_scores(docs, flipped).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert with_quality(docs, labels).drop("score", "predicted").columns == [c for c in docs.columns if c != "score"]
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs_of(spark, []), labels).count() == 0


def test_line_dedup(spark):
    rng = random.Random(6)
    lines = [prose(rng, 24) for _ in range(60)]
    near = [re.sub(r"^\w+", "changed", line) for line in lines[:20]]
    rows = [(i + 100, "\n".join(rng.sample(lines + near + ["", "short"], 6)), "a") for i in range(60)] + ODD
    docs = docs_of(spark, rows, extra=True)
    first, sets = {}, {}
    occurrences = []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\v\f\r").lower()
            if line:
                occurrences.append((i, p, line))
                first.setdefault(line, (i, p))
                sets[line] = frozenset(every_run(line))
    names = sorted(sets)
    links = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) >= 15
    root = components(links)
    best = {}
    for line in names:
        best[root.get(line, line)] = min(best.get(root.get(line, line), first[line]), first[line], key=lambda f: (f[0] is not None, f[0] or 0, f[1]))
    want = defaultdict(set)
    for i, p, line in occurrences:
        if best[root.get(line, line)] != (i, p):
            want[i].add(p)
    got = {r.doc_id: set(r.dropped) for r in line_decisions(docs).collect()}
    assert got == dict(want)
    out = line_dedup(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None and r.doc_id != 4}
    source = {i: t for i, t, _ in rows}
    for i, t in texts.items():
        assert t == (source[i] if not want.get(i) else "\n".join(x for p, x in enumerate(source[i].split("\n")) if p not in want[i]))
    assert line_dedup(docs_of(spark, [])).count() == 0


def every_run(line):
    line = line.strip(" \t\v\f\r").lower()
    return {line[k : k + 12] for k in range(len(line) - 11)} or {line}


def dropped_by_brute_force(lines, shingles):
    sets = [shingles(x) for x in lines]
    links = [(a, b) for b in range(len(lines)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return {i for i, root in components(links).items() if i != root}


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    rows = [(1, "shared line that stands in several rows", "a"), (4, "totally unique first line\nshared line that stands in several rows", "a"), (4, "shared line that stands in several rows", "a")]
    rows += [(None, "shared line that stands in several rows\nx", "a"), (None, "unique words stay here please\nx", "a"), (None, None, "a")]
    out = Counter((r.doc_id, r.text) for r in line_dedup(docs_of(spark, rows, extra=True)).collect())
    kept = [line for (_, t), n in out.items() for line in (t or "").split("\n") for _ in range(n) if line]
    assert sorted(kept) == sorted(["shared line that stands in several rows", "totally unique first line", "unique words stay here please", "x"])


def test_a_very_long_line_is_read_to_its_end(spark):
    rng = random.Random(63)
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    rows = [(1, long, "a"), (2, long[:-1] + "Z", "a"), (3, long[:100_000] + long[:100_000][::-1], "a"), (4, "=" * 300, "a"), (5, "=" * 400 + "-", "a"), (6, "=" * 500, "a")]
    want = dropped_by_brute_force([t for _, t, _ in rows], every_run)
    assert {r.doc_id for r in line_decisions(docs_of(spark, rows)).collect()} == {i + 1 for i in want}


def test_lines_without_spaces_are_read_to_their_end(spark):
    rng = random.Random(60)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(80))
    lines = ["https://www.a.com/1", "https://www.b.org/2", "ref 2024000000001234", "ref 2024000000005678", han, han[:60] + han[:20], han[:79] + "x"]
    lines += ["".join(rng.choice("abcdef0123456789") for _ in range(64)) for _ in range(5)]
    lines += ["deadbeef0123" + x for x in lines[7:]] + [x + "0" for x in lines[7:9]] + ["\U0001f600" * 3 + "".join(map(str, range(30)))]
    want = dropped_by_brute_force(lines, every_run)
    assert 6 in want and not want & {1, 3, 5}
    assert {r.doc_id for r in line_decisions(docs_of(spark, [(i, x, "a") for i, x in enumerate(lines)])).collect()} == want


def test_alike_lines_of_a_crowd_meet_whoever_leads_it(spark):
    """Lines of sixteen parts, each one of three wordings: no shingle is rare, few lines are alike, and most are led by others."""
    rng = random.Random(64)
    parts = [[prose(rng, 5) for _ in range(3)] for _ in range(16)]
    chosen = [[rng.randrange(3) for _ in parts] for _ in range(900)]
    for i in rng.sample(range(900), 80):
        k = rng.randrange(16)
        chosen.append([*chosen[i][:k], (chosen[i][k] + 1) % 3, *chosen[i][k + 1 :]])
    lines = [" ".join(p[c] for p, c in zip(parts, own, strict=True)) for own in chosen]
    sets, own = [every_run(x) for x in lines], np.array(chosen)
    close = [(a, b) for b in range(len(lines)) for a in np.flatnonzero((own[:b] == own[b]).sum(axis=1) >= 12).tolist()]
    links = [(a, b) for a, b in close if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {i for i, root in components(links).items() if i != root}
    assert len(want) >= 60
    assert {r.doc_id for r in line_decisions(docs_of(spark, [(i, x, "a") for i, x in enumerate(lines)])).collect()} == want


def test_lines_of_one_template_all_meet(spark):
    rng = random.Random(62)
    template = prose(rng, 24)
    lines = [f"{template} {prose(rng, 5)}" for _ in range(120)]
    lines += [x[:-2] + "zq" for x in rng.sample(lines, 30)]
    want = dropped_by_brute_force(lines, every_run)
    assert 30 <= len(want) <= 60
    assert {r.doc_id for r in line_decisions(docs_of(spark, [(i, x, "a") for i, x in enumerate(lines)])).collect()} == want


def test_a_word_hash_depends_on_that_word_alone():
    long = ["z" * 70_000, "z" * 65_536 + "y" + "z" * 4_463, "z" * 131_000, "z" * 70_000]
    alone = [word_hashes([w])[0][0] for w in ["the", "quick", "brown", "fox", *long]]
    beside, counts = word_hashes(["the quick brown fox", " " * 70_000 + " ".join(long)])
    assert beside.tolist() == alone and counts.tolist() == [4, 4]
    assert len(set(alone)) == 7


def test_copies_beside_a_long_word_are_near(spark):
    words = prose(random.Random(61), 300)
    rows = [(1, words, "a"), (2, words, "a"), (3, "z" * 70_000, "a"), (4, words + " end", "a")]
    docs = docs_of(spark, rows[:1]).union(docs_of(spark, rows[1:3]).coalesce(1)).union(docs_of(spark, rows[3:]))
    assert {r.doc_id: r.component_id for r in near_dedup(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_near_dedup(spark):
    rng = random.Random(7)
    rows = []
    for g in range(30):
        words = prose(rng, 120).split()
        for k in range(rng.choice([1, 2, 3])):
            copy = list(words)
            if k:
                copy[rng.randrange(120)] = "edited"
            rows.append((len(rows) + 10, " ".join(copy).upper() if k == 2 else " ".join(copy), "a"))
    base = prose(rng, 60).split()  # copies that are like the base but not like each other
    for k in range(25):
        copy = list(base)
        copy[2 * k], copy[(2 * k + 31) % 60] = "one", "two"
        rows.append((len(rows) + 10, " ".join(copy), "b"))
    rows.append((9, " ".join(base), "b"))
    rows += ODD + [(5000, "x", "c"), (5001, "a b", "c"), (5002, "A\tB", "c"), (5003, "a b c", "c")]
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(links)
    got = near_dedup(docs_of(spark, rows, extra=True), size=4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == (len(sets[r.doc_id]) if r.doc_id is not None else r.n_shingles)
        assert r.component_id == (None if r.doc_id is None else root.get(r.doc_id, r.doc_id))
        assert r.kept == (r.doc_id == r.component_id)
    assert near_dedup(docs_of(spark, [])).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 16))
    vectors = [base[k % 60] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.12]) for k in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [math.inf] * 16), (1006, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "n_links": F.lit("x"), "rep": F.lit(2)})
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.95
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(close), strict=True) if a < b]
    root = components(links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(df, bucket=16).collect()}
    for i, _ in rows:
        assert got[i] == (close[i].sum() - 1, root.get(i, i), root.get(i, i) == i)
    for i, _ in bad:
        assert got[i][:2] == (0, i)
    assert embedding_dedup(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([1, 10, 100, 300])), rng.choice(["a", "b", "c", "hot", "hot", "hot", None])) for i in range(3000)] + ODD
    docs = docs_of(spark, rows, extra=True)
    got = mix_sources(docs, block=16).collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, mix_sources(docs.repartition(7), block=16).collect()))
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken == r.copies * r.size <= 2 * r.size
    for parts in by.values():
        assert abs(sum(r.taken for r in parts) - parts[0].target) <= max(r.size for r in parts)
    assert sum(p[0].target for p in by.values()) == pytest.approx(1.5 * total)
    assert all(p[0].target <= 2 * sum(r.size for r in p) + 1e-6 for p in by.values())
    assert mix_sources(docs_of(spark, [])).count() == 0
    assert {r.taken for r in mix_sources(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8")]


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://A.Example.COM/en/7x?q#f", "https://example.com/en/1", "http://xexample.com/en/7", "x://net/de/", "http://example.net/de/8", "http://bad.org/a/?utm_source=x", "https://www.BAD.org/a#top", "http://bad.org/b", "http://h?x=/en/", "a://b://c/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "block": F.lit(2)})
    listed = spark.createDataFrame([("http://bad.org/a",), (None,), ("http://bad.org/a",), ("no url",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, listed, RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[4][2:] == ("com/en/", "block") and got[5][2:] == ("com/en/", "block")
    assert got[6][2:] == ("net/de/", "allow") and got[7][2:] == ("example.net/de/8", "block")
    assert got[8][2:] == got[9][2:] == (None, "block") and got[10][2:] == (None, "allow")
    assert got[11][:2] == ("h", "") and got[12][:2] == ("b:", "//c/")
    assert url_filter.url_verdicts(pages.limit(0), listed, RULES).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(pages.filter("page_id > 7"), listed.limit(0), RULES).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    possible, clean = url_filter.possible_and_clean(spark.range(30000).select(F.concat(F.lit("k"), "id").alias("canonical")), keys, key="canonical")
    assert possible.join(keys, "canonical", "left_semi").count() == 3000
    assert clean.count() > 26000
    assert url_filter.filter_blocks(10**12, 12, 1 << 18) == 1 << 18


def test_licences(spark):
    mit = KNOWN[0][1]
    spelt = "Copyright (c) 2001 Some One\n" + mit.replace("sublicense", "sub-license").replace("Software", "SOFTWARE").replace(" ", "  ")
    rows = [(1, spelt, "a"), (2, "Text before.\nReleased  under the MIT Licence!\nafter", "a"), (3, mit + " more", "a"), (4, "Intro\n\n" + mit + "\n\nLicensed under CC BY 4.0", "a"), (5, "This is not licensed", "b")]
    got = {r.doc_id: (r.licences, r.whole) for r in licence_scan(docs_of(spark, rows, extra=True), known_digests(spark)).collect()}
    assert got[1] == (["MIT"], True) and got[2] == (["MIT"], False) and got[5] == ([], False)
    assert got[3] == ([], False) and got[4][0] == ["CC-BY-4.0", "MIT"]
    assert licence_scan(docs_of(spark, ODD), known_digests(spark)).filter("n_units > 0").count() == 0
    assert licence_scan(docs_of(spark, rows), known_digests(spark, [])).filter("n_units > 0").count() == 0


def test_a_body_line_that_begins_with_copyright_stays(spark):
    by_name = {name: text for name, text in reversed(KNOWN)}
    isc = by_name["ISC"].replace("above copyright notice", "above\ncopyright notice")
    mit = by_name["MIT"].replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS")
    rows = [(1, isc, "a"), (2, "Copyright (c) 2001-2004, Some One <a@b.c>\n\n" + mit, "a"), (3, "(c) Some One\n© Other\n * COPYRIGHT The Third\n" + mit, "a")]
    rows += [(4, "(c) You must keep, in the source form of any work, this\n" + mit, "a"), (5, isc.replace("copyright notice", "notice"), "a")]
    assert isc.count("\ncopyright") == 1 and mit.count("\nCOPYRIGHT") == 1
    got = {r.doc_id: (r.licences, r.whole) for r in licence_scan(docs_of(spark, rows), known_digests(spark)).collect()}
    assert got == {1: (["ISC"], True), 2: (["MIT"], True), 3: (["MIT"], True), 4: ([], False), 5: ([], False)}


def plain_licence(text):
    """The canonical form said again without the operator's expressions."""
    lines = [x for x in text.split("\n") if not re.match(r"\W*copyright \(c\) \d", x, re.I)]
    bare = re.sub(r"[\W_]+", "", "\n".join(lines).lower())
    for a, b in [("licence", "license"), ("copyrightowner", "copyrightholder"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("version30", "version3"), ("v20", "version20")]:
        bare = bare.replace(a, b)
    return bare


def test_licences_against_every_run_of_paragraphs(spark):
    rng = random.Random(64)
    known = {plain_licence(t): n for n, t in KNOWN}
    rows = []
    for i in range(60):
        parts = [prose(rng, 8) for _ in range(rng.randrange(4))] + [rng.choice(KNOWN)[1].replace("License", rng.choice(["License", "Licence"])) for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        text = "\n\n".join(p if rng.random() < 0.6 else p.replace(", ", ",\n") for p in parts)
        rows.append((i, text if rng.random() < 0.7 else "Copyright (c) 1999 X\n" + text, "a"))
    want = {}
    for i, t, _ in rows:
        paras = [p for p in re.split(r"\n[^\S\n]*\n", t) if plain_licence(p)]
        units = {plain_licence("\n".join(paras[k:m])) for k in range(len(paras)) for m in range(k + 1, len(paras) + 1)} | {plain_licence(x) for x in t.split("\n")} | {plain_licence(t)}
        want[i] = (sorted({known[u] for u in units if u in known}), plain_licence(t) in known)
    got = {r.doc_id: (r.licences, r.whole) for r in licence_scan(docs_of(spark, rows, extra=True), known_digests(spark)).collect()}
    assert got == want and sum(bool(x) for x, _ in want.values()) > 20
    assert licence_scan(docs_of(spark, []), known_digests(spark)).count() == 0


@pytest.fixture(scope="module")
def bytes_vocabulary():
    import public_tokenizers

    return {"ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def test_edited_trees_equal_a_full_count(bytes_vocabulary):
    counts, rng = token_counts.PretokenCounts(bytes_vocabulary["ranks"], bytes_vocabulary["pattern"]), random.Random(11)
    full = counts._encoding.encode_ordinary
    for _ in range(60):
        text = "".join(rng.choice(["the ", "a", "  ", "\n", "'s", "é", "12", "x" * 9, ". ", "don't"]) for _ in range(rng.choice([0, 1, 5, 400])))
        tree = token_counts.TokenTree.of_text(text, counts)
        for _ in range(8):
            start = rng.randint(0, len(text))
            stop = min(len(text), start + rng.choice([0, 1, 3, 50]))
            new = rng.choice(["", " ", "'", "re", "word " * 3, "\t\n", "z" * 40, "many words here " * 60])
            text, _ = tree.edit(text, start, stop, new, counts)
            assert tree.totals == (len(text), len(counts.pattern.findall(text)), len(full(text)))


@pytest.mark.parametrize("before", [' a' * 63 + "'rx tail", " a" * 63 + "   \n  x tail", " a" * 62 + " b'  \t y"])
def test_edits_at_every_place_around_a_leaf_border(bytes_vocabulary, before):
    counts = token_counts.PretokenCounts(bytes_vocabulary["ranks"], bytes_vocabulary["pattern"])
    full = counts._encoding.encode_ordinary
    for start in range(110, len(before) + 1):
        for stop, new in [(start, "e"), (start, " "), (start, "'"), (start, "\n"), (start + 1, "e"), (start + 1, " "), (start + 2, ""), (start + 4, "ve")]:
            tree = token_counts.TokenTree.of_text(before, counts)
            text, _ = tree.edit(before, start, min(stop, len(before)), new, counts)
            assert tree.totals == (len(text), len(counts.pattern.findall(text)), len(full(text))), (start, stop, new)


def test_token_counts(spark, bytes_vocabulary):
    rows = [(11, "mail a.b@c.org or 10.0.0.1, call +1 (743) 555-3824 now", "a"), (12, "nothing to hide", "a"), *ODD]
    got = token_counts.redacted_token_counts(docs_of(spark, rows, extra=True), **bytes_vocabulary).collect()
    full = token_counts.PretokenCounts(**{"ranks_path": bytes_vocabulary["ranks"], "pattern": bytes_vocabulary["pattern"]})._encoding.encode_ordinary
    by = {r.doc_id: r for r in got if r.doc_id in (11, 12)}
    assert (by[11].n_edits, by[11].n_tokens) == (3, len(full("mail <email> or <ip>, call <phone> now")))
    assert (by[12].n_edits, by[12].n_tokens, by[12].reencoded) == (0, len(full(rows[1][1])), 0)
    assert len(got) == len(rows) and all(r.n_before == r.n_tokens for r in got if r.doc_id != 11)
    assert token_counts.redacted_token_counts(docs_of(spark, []), **bytes_vocabulary).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name in ("quality_classifier", "line_dedup", "near_dedup"):
            assert 0 < docs.count() <= before
            before = docs.count()
    words = docs.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.filter("piece = 0").count() == docs.count() and packed.agg(F.sum("length")).first()[0] >= words
    with_odd = docs_of(spark, ODD, extra=True).withColumns({c: F.lit(1) for c in ("row", "kept_id", "m_copies", "m_id", "m_size", "m_source", "copies", "number", "before", "words", "turn", "of", "id")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, with_odd, folder).count() >= 0, name
        assert stage(spark, with_odd.limit(0), folder).count() == 0, name


def test_a_few_pairs_in_a_crowd_are_found(spark):
    """Hundreds of edits of one template that are too far from each other, of edits that many share, and twelve pairs among them."""
    rng = random.Random(71)
    template, spots = prose(rng, 90).split(), range(4, 89, 5)
    apart = lambda x, others, least: all((x ^ y).bit_count() >= least for y in others)
    codes, twins = [], []
    while len(codes) < 600:
        if apart(x := rng.getrandbits(17), codes, 3):
            codes.append(x)
    while len(twins) < 12:
        of = rng.randrange(600)
        x = codes[of] ^ (1 << rng.randrange(17))
        if of not in [o for o, _ in twins] and apart(x, [c for c in codes if c != codes[of]] + [t for _, t in twins], 3):
            twins.append((of, x))
    numbers = rng.sample(range(10_000), 612)
    rows = []
    for number, code in zip(numbers, codes + [t for _, t in twins], strict=True):
        words = list(template)
        for k, at in enumerate(spots):
            words[at] = f"{'yes' if code >> k & 1 else 'no'}{k}"
        rows.append((number, " ".join(words), "a"))
    want = {i: i for i in numbers}
    for k, (of, _) in enumerate(twins):
        pair = numbers[600 + k], numbers[of]
        want[max(pair)] = min(pair)
    # Trees of one value: any two alike texts share a region, together with many that are not.
    got = near_dedup(docs_of(spark, rows), size=4, depth=1, least=1, near=1).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_common_cells():
    rng = np.random.default_rng(4)
    one, two = ([np.unique(rng.integers(0, 9000, n)) for n in rng.integers(0, 6000, 20)] for _ in range(2))
    assert common_cells(one, two).tolist() == [[len(np.intersect1d(x, y)) for y in two] for x in one]
    assert common_cells([np.zeros(0, np.int64)], two).sum() == 0

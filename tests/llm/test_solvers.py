"""The classifier's solver and the rounding of the mix against plain Python."""

from __future__ import annotations

import math
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from casework.llm.mixing import mix_sources
from casework.llm.quality import BITS, _dual_descent, _ratios


def _primal(w, b, grams, values, y, cost):
    margins = np.array([w[g] @ v + b for g, v in zip(grams, values, strict=True)])
    return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * margins)).sum()


@pytest.mark.parametrize("rows", [3, 12, 40])
def test_dual_descent_reaches_the_optimum(rows):
    rng = np.random.default_rng(rows)
    grams = [np.unique(rng.integers(0, 30, rng.integers(1, 9))).astype(np.int32) for _ in range(rows)]
    values = [rng.normal(size=len(g)) for g in grams]
    y = np.where(np.arange(rows) % 3 == 0, 1, -1)
    cost = rng.uniform(0.2, 2.0, rows)
    w, b = _dual_descent(grams, values, y, cost, 400, 1)
    # Projected gradient on the dual with the whole Gram matrix, the bias being a constant feature.
    x = np.zeros((rows, 31))
    for i, (g, v) in enumerate(zip(grams, values, strict=True)):
        x[i, g] = v
    x[:, 30] = 1
    signed = x * y[:, None]
    alpha, step = np.zeros(rows), 1 / np.linalg.norm(signed @ signed.T, 2)
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - signed @ (signed.T @ alpha)), 0, cost)
    dual = alpha.sum() - 0.5 * np.sum((signed.T @ alpha) ** 2)
    assert _primal(w, b, grams, values, y, cost) == pytest.approx(dual, rel=2e-3, abs=1e-6)


def test_log_count_ratios():
    grams = [np.array(g, np.int32) for g in ([1, 2, 5], [2], [2, 7], [5, 7], [1])]
    y = np.array([1, 1, -1, -1, -1])
    got = _ratios(grams, y)
    for bucket in (0, 1, 2, 5, 7):
        p, q = (1 + sum(bucket in g for g, s in zip(grams, y, strict=True) if s == sign) for sign in (1, -1))
        assert got[bucket] == pytest.approx(math.log((p / 3) / (q / 4)))
    assert len(got) == 1 << BITS


def _hashed(*parts):
    """The 64-bit hash of a row of values, one after the other: int of 4 bytes, long of 8, double by its bits."""
    h = 42
    for kind, value in parts:
        h = xxhash.xxh64_intdigest(struct.pack("<" + kind, value), seed=h)
    return h - (1 << 64) if h >> 63 else h


def _draw(*parts):
    return (_hashed(*parts) % (1 << 53)) / float(1 << 53)


def _fold(units, seed, level, settled):
    """Pivotal rounding of (mass, id, size, p), from large to small; what is left fractional."""
    mass, key, size, p = units[0]
    for m, k, s, q in units[1:]:
        up, down = min(mass * (1 - p), m * q), min(mass * p, m * (1 - q))
        rises = up + down == 0 or _draw(("i", seed), ("i", level), ("q", key), ("d", mass), ("q", k), ("d", m)) * (up + down) < down
        ends = mass * (1 - p) <= m * q if rises else mass * p <= m * (1 - q)
        left_a, left_b = (p + up / mass, q - up / m) if rises else (p - down / mass, q + down / m)
        if ends:
            settled[key, size] = int(rises)
            mass, key, size, p = m, k, s, min(1.0, max(0.0, left_b))
        else:
            settled[k, s] = int(not rises)
            p = min(1.0, max(0.0, left_a))
    return mass, key, size, p


def _mixed(docs, weights, share, cap, seed, block):
    """Copies by (source, id, size), straight from the rules."""
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in docs]
    total, count = defaultdict(int), defaultdict(int)
    for _, s, n in sizes:
        total[s] += n
        count[s] += 1
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full = set()
    while True:  # sources that are full give the rest back, until none is above
        rest = share * sum(total.values()) - sum(cap * total[s] for s in full)
        heavy = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / heavy > cap * total[s] + 1e-9}
        if not over:
            break
        full |= over
    target = {s: cap * total[s] if s in full else rest * weight[s] / heavy for s in order}
    copies = {}
    for s in order:
        rate = cap if s in full else target[s] / total[s] if total[s] else cap
        own = [(i, n) for i, source, n in sizes if source == s]
        extra = {}
        if rate != math.floor(rate):
            units = [(float(n * own.count((i, n))), i, n, rate - math.floor(rate)) for i, n in set(own) if n]
            level = 0
            while units:
                parts = max(1, math.ceil(count[s] / float(block ** (level + 1))))
                groups = defaultdict(list)
                for u in units:
                    groups[_hashed(("i", seed + level), ("q", u[1]), ("q", u[2])) % parts].append(u)
                units = [_fold(sorted(g, reverse=True), seed, level, extra) for g in groups.values()]
                if max(1, math.ceil(max(count.values()) / block)) <= block**level:
                    break
                level += 1
            for _, i, n, p in units:
                extra[i, n] = int(_draw(("i", seed), ("i", -1), ("q", i)) < p)
        for i, n in own:
            copies[s, i, n] = (math.floor(rate) + extra.get((i, n), 0)) if n else 0
    return copies, target


def test_mix_against_plain_rounding(spark):
    rng = random.Random(12)
    docs = [(i, " ".join("w" * 3 for _ in range(rng.choice([0, 1, 3, 10, 200]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)]
    docs += [(500, "x y z", "a"), (500, "x y z", "a"), (501, None, "b"), (502, "q " * 4000, "c"), (503, "one", "d")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix_sources(frame, block=4).collect()
    copies, target = _mixed(docs, (3, 1, 2), 1.5, 2.0, 20240501, 4)
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in target.items()}
    assert {(r.source, r.doc_id, r.size): r.copies for r in got} == copies
    assert len({r.copies for r in got}) > 1

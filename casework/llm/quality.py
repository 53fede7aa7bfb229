"""Quality classifier: Naive Bayes support vectors over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import plain_text
from casework.llm.wordhash import chunks, mixed, word_hashes

BITS = 18


def _grams(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the distinct buckets of its words, word pairs, word shapes and word endings."""
    for low, high in chunks(texts):
        part = texts[low:high]
        words, counts = word_hashes(part)
        after = np.cumsum(counts)
        for text, start, stop in zip(part, after - counts, after, strict=True):
            own = words[start:stop]
            pairs = mixed(own[:-1] * np.uint64(3) + own[1:])
            marks = mixed(np.unique(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)).astype(np.uint64) + np.uint64(1 << 40))
            yield np.unique(np.concatenate((own, pairs, marks, _shape(text, len(own)))) >> np.uint64(64 - BITS)).astype(np.int32)


def _shape(text: str, words: int) -> np.ndarray:
    """Buckets of how the text is made: shares of upper case, of marks and of line ends, in steps; its length in steps."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    upper = ((data >= 65) & (data <= 90)).mean()
    marks = ((data > 32) & (data < 48) | (data > 57) & (data < 65) | (data > 90) & (data < 97) | (data > 122) & (data < 127)).mean()
    steps = [round(16 * upper), round(32 * marks), round(64 * (data == 10).mean()), round(np.log2(words + 1))]
    return mixed(np.array([(k + 2) * 1000 + s for k, s in enumerate(steps)], np.uint64) + np.uint64(1 << 41))


@dataclass(frozen=True)
class NbSvm:
    """Weights by bucket (log-count ratios and linear weights in one), an offset, and the two numbers of the score's sigmoid."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def scores(self, texts: list[str]) -> np.ndarray:
        margin = np.array([self.weights[g].sum() / np.sqrt(max(1, len(g))) + self.offset for g in _grams(texts)])
        return 1 / (1 + np.exp(np.clip(-(self.slope * margin + self.shift), -60, 60)))


def _ratios(grams: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of (share of the positive documents with the n-gram / share of the negative ones), smoothed by one."""
    n = 1 << BITS
    pos, neg = (1 + np.bincount(np.concatenate([g for g, label in zip(grams, y, strict=True) if label == sign] or [np.zeros(0, np.int32)]), minlength=n) for sign in (1, -1))
    return np.log((pos / (1 + (y == 1).sum())) / (neg / (1 + (y == -1).sum())))


def _dual_descent(grams: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + sum cost_i * hinge(y_i (w x_i + b)) by coordinate descent on the dual; the bias is a constant feature."""
    w, b, alpha, rng = np.zeros(1 << BITS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g, v = grams[i], values[i]
            new = min(max(alpha[i] - (y[i] * (w[g] @ v + b) - 1) / square[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[g] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that gives probabilities, by Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == -1).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, np.array([(d * margin).sum(), d.sum()]))
        slope, shift = slope - np.clip(move[0], -2, 2), shift - np.clip(move[1], -2, 2)
    return float(max(slope, 1e-3)), float(shift)


def fit_nbsvm(texts: list[str], labels: list[int], *, cost: float = 1.0, epochs: int = 20, seed: int = 17) -> NbSvm:
    """Fit on four fifths of the rows and set the sigmoid on the rest. One class only: every score is near that class."""
    y = np.where(np.asarray(labels) == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        return NbSvm(np.zeros(1 << BITS), 0.0, 1.0, 0.0 if not len(y) else 4.0 * float(y[0]))
    grams = list(_grams(texts))
    fold = np.random.default_rng(seed).permutation(len(y)) % 5
    train, rest = np.flatnonzero(fold > 0), np.flatnonzero(fold == 0)
    if len(set(y[train].tolist())) < 2 or len(set(y[rest].tolist())) < 2:
        train = rest = np.arange(len(y))
    ratio = _ratios([grams[i] for i in train], y[train])
    values = [ratio[grams[i]] / np.sqrt(max(1, len(grams[i]))) for i in train]
    share = np.array([(y[train] == s).mean() for s in (-1, 1)])
    w, b = _dual_descent([grams[i] for i in train], values, y[train], cost / (2 * share[(y[train] > 0).astype(int)]), epochs, seed)
    weights = ratio * w
    margin = np.array([weights[grams[i]].sum() / np.sqrt(max(1, len(grams[i]))) + b for i in rest])
    return NbSvm(weights, b, *_platt(margin, y[rest]))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's digits is a multiple of ``folds``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def with_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    threshold: float = 0.3,
    max_train_rows: int = 12_000,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    returned: list[str] | None = None,
) -> DataFrame:
    """The documents with ``score`` and ``predicted``; of their own columns those named in ``returned``, else all.

    The model is fitted on at most ``max_train_rows`` labelled rows outside the held-out fold, those with the smallest
    hash of their id, so the same rows whatever the partitioning. Their number is bounded, and one task fits the model.
    Scoring is one pass over all texts without a shuffle; the model sent to it has 2**18 weights at any corpus size.
    Only the text is an input of a score.

    Defined results: null and empty texts get the score of no n-gram at all; an id that is labelled more than once
    takes the rounded mean label; null labels and null ids teach nothing; without labels every score is 0.5; an empty
    table gives an empty result; columns of the documents named score or predicted are replaced.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    marked = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(max_train_rows)
    )
    # At most max_train_rows ids were marked, so this broadcast is bounded, and so is the one task that fits the model.
    taught = rows.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        model = fit_nbsvm(frame["text"].tolist(), frame["label"].tolist(), seed=seed)
        return pd.DataFrame([(model.weights.astype("<f4").tobytes(), model.offset, model.slope, model.shift)], columns=["weights", "offset", "slope", "shift"])

    fitted = taught.groupBy().applyInPandas(fit, "weights binary, offset double, slope double, shift double").first()
    if fitted is None:
        model = fit_nbsvm([], [])
    else:
        model = NbSvm(np.frombuffer(fitted.weights, "<f4").astype(float), fitted.offset, fitted.slope, fitted.shift)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if returned is None else returned) if c not in ("score", "predicted")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([text or "" for text in batch.column(text_col).to_pylist()])
            columns = [batch.column(c) for c in kept] + [pa.array(scores), pa.array((scores >= threshold).astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "score", "predicted"])

    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text_col])]).mapInArrow(score, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **parameters) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (see with_quality)."""
    scored = with_quality(docs, labels, id_col=id_col, returned=[id_col], **parameters)
    return scored.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), "score", "predicted")

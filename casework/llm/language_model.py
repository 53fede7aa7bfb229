"""Language-model scores from log-frequency Bloom filters of quantised n-gram counts, one for each bucket of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import plain_text, stored
from casework.llm.wordhash import chunks, mixed, word_hashes

ORDER = 3
#: Counts of one level are told apart from the next level's only: 1, 2, 3, 4, 6, 8, 12, 16, 24, ...
STEPS = np.unique(np.concatenate([[1, 2, 3]] + [[1 << k, 3 << (k - 1)] for k in range(2, 62)])).astype(np.int64)
#: What a level stands for: the middle of its counts; level 0 is no entry.
MEANS = np.concatenate([[0.0], (STEPS + np.concatenate((STEPS[1:] - 1, STEPS[-1:]))) / 2])
#: The least count that is entered, by order: what occurs once is part of the model too.
LEAST = {1: 1, 2: 1, 3: 1}
CHARS = 1 << 22  # of text that a task counts or scores at a time
BUCKET_CHARS = 1 << 22  # of text for each bucket of keys
#: The bits of a key that tell n-grams apart, by order: the 48 highest of pairs and triples, which move in three quarters of the bytes.
KEPT = {1: np.uint64(2**64 - 1), 2: np.uint64(2**64 - 2**16), 3: np.uint64(2**64 - 2**16)}
#: Marks of a text in its chunk.
HELD_OUT, TUNE, NO_ID = 1, 2, 4
_START, _END = mixed(np.array([1 << 50, 1 << 51], np.uint64))
#: Prior weights of the shorter history that are tried for pairs and triples.
PRIORS = [(float(a), float(b)) for a in (1, 10, 100, 1000, 10_000, 100_000) for b in (1, 10, 100, 1000)]


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts: start mark, words and end of each in turn, with the key of the n-gram that ends at each place."""

    keys: dict[int, np.ndarray]
    starts: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        hashed = [word_hashes(texts[low:high]) for low, high in chunks(texts)]
        words, held = (np.concatenate([x[k] for x in hashed]) for k in (0, 1)) if hashed else word_hashes([])
        counts = held + 2
        stops = np.cumsum(counts)
        starts = stops - counts
        flat = np.empty(int(counts.sum()), np.uint64)
        inside = np.ones(len(flat), bool)
        inside[starts] = inside[stops - 1] = False
        flat[inside], flat[starts], flat[stops - 1] = words, _START, _END
        keys = {1: flat}
        for order in range(2, ORDER + 1):
            before = np.concatenate((keys[order - 1][:1], keys[order - 1][:-1]))
            keys[order] = mixed(before * np.uint64(2 * order + 1) + flat)
        return cls(keys, starts, counts)

    def whole(self, order: int) -> np.ndarray:
        """The places at which an n-gram of that order ends: from the first word for one and two tokens, from the second token for three."""
        ends = np.ones(len(self.keys[1]), bool)
        for k in range(max(1, order - 1)):
            ends[self.starts + k] = False
        return ends

    def different(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places at which n-grams of that order end, their different keys in order, and which of these each place has."""
        ends = np.flatnonzero(self.whole(order))
        return ends, *np.unique(self.keys[order][ends] & KEPT[order], return_inverse=True)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys in order fall into buckets in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Keys in order as their differences, byte plane by byte plane: the planes that hold zeros take next to nothing once compressed."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The keys that were packed."""
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _spots(keys: np.ndarray, levels: np.ndarray | int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of its region that a key has at a level, and the four bits there."""
    x = mixed(keys + np.asarray(levels).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    mask = np.zeros(len(x), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((x >> np.uint64(shift)) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64), mask


def region(keys: np.ndarray, counts: np.ndarray, order: int, words: int) -> np.ndarray:
    """The filter of one bucket: every key is entered at each level from the least up to that of its count."""
    levels = np.searchsorted(STEPS, counts, side="right")
    first = int(np.searchsorted(STEPS, LEAST[order], side="right"))
    each = levels - first + 1
    up = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + first
    at, mask = _spots(np.repeat(keys, each), up, words)
    bits = np.zeros(words, np.uint64)
    np.bitwise_or.at(bits, at, mask)
    return bits


@dataclass(frozen=True)
class Part:
    """The regions of some buckets, from ``low`` on, of the filter of one order."""

    order: int
    buckets: int
    low: int
    words: int
    bits: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, by asking for one level after the other; 0 where the key has no entry here."""
        first = int(np.searchsorted(STEPS, LEAST[self.order], side="right"))
        own = bucket_of(keys, self.buckets) - self.low
        out = np.zeros(len(keys), np.uint8)
        left = np.flatnonzero((own >= 0) & (own < len(self.bits) // max(1, self.words)))
        for level in range(first, len(STEPS) + 1):
            if not len(left):
                break
            at, mask = _spots(keys[left], level, self.words)
            left = left[(self.bits[own[left] * self.words + at] & mask) == mask]
            out[left] = level
        return out


def _chunked(rows: DataFrame) -> DataFrame:
    """The texts some megabytes in a row: (marks, ids, texts, bytes, learned), the latter two how much text that is and how many
    of its texts are learned from."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks: list[int] = []
        ids: list[int] = []
        texts: list[str] = []

        def full() -> pd.DataFrame:
            learned = sum(not m & HELD_OUT for m in marks)
            out = pd.DataFrame({"marks": [marks[:]], "ids": [ids[:]], "texts": [texts[:]], "bytes": [held], "learned": [learned]})
            for part in (marks, ids, texts):
                part.clear()
            return out

        held = 0
        for batch in batches:
            for mark, own, text, size in zip(batch["mark"], batch["id"], batch["text"], batch["bytes"], strict=True):
                marks.append(mark)
                ids.append(own)
                texts.append(text)
                held += size
                if held >= CHARS:
                    yield full()
                    held = 0
        if texts:
            yield full()

    mark = F.when(F.col("held_out"), HELD_OUT).otherwise(0) + F.when(F.col("tune"), TUNE).otherwise(0) + F.when(F.col("doc_id").isNull(), NO_ID).otherwise(0)
    known = rows.select(mark.alias("mark"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "text", F.octet_length("text").cast("long").alias("bytes"))
    return known.mapInPandas(gather, "marks array<int>, ids array<long>, texts array<string>, bytes long, learned long")


def _asked(chunked: DataFrame, buckets: int) -> DataFrame:
    """The different n-grams of each chunk by bucket: (chunk, order, bucket, keys, counts), the keys packed in order, with how often
    each occurs in what is learned from; 0 where it is only asked for."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.arange(buckets + 1)
        for batch in batches:
            for chunk, marks, texts in zip(batch["chunk"], batch["marks"], batch["texts"], strict=True):
                tokens = Tokens.of(list(texts))
                learned = np.repeat(np.asarray(marks) & HELD_OUT == 0, tokens.counts)
                for order in range(1, ORDER + 1):
                    ends, keys, which = tokens.different(order)
                    counts = np.bincount(which, weights=learned[ends], minlength=len(keys)).astype(np.uint32)
                    cuts = np.searchsorted(bucket_of(keys, buckets), edges)
                    full = np.flatnonzero(np.diff(cuts))
                    rows = [(packed(keys[cuts[b] : cuts[b + 1]]), counts[cuts[b] : cuts[b + 1]].tobytes()) for b in full]
                    yield pd.DataFrame({"chunk": chunk, "order": order, "bucket": full, "keys": [k for k, _ in rows], "counts": [c for _, c in rows]})

    return chunked.select("chunk", "marks", "texts").mapInPandas(count, "chunk long, order int, bucket int, keys binary, counts binary")


def _answered(asked: DataFrame, buckets: int, bits_per_entry: int, most_bytes: int) -> DataFrame:
    """What is asked, in the order of the keys: (chunk, order, bucket, found, total, different). ``found`` holds the counts of words and the
    levels of pairs and triples; total and different, how many occurrences and different n-grams are learned, stand in
    one row of each bucket. A bucket's filter has as many bits as its entries need, and lives only in the task that has the bucket."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        order, bucket = (int(group[c].iloc[0]) for c in ("order", "bucket"))
        pieces = [unpacked(k) for k in group["keys"]]
        stops = np.cumsum([len(p) for p in pieces])
        flat = np.concatenate(pieces)
        counts = np.frombuffer(b"".join(group["counts"]), np.uint32).astype(np.int64)
        by = np.argsort(flat, kind="stable")
        new = np.concatenate(([True], flat[by][1:] != flat[by][:-1]))
        keys, sums = flat[by][new], np.add.reduceat(counts[by], np.flatnonzero(new))
        learned = sums >= LEAST[order]
        if order == 1:
            found = np.empty(len(flat), np.int64)
            found[by] = sums[np.cumsum(new) - 1]
        else:
            keys, own = keys[learned], sums[learned]
            first = np.searchsorted(STEPS, LEAST[order], side="right")
            entries = int((np.searchsorted(STEPS, own, side="right") - first + 1).sum())
            words = max(1, -(-entries * bits_per_entry // 64))
            part = Part(order, buckets, bucket, words, region(keys, own, order, words))
            step = max(1, most_bytes // 8)
            found = np.concatenate([part.levels(flat[low : low + step]) for low in range(0, len(flat), step)])
        out = pd.DataFrame({"chunk": group["chunk"], "order": order, "bucket": bucket, "found": [x.tobytes() for x in np.split(found, stops[:-1])], "total": 0, "different": 0})
        out.iloc[0, [4, 5]] = int(sums[learned].sum()), int(learned.sum())
        return out

    return asked.groupBy("order", "bucket").applyInPandas(answer, "chunk long, order int, bucket int, found binary, total long, different long")


def _levelled(chunked: DataFrame, answers: DataFrame, mass: float) -> DataFrame:
    """A row for each text: id, no_id (it is null), held_out, tune, n_tokens, n_known, base_score, and the levels of the n-grams that end at each
    of its places, order by order, 0 where none does."""

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for marks, ids, texts, found in zip(batch["marks"], batch["ids"], batch["texts"], batch["found"], strict=True):
                tokens = Tokens.of(list(texts))
                data, at = b"".join(found), 0
                counts = np.zeros(len(tokens.keys[1]), np.int64)
                levels = np.zeros((ORDER, len(counts)), np.uint8)
                for order in range(1, ORDER + 1):
                    ends, keys, which = tokens.different(order)
                    own = np.frombuffer(data, np.int64 if order == 1 else np.uint8, len(keys), at)
                    at += own.nbytes
                    if order == 1:
                        counts[ends] = own[which]
                        own = np.searchsorted(STEPS, own, side="right").astype(np.uint8)
                    levels[order - 1][ends] = own[which]
                base = np.log10((counts + 0.1) / mass)
                base[tokens.starts] = 0
                marks = np.asarray(marks)
                stops = tokens.starts + tokens.counts
                yield pd.DataFrame({
                    "id": ids, "no_id": marks & NO_ID > 0, "held_out": marks & HELD_OUT > 0, "tune": marks & TUNE > 0, "n_tokens": tokens.counts - 1,
                    "n_known": np.add.reduceat((counts > 0).astype(np.int64), tokens.starts), "base_score": np.add.reduceat(base, tokens.starts),
                    "levels": [levels[:, a:b].tobytes() for a, b in zip(tokens.starts, stops, strict=True)],
                })

    found = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("order", "bucket", "found"))).alias("found"))
    together = chunked.hint("merge").join(found.withColumn("found", F.col("found.found")), "chunk")
    return together.select("marks", "ids", "texts", "found").mapInPandas(
        level, "id long, no_id boolean, held_out boolean, tune boolean, n_tokens long, n_known long, base_score double, levels binary"
    )


def _by_texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, levels, starts) of some texts at a time."""
    for batch in batches:
        for low, high in chunks(batch["levels"].tolist(), ORDER * CHARS // 8):
            rows = batch.iloc[low:high]
            each = [np.frombuffer(x, np.uint8).reshape(ORDER, -1) for x in rows["levels"]]
            stops = np.cumsum([x.shape[1] for x in each])
            yield rows, np.concatenate(each, axis=1), np.concatenate(([0], stops[:-1]))


@dataclass(frozen=True)
class Model:
    """How many tokens and different tokens were learned from, in how many documents; the prior weights of pairs and triples."""

    tokens: int
    different: int
    documents: int
    priors: tuple[float, float] = PRIORS[0]

    @property
    def mass(self) -> float:
        return self.tokens + 0.1 * (self.different + 1)

    def logs(self, levels: np.ndarray, starts: np.ndarray, priors: list[tuple[float, float]], own: int = 0) -> Iterator[np.ndarray]:
        """log10 of each place's probability for each of ``priors``; 0 at start marks. ``own``: how often a text is itself in the counts.

        p(w) = (c(w) + 0.1) / mass, p(w | v) = (c(vw) + a p(w)) / (c(v) + a), p(w | uv) = (c(uvw) + b p(w | v)) / (c(uv) + b).
        No count may exceed that of its parts, which also takes back most chance hits of the filter."""
        one, two, three = (np.maximum(MEANS[row] - own, 0) for row in levels)
        before = np.concatenate(([0.0], one[:-1]))
        before[starts + 1] = max(self.documents - own, 0)
        two = np.minimum(two, np.minimum(one, before))
        pair = np.concatenate(([0.0], two[:-1]))
        pair[starts + 1] = 0
        three = np.minimum(three, np.minimum(two, pair))
        single = (one + 0.1) / max(self.mass - own, 0.1)
        for a, b in priors:
            p = (three + b * (two + a * single) / (before + a)) / (pair + b)
            p[starts] = 1
            yield np.log10(p)


def _tuned(model: Model, texts: DataFrame) -> Model:
    """The model with the prior weights under which these texts, each taken out of the counts, are likeliest; texts: (levels)."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, levels, starts in _by_texts(batches):
            found = [float(x.sum()) for x in model.logs(levels, starts, PRIORS, own=1)]
            yield pd.DataFrame({"prior": range(len(found)), "log": found})

    likely = {r["prior"]: r["log"] for r in texts.mapInPandas(sums, "prior int, log double").groupBy("prior").agg(F.sum("log").alias("log")).collect()}
    best = max(range(len(PRIORS)), key=lambda i: (likely.get(i, 0.0), -i))
    return Model(model.tokens, model.different, model.documents, PRIORS[best])


def lm_scores(
    docs: DataFrame,
    learn: Column,
    tune: Column,
    *,
    bits_per_entry: int = 12,
    most_bytes: int = 1 << 24,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out (not ``learn``), n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (see WORD; A-Z lower-cased) and one end. All words, pairs and triples of the texts where ``learn`` holds are
    counted, those that occur once too. Counts are quantised to levels and entered into a Bloom filter,
    a key once for each level up to its own, so that asking level by level until one misses gives its count; the filter never
    says too little. ``score`` is the log10 probability of the text: relative counts of triples, smoothed with those of
    pairs, those with those of words (see Model.logs); the two prior weights are those, of a fixed grid, under which
    the texts where ``tune`` holds are likeliest when each is taken out of the counts. As counts are quantised the
    probabilities of all words after a history do not add up to exactly one. Words are counted exactly, for ``base_score`` and for ``score``.

    Texts go in chunks of some megabytes. The different n-grams of a chunk are dealt to buckets of keys, as many as the text asks for,
    whether they are learned or only asked for; a bucket adds up the counts, fills its own filter, with so many bits for each entry that chance
    hits stay as rare (about one in a hundred) however many n-grams there are, and sends each chunk the levels in the order in
    which it asked. So each n-gram of a chunk moves once and its level back, no task holds more than one bucket or chunk, and nothing but
    sums reaches the driver. ``most_bytes`` of keys are asked at a time. Words are told apart by 64-bit hashes, pairs and triples by 48 bits.

    Defined results: a null text counts as empty, an empty text is one end; where ``learn`` or ``tune`` is null it is
    false; rows that repeat an id are scored each; without any training text every score is 0; an empty
    table gives an empty result; other columns are ignored. A very long text is read whole in one task, in memory
    of some 150 bytes for each of its words."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (~F.coalesce(learn, F.lit(False))).alias("held_out"),
        F.coalesce(tune, F.lit(False)).alias("tune"),
        plain_text(text_col).alias("text"),
    )
    # Numbers are given once, as the rows are written, and read back as data: no two chunks share one.
    chunked = stored(_chunked(rows).withColumn("chunk", F.monotonically_increasing_id()))
    size, documents = chunked.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "learned")]).first()
    buckets = max(16, -(-size // BUCKET_CHARS))  # what a task merges of one bucket does not grow with the data
    answers = stored(_answered(_asked(chunked, buckets), buckets, bits_per_entry, most_bytes))
    tokens, different = answers.filter("order = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "different")]).first()

    known = Model(tokens, different, documents)
    found = stored(_levelled(chunked, answers.select("chunk", "order", "bucket", "found"), known.mass))
    model = _tuned(known, found.filter("tune AND NOT held_out").select("levels"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, levels, starts in _by_texts(batches):
            total = np.add.reduceat(next(model.logs(levels, starts, [model.priors])), starts)
            yield part.drop(columns="levels").assign(train_tokens=tokens, score=total)

    scores = found.drop("tune").mapInPandas(score, "id long, no_id boolean, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scores.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Edit-aware token counts: a segment tree over each document's pre-tokens, re-encoded only where an edit reaches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import plain_text

LEAF = 64  # pre-tokens of a leaf when it is built
_YOUNG = 200_000

TREES = "doc_id long, text string, chars array<int>, pretokens array<int>, tokens array<int>"
EDITS = "array<struct<start:int,stop:int,text:string>>"


class PretokenCounts(dict):
    """The number of tokens of a pre-token, counted when first asked for. Byte-level BPE never merges across pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self._old = regex.compile(pattern), {}

    def __missing__(self, pretoken: str) -> int:
        n = self._old.get(pretoken) or len(self._encoding.encode_ordinary(pretoken))
        if len(pretoken) <= 40:
            if len(self) >= _YOUNG:  # the full generation stays behind this one, so frequent pre-tokens come back
                self._old = dict(self)
                self.clear()
            self[pretoken] = n
        return n


@lru_cache(maxsize=2)
def _counts(ranks_path: str, pattern: str) -> PretokenCounts:
    return PretokenCounts(ranks_path, pattern)


class TokenTree:
    """Sums of characters, pre-tokens and tokens in heap order: node i has the children 2i and 2i + 1, the leaves come
    last. Every leaf begins where a pre-token begins."""

    def __init__(self, sums: list[np.ndarray]) -> None:
        self.sums, self.width = sums, len(sums[0]) // 2

    @classmethod
    def from_leaves(cls, leaves: list[np.ndarray]) -> TokenTree:
        width = 1 << max(0, len(leaves[0]) - 1).bit_length()
        sums = []
        for leaf in leaves:
            heap = np.zeros(2 * width, np.int32)
            heap[width : width + len(leaf)] = leaf
            at = width
            while at > 1:
                heap[at // 2 : at] = heap[at : 2 * at : 2] + heap[at + 1 : 2 * at : 2]
                at //= 2
            sums.append(heap)
        return cls(sums)

    @classmethod
    def of_text(cls, text: str, counts: PretokenCounts) -> TokenTree:
        parts = counts.pattern.findall(text)
        if not parts:
            return cls.from_leaves([np.zeros(1, np.int32)] * 3)
        starts = np.arange(0, len(parts), LEAF)
        chars = np.add.reduceat(np.fromiter(map(len, parts), np.int32, len(parts)), starts)
        tokens = np.add.reduceat(np.fromiter(map(counts.__getitem__, parts), np.int32, len(parts)), starts)
        return cls.from_leaves([chars, np.diff(np.append(starts, len(parts))).astype(np.int32), tokens])

    @property
    def totals(self) -> tuple[int, int, int]:
        return tuple(int(s[1]) for s in self.sums)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character ``place``, and where the leaf starts; beyond the end, the last leaf with text."""
        chars, node, start = self.sums[0], 1, 0
        place = max(0, min(place, int(chars[1]) - 1))
        while node < self.width:
            node *= 2
            if place - start >= chars[node]:
                start += int(chars[node])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, values: tuple[int, int, int]) -> None:
        """Set a leaf and update the sums above it."""
        for heap, value in zip(self.sums, values, strict=True):
            node, change = leaf + self.width, value - int(heap[leaf + self.width])
            while change and node:
                heap[node] += change
                node //= 2

    def edit(self, text: str, start: int, stop: int, new: str, counts: PretokenCounts) -> tuple[str, int]:
        """The text with [start, stop) replaced, and how many pre-tokens were encoded again.

        Where a pre-token ends is decided by its own characters, at most two after it (as in 're), and the rest of a run
        of white space that it ends in. So pre-tokens stay that end two characters before ``start``, or before the run of
        white space that holds this place. Matching begins at the leaf with that place and goes on past the edit until a
        pre-token ends where an old leaf ended; from there on the old pre-tokens hold again.
        """
        sure = max(0, start - 2)
        while sure and text[sure - 1].isspace():
            sure -= 1
        edited, shift = text[:start] + new + text[stop:], len(new) - (stop - start)
        first, begin = self.leaf_at(sure)
        leaf, end = first, begin + int(self.sums[0][first + self.width])
        at, made, tokens, last = begin, 0, 0, len(text)
        while end < stop and end < last:
            leaf += 1
            end += int(self.sums[0][leaf + self.width])
        for match in counts.pattern.finditer(edited, begin):
            if at >= start + len(new):
                while end + shift < at and end < last:
                    leaf += 1
                    end += int(self.sums[0][leaf + self.width])
                if at == end + shift and at > begin:
                    break
            made, tokens, at = made + 1, tokens + counts[match[0]], match.end()
        else:
            leaf = self.width - 1
        for gone in range(first + 1, leaf + 1):
            self.put(gone, (0, 0, 0))
        self.put(first, (at - begin, made, tokens))
        if made > 8 * LEAF:
            self.__init__(TokenTree.of_text(edited, counts).sums)
        return edited, made


#: Rows of a batch that are worked on at a time, so that texts, trees and edits of many are never held together.
_ROWS = 500


def _trees(batches: Iterator[pd.DataFrame], ranks: str, pattern: str) -> Iterator[pd.DataFrame]:
    counts = _counts(ranks, pattern)
    for whole in batches:
        for low in range(0, len(whole), _ROWS):
            batch = whole.iloc[low : low + _ROWS]
            trees = [TokenTree.of_text(text, counts) for text in batch["text"]]
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), **{name: [t.sums[k] for t in trees] for k, name in enumerate(("chars", "pretokens", "tokens"))})


def _edited(batches: Iterator[pd.DataFrame], ranks: str, pattern: str) -> Iterator[pd.DataFrame]:
    counts = _counts(ranks, pattern)
    names = ["doc_id", "text", "chars", "pretokens", "tokens", "n_edits", "n_before", "n_tokens", "n_pretokens", "reencoded"]
    for whole in batches:
        for low in range(0, len(whole), _ROWS):
            rows = []
            for row in whole.iloc[low : low + _ROWS].itertuples(index=False):
                tree, text, again = TokenTree([np.array(s, np.int32) for s in (row.chars, row.pretokens, row.tokens)]), row.text, 0
                edits, before = row.edits if row.edits is not None else (), tree.totals[2]
                for one in edits:
                    start = max(0, min(one["start"], len(text)))
                    text, made = tree.edit(text, start, max(start, min(one["stop"], len(text))), one["text"] or "", counts)
                    again += made
                rows.append((row.doc_id, text, *tree.sums, len(edits), before, tree.totals[2], tree.totals[1], again))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def token_trees(docs: DataFrame, *, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text and its tree (chars, pretokens, tokens in heap order; place 1 has the totals)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    return rows.mapInPandas(lambda batches: _trees(batches, ranks, pattern), TREES)


def apply_edits(trees: DataFrame, *, ranks: str, pattern: str) -> DataFrame:
    """The trees after their column ``edits``, an array of (start, stop, text) applied one after the other.

    Adds n_edits, n_before and n_tokens (token counts before and after), n_pretokens after, and reencoded, the
    pre-tokens that were encoded again. Null edits are none; offsets beyond the text mean its end.
    """
    return trees.select("doc_id", "text", "chars", "pretokens", "tokens", "edits").mapInPandas(
        lambda batches: _edited(batches, ranks, pattern), TREES + ", n_edits long, n_before long, n_tokens long, n_pretokens long, reencoded long"
    )


#: What the redaction edits look for, and what they leave.
REDACTIONS = {"<email>": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<ip>": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<phone>": r"\+?\d[\d() -]{7,}\d"}


def redactions(text: str) -> list[dict]:
    """The edits that replace e-mail addresses, IP addresses and telephone numbers by markers."""
    out, shift = [], 0
    for match in _redacted().finditer(text):
        mark = list(REDACTIONS)[int(match.lastgroup[1:])]
        out.append({"start": match.start() + shift, "stop": match.end() + shift, "text": mark})
        shift += len(mark) - len(match[0])
    return out


@lru_cache(maxsize=1)
def _redacted() -> regex.Pattern:
    return regex.compile("|".join(f"(?P<k{n}>{p})" for n, p in enumerate(REDACTIONS.values())), regex.ASCII)


def with_redactions(trees: DataFrame) -> DataFrame:
    """Adds ``edits`` (see redactions)."""
    return trees.withColumn("edits", F.pandas_udf(lambda texts: texts.map(redactions), EDITS)("text"))


def redacted_token_counts(docs: DataFrame, *, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every document before and after its redaction edits: doc_id, n_before, n_tokens, n_pretokens,
    n_edits, reencoded.

    Trees, edits and counts are made where the text is read; nothing is shuffled, and a tree is a few hundredths of
    its text. A lost task is simply run again.

    Defined results: a null or empty text has 0 tokens; rows that repeat are counted each; null ids stay null; an
    empty table gives an empty result; other columns are ignored.
    """
    counted = ["doc_id", "n_before", "n_tokens", "n_pretokens", "n_edits", "reencoded"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Tree, edits and counts of some rows in one worker: texts and trees do not go through the engine in between.
        with_edits = (batch.assign(edits=batch["text"].map(redactions)) for batch in _trees(batches, ranks, pattern))
        for done in _edited(with_edits, ranks, pattern):
            yield done[counted]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    return rows.mapInPandas(run, ", ".join(f"{c} long" for c in counted))

"""Best-two-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import cut, plain_text

_YOUNG_WORDS = 400_000
_CACHED_LENGTH = 40

#: Printable ASCII and Latin letters with one form only, without the opening of a special token: what the tokenizer's
#: normalizer merely lower-cases. And how the tokenizer splits such words.
_PLAIN = re.compile(r"(?:[!-;=-~À-ÖØ-öø-ÿ]|<(?!\|))+")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

#: Byte-level BPE writes each byte as a character: itself where that is printable, else the next one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHAR = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Recent(dict):
    """A bounded cache in two generations: a full young one becomes the old one, and keys that are met again come back
    from there, so frequent keys stay."""

    def __init__(self) -> None:
        self._old: dict = {}

    def make(self, key: bytes | str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: bytes | str) -> bytes:
        ids = self._old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= _CACHED_LENGTH:
            if len(self) >= _YOUNG_WORDS:
                self._old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class _PartIds(_Recent):
    """Ids of one lower-case pre-token for which the tokenizer's normalizer changes nothing."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self._model = tokenizer.model

    def make(self, key: str) -> bytes:
        return np.array([t.id for t in self._model.tokenize("".join(map(_AS_CHAR.__getitem__, key.encode())))], "<u4").tobytes()


class WordIds(_Recent):
    """The token ids of a word (UTF-8) as little-endian 32-bit bytes, encoded when first asked for.

    For tokenizers that drop white space and never merge across it, so that a text's ids are its words' ids in order.
    Plain words are made of their lower-case pre-tokens, which repeat far more than words do.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._parts = _PartIds(self._tokenizer)

    def make(self, key: bytes) -> bytes:
        text = key.decode("utf-8", "surrogatepass")
        if _PLAIN.fullmatch(text):
            return b"".join(map(self._parts.__getitem__, _PRETOKEN.findall(text.lower())))
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of_text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """One for each Python worker, which keeps it from task to task."""
    return WordIds(path)


def token_pieces(docs: DataFrame, *, tokenizer: str, length: int, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and a separator, cut into pieces of ``length`` ids where longer; the ids only as checksum."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end, width = _word_ids(tokenizer), np.uint32(separator).tobytes(), 4 * length
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = words.of_text(text) + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text")).mapInPandas(pieces, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. Lengths are interchangeable, so the search works on counts by length.

    A bin is filled greedily with the longest piece that fits. If a gap is left, its smallest piece is put back when
    two unpacked pieces fill the widened gap more tightly; the widest such pair is taken.
    """
    order = np.argsort(-lengths, kind="stable")
    first = np.searchsorted(-lengths[order], -np.arange(capacity + 1), side="left")
    count = np.bincount(lengths, minlength=capacity + 1).tolist()
    free = sum(1 << n for n, c in enumerate(count) if c)  # bit n: a piece of length n is unpacked

    def take(n: int) -> None:
        nonlocal free
        count[n] -= 1
        if not count[n]:
            free &= ~(1 << n)

    def give(n: int) -> None:
        nonlocal free
        count[n] += 1
        free |= 1 << n

    def longest(most: int) -> int:
        """The longest unpacked length up to ``most``, or 0."""
        return (free & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and free & ((1 << (most + 1)) - 2) else 0

    bins: list[list[int]] = []
    while free:
        bin_, gap = [], capacity
        while n := longest(gap):
            take(n)
            bin_.append(n)
            gap -= n
        if gap and len(bin_) > 1 and free:
            least = bin_[-1]
            room, best = gap + least, (least, 0, 0)
            a = longest(room - 1)
            while 2 * a > best[0]:
                take(a)
                b = longest(min(room - a, a))
                give(a)
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = longest(a - 1)
            if best[1]:
                bin_.pop()
                give(least)
                for n in best[1:]:
                    take(n)
                    bin_.append(n)
        bins.append(bin_)
    out_bin, out_offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), first.tolist()
    for k, bin_ in enumerate(bins):
        offset = 0
        for n in bin_:
            at = order[used[n]]
            used[n] += 1
            out_bin[at], out_offset[at] = k, offset
            offset += n
    return out_bin, out_offset


def pack_documents(
    docs: DataFrame, *, tokenizer: str, length: int = 2048, separator: int = 0, group: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenised where they are read; only narrow piece rows are shuffled, by hash, into groups of about
    ``group`` pieces, each packed on its own. A group ends with less than one sequence of slack, so the loss is under
    one sequence in some hundreds, at any size of the table, and no group grows with it.

    Defined results: a null or empty text is one piece holding the separator alone; rows that repeat are packed each;
    an empty table gives an empty result; other columns are ignored.
    """
    pieces = cut(token_pieces(docs, tokenizer=tokenizer, length=length, separator=separator, id_col=id_col, text_col=text_col))
    groups = max(1, -(-pieces.count() // group))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = best_two_fit(frame["length"].to_numpy(np.int64), length)
        return frame.assign(sequence_id=frame["part"].to_numpy(np.int64) * (2 * group * 1024) + bins, offset=offsets).drop(columns="part")

    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("part")
    return pieces.select("*", part).groupBy("part").applyInPandas(pack, PIECES + ", sequence_id long, offset long")

"""Ranked lexical search: short lists are summed first, the sums then take part in document-at-a-time work as one list."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import plain_text, stored

#: Bytes of UTF-8 text as they are compared: ASCII other than letters and digits separates terms, A-Z are lower-cased.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
_NO_ID = -(2**63)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order: maximal runs of ASCII letters, digits and whatever is not ASCII."""
    # Only ASCII bytes change, so no character is torn; the white space that split() knows is among the separators.
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Query:
    """One row of the query table: its id, and its terms by number with how often each is repeated."""

    id: int | None
    terms: np.ndarray
    repeats: np.ndarray


@dataclass(frozen=True)
class PostingList:
    """Places (rising) in a segment, what each adds to a score, and the most that one adds."""

    places: np.ndarray
    adds: np.ndarray
    bound: int


class Best:
    """The best so far of one query: highest score first, ties by id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document below this score cannot enter; one at it can, by its id."""
        return int(self.scores[-1]) if len(self.scores) >= self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Segment:
    """An inverted index of some documents, in the order of their ids: a batch of the stored rows."""

    def __init__(self, batch: pd.DataFrame, weights: np.ndarray, documents: int, total: int) -> None:
        batch = batch.assign(doc_id=batch["doc_id"].astype("Int64").fillna(_NO_ID).astype("int64")).sort_values("doc_id", kind="stable")
        self.ids = batch["doc_id"].to_numpy()
        held = batch["terms"].map(len).to_numpy()
        places = np.repeat(np.arange(len(batch)), held)
        terms, counts = (np.concatenate([*batch[c], np.zeros(0, np.int32)]).astype(np.int64) for c in ("terms", "counts"))
        m = 75 + (25 * batch["n"].to_numpy() * documents) // max(1, total)
        adds = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m[places]))
        order = np.argsort(terms, kind="stable")
        self._places, self._adds = places[order], adds[order]
        self._starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def postings(self, term: int, repeats: int) -> PostingList | None:
        low, high = self._starts[term], self._starts[term + 1]
        if low == high:
            return None
        adds = self._adds[low:high] * repeats
        return PostingList(self._places[low:high], adds, int(adds.max()))

    def search(self, query: Query, is_long: np.ndarray, best: Best, block: int) -> None:
        """Offer to ``best`` all documents of the segment that can enter it."""
        lists: list[PostingList] = []
        short: list[PostingList] = []
        for term, repeats in zip(query.terms, query.repeats, strict=True):
            if found := self.postings(term, repeats):
                (lists if is_long[term] else short).append(found)
        if short:  # term at a time: the accumulators of all short lists
            places, adds = (np.concatenate([getattr(x, c) for x in short]) for c in ("places", "adds"))
            order = np.argsort(places, kind="stable")
            firsts = np.flatnonzero(np.diff(places[order], prepend=-1))
            sums = np.add.reduceat(adds[order], firsts)
            lists.append(PostingList(places[order][firsts], sums, int(sums.max())))
        # Document at a time: lists in the order of their bounds; reach[i] is the most that lists 0..i add together.
        lists.sort(key=lambda x: x.bound)
        reach = np.cumsum([x.bound for x in lists])
        for start in range(0, len(self.ids), block):
            least = best.least
            needed = int(np.searchsorted(reach, least))  # who is in none of the lists from here on cannot enter
            if needed == len(lists):
                return
            cuts = [slice(*np.searchsorted(x.places, (start, start + block))) for x in lists]
            own = [x.places[c] for x, c in zip(lists, cuts, strict=True)]
            met = np.unique(np.concatenate(own[needed:]))
            scores = np.zeros(len(met), np.int64)
            for x, c, places in zip(lists[needed:], cuts[needed:], own[needed:], strict=True):
                scores[np.searchsorted(met, places)] += x.adds[c]
            for i in range(needed - 1, -1, -1):  # skip through the others to those that still can
                can = scores + reach[i] >= least
                met, scores = met[can], scores[can]
                if not len(met):
                    break
                if len(own[i]):
                    at = np.minimum(np.searchsorted(own[i], met), len(own[i]) - 1)
                    scores += np.where(own[i][at] == met, lists[i].adds[cuts[i]][at], 0)
            enter = scores >= least
            if enter.any():
                best.offer(scores[enter], self.ids[met[enter]])


def _postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Per document: doc_id, n (its terms with repeats), and of the terms in ``numbers`` their numbers and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = shared.value
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch["text"]:
                held = Counter(terms_of(text))
                n.append(held.total())
                asked = held.keys() & numbers.keys()
                terms.append([numbers[t] for t in asked])
                counts.append([held[t] for t in asked])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": n, "terms": terms, "counts": counts})

    return docs.mapInPandas(read, "doc_id long, n long, terms array<int>, counts array<int>")


def _searched(docs: DataFrame, rows: list, k: int, long_share: int, block: int) -> DataFrame:
    """The best of each part of the documents for the query rows (id, text): query, item_id, doc_id, score."""
    spark = docs.sparkSession
    texts = [(row["id"], Counter(terms_of(row["text"]))) for row in rows]
    numbers = {t: i for i, t in enumerate(sorted({t for _, held in texts for t in held}))}
    asked = [Query(i, np.array([numbers[t] for t in held], np.int64), np.array([*held.values()], np.int64)) for i, held in texts]
    index = stored(_postings(docs, numbers))
    documents, total = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    for term, n in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each term of the queries
        df[term] = n
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    shared = spark.sparkContext.broadcast((asked, weights, df * long_share > documents))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, weights, is_long = shared.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            segment = Segment(batch, weights, documents, total)
            for query, own in zip(asked, best, strict=True):
                segment.search(query, is_long, own, block)
        for number, (query, own) in enumerate(zip(asked, best, strict=True)):
            if len(own.ids):
                ids = pd.Series(own.ids, dtype="Int64").mask(own.ids == _NO_ID)
                items = pd.Series([query.id] * len(ids), dtype="Int64")
                yield pd.DataFrame({"query": number, "item_id": items, "doc_id": ids, "score": own.scores})

    return index.mapInPandas(search, "query int, item_id long, doc_id long, score long")


def _best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lexical_search(
    docs: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    long_share: int = 64,
    block: int = 2048,
    at_once: int = 2000,
    chars_at_once: int = 1 << 23,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
) -> DataFrame:
    """The ``k`` best documents of each query: item_id, rank (from 1), doc_id, score; equal scores by rising doc_id.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), a document adds for it weight * (10**9 tf div (1000 tf + 12 m)) with
    m = 75 + (25 n N div L); all in 64-bit integers, so a score does not depend on the order of work. Documents are read
    once for their term counts of the query terms, which are stored; N, L and df come from all of them. Each batch of
    the stored rows is a segment: an inverted index of it is made in the task, and for each query the lists of terms that
    fewer than one in ``long_share`` documents hold are summed term at a time into accumulators. These are one list with a
    bound, beside the long ones: lists are ordered by bound, documents in none but the lowest lists, whose bounds
    together stay below the k-th best score so far, are never looked at, and those lists are only probed for documents
    that can still enter. The k-th score is carried from segment to segment of a task. Each task returns at most k rows a
    query; these are ranked within parts by hash and then together.

    Queries are the stated set that all documents are read against: they come in blocks of about ``at_once`` rows or
    ``chars_at_once`` characters, and only a block, with one weight for each of its terms, is broadcast.

    Defined results: null and empty texts have no terms and count in nothing; rows that repeat a doc_id are documents of
    their own; a null doc_id comes before others of the same score; different texts of one item_id are queries of their own, equal query rows
    are one; a query that no document answers gives no row; empty tables give an empty result; other columns are ignored.
    A very long text is read whole in one task, in memory of some 60 bytes for each of its terms.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    asked = stored(queries.select(F.col(query_id_col).cast("long").alias("id"), plain_text(query_text_col).alias("text")).distinct())
    n, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // at_once), -(-chars // chars_at_once))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    parts = [_searched(rows, numbered.filter(F.col("block") == b).collect(), k, long_share, block).withColumn("block", F.lit(b)) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    return _best(_best(found, k, "block", "query", "part"), k, "block", "query").select("item_id", "rank", "doc_id", "score")

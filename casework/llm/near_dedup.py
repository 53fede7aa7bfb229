"""Near-duplicate documents by an LSH forest over MinHash signatures of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import cut, plain_text, stored
from casework.llm.components import connected_components
from casework.llm.embedding_dedup import roots_of_links
from casework.llm.wordhash import chunks, mixed, shingle_hashes, word_hashes

#: A block of a crowd: about so many rows, of so many shingles together at most.
SIDE, SIDE_CELLS = 512, 1 << 19
#: Shingles of a block that are counted at a time.
COLUMNS = 1 << 12


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``size`` lower-cased words, hashed and sorted; a text with fewer words
    has its whole sequence as one shingle, a text without words none."""
    for low, high in chunks(texts):
        words, counts = word_hashes(texts[low:high])
        runs, after = shingle_hashes(words, size), np.cumsum(counts)
        for start, stop in zip(after - counts, after, strict=True):
            if stop - start >= size:
                yield np.unique(runs[start : stop - size + 1])
            elif stop > start:
                short = np.uint64(stop - start)
                for word in words[start:stop]:
                    short = mixed(np.array([short]) * np.uint64(31) + word)[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _signatures(sets: list[np.ndarray], values: int, seed: int) -> np.ndarray:
    """``values`` MinHash values for each non-empty set, big-endian so that bytes order as numbers."""
    rng = np.random.default_rng(seed)
    flips, factors = rng.integers(0, 2**32, (2, values), dtype=np.uint32)
    rows = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), values), ">u4")
    for k in range(values):
        spread = (flat ^ flips[k]) * (factors[k] | np.uint32(1))
        spread ^= spread >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(spread * np.uint32(0x2C1B3C6D), rows)
    return out


def _sketch(docs: DataFrame, *, size: int, trees: int, depth: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, signature; the last two null for empty sets."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            digests: list[bytes | None] = []
            signed: list[bytes | None] = []
            counts: list[int] = []
            held: list[np.ndarray] = []

            waiting = 0

            def sign() -> None:
                if held:
                    signed.extend(row.tobytes() for row in _signatures(held, trees * depth, seed))
                    held.clear()

            for own in shingle_sets(texts, size):
                counts.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                if len(own):
                    held.append(own)
                    waiting += len(own)
                    if waiting > 1 << 17:
                        sign()
                        waiting = 0
                else:
                    sign()
                    signed.append(None)
            sign()
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": counts, "digest": digests, "signature": signed})

    return docs.mapInPandas(sketch, "doc_id long, n_shingles long, digest binary, signature binary")


def _forest(classes: DataFrame, *, trees: int, depth: int, least: int, near: int) -> DataFrame:
    """Rows (tree, region, rep, next): every tree sorted by its whole label over all tasks, with the following rows
    that share a prefix of ``least`` values, nearest (longest common prefix) first.

    Only rows that have company stay. Range partitioning deals a crowded label over several tasks; the rows of the
    first and last region of a task always stay, so that a region cut in two is whole again when grouped.
    """
    width, prefix = 4 * depth, 4 * least
    labels = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.expr("signature").substr(t * width + 1, F.lit(width)))
    rows = classes.select("rep", F.posexplode(labels).alias("tree", "label"))
    by_label = rows.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        first = True

        def emit(frame: pd.DataFrame, *, whole: bool, keep_first: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
            """Rows whose region is complete, and the rows of the last region unless ``whole``."""
            tree, reps = frame["tree"].to_numpy(), frame["rep"].to_numpy()
            # One more byte, as numpy's byte strings drop zeros at their end.
            marks = np.array([bytes(x[:prefix]) + b"\x01" for x in frame["label"]], dtype=f"S{prefix + 1}")
            new = np.concatenate(([True], (marks[1:] != marks[:-1]) | (tree[1:] != tree[:-1])))
            region = np.cumsum(new) - 1
            size = np.bincount(region)[region]
            stay = size > 1
            if keep_first:
                stay |= region == 0
            if whole:
                stay |= region == region[-1]
            done = np.ones(len(frame), bool) if whole else region < region[-1]
            following = [
                [int(reps[i + k]) for k in range(1, near + 1) if i + k < len(reps) and region[i + k] == region[i]] for i in np.flatnonzero(stay & done)
            ]
            part = frame[stay & done]
            out = pd.DataFrame(
                {"tree": part["tree"].astype("int32"), "region": [bytes(x[:prefix]) for x in part["label"]], "rep": part["rep"], "next": following}
            )
            return out, None if whole else frame[~done]

        for batch in batches:
            frame = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
            if not len(frame):
                continue
            out, held = emit(frame, whole=False, keep_first=first)
            first = first and not len(out) and len(held) == len(frame)
            if len(out):
                yield out
        if held is not None and len(held):
            yield emit(held, whole=True, keep_first=first)[0]

    return by_label.mapInPandas(neighbours, "tree int, region binary, rep long, next array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, *, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b, in_a, in_b) those whose whole shingle sets have 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = zip(shingle_sets(batch["text_a"].tolist(), size), shingle_sets(batch["text_b"].tolist(), size), strict=True)
            good = []
            for x, y in sets:
                low, high = sorted((len(x), len(y)))
                if 100 * low < percent * high:
                    good.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield batch.loc[good, ["a", "b", "in_a", "in_b"]]

    # Always shuffled by id, at any size, so that the plan that was measured on little data is the one that runs on much.
    at_a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")).hint("merge")
    at_b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")).hint("merge")
    return pairs.join(at_a, "a").join(at_b, "b").mapInPandas(confirm, "a long, b long, in_a long, in_b long")


def _cells(texts: DataFrame, size: int) -> DataFrame:
    """(rep, size, cells): the hashed shingle set of each text."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = [s.view(np.int64) for s in shingle_sets(batch["text"].tolist(), size)]
            yield pd.DataFrame({"rep": batch["rep"], "size": [len(c) for c in cells], "cells": cells})

    return texts.select("rep", "text").mapInPandas(sets, "rep long, size long, cells array<long>")


def common_cells(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``one`` shares with each of ``two``, by products of 0-1 matrices of some columns at a time."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (one, two)]
    known = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(one), len(two)), np.float32)
    at = []
    for (cells, owner), rows in zip(sides, (len(one), len(two)), strict=True):
        spot = np.searchsorted(known, cells)
        spot[spot == len(known)] = 0
        held = known[spot] == cells if len(known) else np.zeros(len(cells), bool)
        order = np.argsort(spot[held], kind="stable")
        at.append((spot[held][order], owner[held][order], rows))
    for low in range(0, len(known), COLUMNS):
        width = min(COLUMNS, len(known) - low)
        ones = []
        for spot, owner, rows in at:
            part = slice(*np.searchsorted(spot, (low, low + width)))
            ones.append(np.zeros((rows, width), np.float32))
            ones[-1][owner[part], spot[part] - low] = 1
        out += ones[0] @ ones[1].T
    return out


def _met(at_region: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components: all pairs of rows (tree, region, rep, component) that share a region but not a component
    are compared on their whole sets (rep, size, cells).

    The rows of a region's largest component need not meet each other, only the rest of the region, and the rest itself. Both
    are dealt into blocks of bounded size by a hash; a task gets two blocks, and returns no more links than it has rows."""
    sized = at_region.join(sets.select("rep", "size").hint("merge"), "rep")
    each = sized.groupBy("tree", "region", "component").agg(F.count("*").alias("n"), F.sum("size").alias("cells"))
    whole = each.groupBy("tree", "region").agg(
        F.max(F.struct("n", "cells", "component")).alias("most"), F.sum("n").alias("n"), F.sum("cells").alias("cells")
    )
    blocks = lambda n, cells: F.greatest(F.ceil(n / SIDE), F.ceil(cells / SIDE_CELLS))
    dealt = whole.select(
        "tree", "region", F.col("most.component").alias("largest"), blocks(F.col("most.n"), F.col("most.cells")).alias("large"),
        blocks(F.col("n") - F.col("most.n"), F.col("cells") - F.col("most.cells")).alias("rest"),
    )
    apart = F.col("component") != F.col("largest")
    own = F.when(apart, F.pmod(F.xxhash64("rep"), "rest")).otherwise(F.col("rest") + F.pmod(F.xxhash64("rep"), "large"))
    others = F.sequence(F.lit(0).cast("long"), F.col("rest") - 1 + F.when(apart, F.col("large")).otherwise(0))
    rows = at_region.join(dealt.hint("merge"), ["tree", "region"]).select("tree", "region", "rep", "component", own.alias("own"), F.explode(others).alias("other"))
    rows = rows.select("tree", "region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        in_one, in_two = group["own"] == group["i"], group["own"] == group["j"]
        sides = [(side["component"].to_numpy(), side["cells"].tolist()) for side in (group[in_one], group[in_two])]
        if not all(len(c) for c, _ in sides):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        (here, one), (there, two) = sides
        common = common_cells(one, two)
        union = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two])[None, :] - common
        linked = np.argwhere((100 * common.astype(np.float64) >= percent * union) & (here[:, None] != there[None, :]))
        names, place = np.unique(np.concatenate((here, there)), return_inverse=True)
        near = np.stack((place[linked[:, 0]], place[len(here) + linked[:, 1]]), axis=1)
        root = roots_of_links(near, len(names))
        moved = root != np.arange(len(names))
        return pd.DataFrame({"a": names[moved], "b": names[root[moved]]})

    return rows.join(sets.select("rep", "cells").hint("merge"), "rep").groupBy("tree", "region", "i", "j").applyInPandas(compare, "a long, b long")


def _in_order(rows: DataFrame) -> DataFrame:
    """The distinct pairs of (rep, here) and (other, there), the smaller id first."""
    swap = F.col("rep") > F.col("other")
    one, two = F.struct("rep", "here"), F.struct(F.col("other").alias("rep"), F.col("there").alias("here"))
    return rows.select(F.when(swap, two).otherwise(one).alias("x"), F.when(swap, one).otherwise(two).alias("y")).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.here").alias("in_a"), F.col("y.here").alias("in_b")
    ).distinct()


def near_dedup(
    docs: DataFrame,
    *,
    size: int = 5,
    percent: int = 80,
    trees: int = 20,
    depth: int = 8,
    least: int = 4,
    near: int = 10,
    first_trees: int = 4,
    seed: int = 43,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets form a class; the class, by its smallest id, goes through the forest. Each of
    ``trees`` trees orders the classes by a label of ``depth`` MinHash values. Candidates are the next rows in that
    order, those with the longest common prefix: in a crowded region neighbours agree on the whole label, in a sparse
    one on ``least`` values at least, so the depth that decides adapts to the region. A few trees come first; what
    they link need not be compared again, so all trees together then only bring pairs across components: neighbours,
    and each class with its region's hub, the class with most links so far, for a base text whose many copies are
    further from each other than from it. A region of more rows than neighbours are looked at, in which several components
    are left, is compared throughout, but for the rows of its largest component among themselves: blocks of full sets meet in
    tasks of bounded size. So all rows that share a region are linked as they should be, and no link is wrong. What that
    costs grows with the rows of a region times those of them that are not in its largest component.

    Defined results: null and empty texts have no shingle and link with nothing; a null id is left out of links and is
    its own (null) component; rows that repeat an id are one document of several texts, and those that repeat a text are
    linked as equal sets; of a component the smallest id stays; an empty table gives an empty result; other columns are
    ignored. A very long text is hashed in one task, in memory of some 40 bytes for each of its bytes; nothing is cut off.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    sketched = stored(_sketch(rows, size=size, trees=trees, depth=depth, seed=seed))
    usable = sketched.filter("doc_id IS NOT NULL AND signature IS NOT NULL")
    reps = stored(usable.groupBy("digest", "signature").agg(F.min("doc_id").alias("rep")))
    forest = stored(_forest(reps, trees=trees, depth=depth, least=least, near=near))
    involved = forest.select("rep").distinct()
    texts = stored(rows.withColumnRenamed("doc_id", "rep").join(involved.hint("merge"), "rep", "left_semi"))

    nearest = forest.filter((F.col("tree") < first_trees) & (F.size("next") > 0)).select("rep", F.element_at("next", 1).alias("other"))
    pairs = _in_order(nearest.select("rep", "other", F.col("rep").alias("here"), F.col("other").alias("there")))
    links = cut(_verified(pairs, texts, size=size, percent=percent))
    first = connected_components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    place = cut(first.join(degree.hint("merge"), "node"))
    here = place.select(F.col("node").alias("rep"), F.col("component").alias("here"), "degree")
    located = forest.join(here.hint("merge"), "rep", "left").withColumn("here", F.coalesce("here", "rep")).withColumn("degree", F.coalesce("degree", F.lit(0)))
    located = stored(located)
    hubs = (
        located.groupBy("tree", "region")
        .agg(F.max_by("rep", F.struct("degree", (-F.col("rep")).alias("first"))).alias("hub"), F.min("here").alias("low"), F.max("here").alias("high"))
        .filter("low <> high")
        .select("tree", "region", "hub")
    )
    others = F.explode(F.array_union("next", F.filter(F.array("hub"), lambda x: x.isNotNull())))
    there = place.select(F.col("node").alias("other"), F.col("component").alias("there"))
    found = located.join(hubs.hint("merge"), ["tree", "region"], "left").select("rep", "here", others.alias("other")).join(there.hint("merge"), "other", "left")
    found = found.withColumn("there", F.coalesce("there", "other")).filter("here <> there")
    across = cut(_verified(_in_order(found), texts, size=size, percent=percent))
    second = connected_components(across.select(F.col("in_a").alias("a"), F.col("in_b").alias("b")))
    merged = second.select(F.col("node").alias("here"), F.col("component").alias("whole")).hint("merge")
    at_region = located.select("tree", "region", "rep", "here").join(merged, "here", "left").select("tree", "region", "rep", F.coalesce("whole", "here").alias("component"))
    crowds = at_region.groupBy("tree", "region").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    crowds = crowds.filter((F.col("n") > near + 1) & (F.col("low") != F.col("high"))).select("tree", "region")
    crowd = cut(at_region.join(crowds.hint("merge"), ["tree", "region"]))
    sets = stored(_cells(texts.join(crowd.select("rep").distinct().hint("merge"), "rep"), size))
    third = connected_components(_met(crowd, sets, percent))
    placed = reps.select("digest", "rep").join(first.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("at", F.coalesce("component", "rep"))
    for later in (second, third):
        moved = later.select(F.col("node").alias("at"), F.col("component").alias("whole")).hint("merge")
        placed = placed.select("digest", "at").join(moved, "at", "left").select("digest", F.coalesce("whole", "at").alias("at"))
    by_class = placed.select("digest", F.col("at").alias("component_id"))
    ids = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    placed = ids.join(by_class.hint("merge"), "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return placed.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

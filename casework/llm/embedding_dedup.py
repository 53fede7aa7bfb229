"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.llm.common import cut
from casework.llm.components import connected_components

_SIDE = 512  # rows of a block of the cosine matrix


def usable(column: Column) -> Column:
    """Vectors that can link: no null or non-finite component, and not all zero."""
    x = column.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    return x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)


def tables_needed(cosine: float, bits: int, recall: float) -> int:
    """Tables of ``bits`` signs with which a pair at the threshold shares a bucket with probability ``recall``."""
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(b, "<f8") for b in blobs])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signs(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """Per row and table the signs as one integer. Rows of a bucket get equal codes whatever the batch: one product per block."""
    on = (x @ _planes(x.shape[1], tables, bits, seed)) > 0
    return (on.reshape(len(x), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def roots_of_links(near: np.ndarray, count: int) -> np.ndarray:
    """For links as pairs of row numbers, the first row of each row's component: least neighbours until nothing changes."""
    root = np.arange(count)
    while len(near):
        before = root.copy()
        np.minimum.at(root, near[:, 0], root[near[:, 1]])
        np.minimum.at(root, near[:, 1], root[near[:, 0]])
        root = root[root]
        if (root == before).all():
            break
    return root


def _bucket_links(ids: np.ndarray, members: np.ndarray, left: np.ndarray, x: np.ndarray, codes: np.ndarray, table: int, split: bool, cosine: float) -> pd.DataFrame | None:
    """What the links of one bucket, found in blocks, come to: for each of its rows (a) a row (b) that stands for its component
    here, and the members that it links with (far). A pair counts in the first table that has it together, so it counts once;
    so many rows come out as went in, however many pairs are alike."""
    first, second = (np.flatnonzero(left), np.flatnonzero(~left)) if split else (np.arange(len(ids)),) * 2
    far, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i in range(0, len(first), _SIDE):
        for j in range(0 if split else i, len(second), _SIDE):
            p, q = first[i : i + _SIDE], second[j : j + _SIDE]
            a, b = np.nonzero(x[p] @ x[q].T >= cosine - 1e-9)
            a, b = p[a], q[b]
            if not split:
                a, b = a[a < b], b[a < b]
            good = np.flatnonzero((codes[a, :table] != codes[b, :table]).all(1))
            for at in range(0, len(good), 1 << 14):
                u, v = a[good[at : at + (1 << 14)]], b[good[at : at + (1 << 14)]]
                exact = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                u, v = u[exact], v[exact]
                np.add.at(far, u, members[v])
                np.add.at(far, v, members[u])
                root = roots_of_links(np.stack((root[u], root[v]), 1), len(ids))[root]
    some = np.flatnonzero(far)
    if not len(some):
        return None
    return pd.DataFrame({"a": ids[some], "b": ids[root[some]], "far": far[some]})


def _links(rows: DataFrame, *, cosine: float, tables: int, bits: int, seed: int, bucket: int) -> DataFrame:
    """Rows (a, b, far) from rows (rep, blob, members): the members of all classes that ``a`` links with in one bucket, and
    a class ``b`` that stands there for its component. Each pair with the cosine or more that shares a bucket counts once."""

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["blob"].str.len(), sort=False):
                for at in range(0, len(part), 1024):
                    some = part.iloc[at : at + 1024]
                    signs = _signs(_unit(some["blob"].tolist()), tables, bits, seed)
                    yield pd.DataFrame({"rep": some["rep"].to_numpy(), "blob": some["blob"].to_numpy(), "members": some["members"].to_numpy(), "codes": [c.tobytes() for c in signs], "code": list(signs)})

    coded = cut(rows.mapInPandas(codes, "rep long, blob binary, members long, codes binary, code array<long>"))
    keys = coded.select("rep", F.length("blob").alias("width"), F.posexplode("code").alias("table", "code"))
    counted = keys.groupBy("width", "table", "code").agg(F.count("*").alias("n")).filter("n > 1")
    in_buckets = cut(keys.join(counted, ["width", "table", "code"]))
    # A bucket of more than ``bucket`` rows is dealt as pairs of its blocks, so no task holds it whole.
    blocks = F.ceil(F.col("n") / F.lit(float(bucket))).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = (
        in_buckets.select("rep", "width", "table", "code", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("rep", "width", "table", "code", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("left"))
        .join(coded.select("rep", "blob", "members", "codes"), "rep")
    )
    keyed = dealt.repartition("table", "code", "width", "low", "high").sortWithinPartitions("table", "code", "width", "low", "high", "rep")
    by = ["table", "code", "width", "low", "high"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def complete(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """Links of whole buckets; arrays are made once for all rows of a width, buckets are slices of them."""
            for _, part in frame.groupby("width", sort=False):
                ids, members, left, table = part["rep"].to_numpy(), part["members"].to_numpy(), part["left"].to_numpy(bool), part["table"].to_numpy()
                x, codes = _unit(part["blob"].tolist()), np.stack([np.frombuffer(c, np.int64) for c in part["codes"]])
                split, marks = part["low"].to_numpy() != part["high"].to_numpy(), part[by].to_numpy()
                cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
                for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                    if stop - start > 1:
                        own = slice(start, stop)
                        found = _bucket_links(ids[own], members[own], left[own], x[own], codes[own], int(table[start]), bool(split[start]), cosine)
                        if found is not None:
                            yield found

        held: pd.DataFrame | None = None
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(frame):
                marks = frame[by].to_numpy()
                last = int(np.flatnonzero((marks != marks[-1]).any(1))[-1]) + 1 if (marks != marks[-1]).any() else 0
                yield from complete(frame.iloc[:last])
                held = frame.iloc[last:]
        if held is not None:
            yield from complete(held)

    return keyed.mapInPandas(search, "a long, b long, far long")


def embedding_dedup(
    vectors: DataFrame,
    *,
    cosine: float = 0.95,
    bits: int | None = None,
    recall: float = 0.9999,
    seed: int = 29,
    bucket: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors form a class first, so a vector repeated a million times is compared once; members link with each
    other and share the links of their class. Classes meet in the buckets of several tables of random-hyperplane
    signs, as many tables as give a pair at the threshold the asked recall (closer pairs have more), and each pair
    that meets is decided by its cosine in double precision. Links below the threshold never count. ``bits`` follow
    log2 of the counted classes less 4, so that buckets do not grow with the table; buckets that are crowded all the same
    are dealt in blocks. A bucket returns one row per class, link counts and a spanning set of links, not its pairs.

    Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing,
    also not with its like; vectors of different lengths do not link; rows with a null id are left out of links and
    are their own component (null); rows that repeat an id and a vector are counted as one vector each; a cosine
    at the threshold links; of a component the smallest id stays; an empty table gives an empty result; labels and other
    columns are ignored. A very long vector is a row like any other, held whole by the task of each of its buckets.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    usable_rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("x")))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # adding 0.0 makes -0.0 and 0.0 the same bytes
            yield pd.DataFrame({"vec_id": batch["vec_id"], "blob": [(np.asarray(v, "<f8") + 0.0).tobytes() for v in batch["x"]]})

    packed = cut(usable_rows.mapInPandas(pack, "vec_id long, blob binary"))
    classes = cut(packed.groupBy("blob").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members")))
    if bits is None:
        bits = max(8, classes.count().bit_length() - 4)
    met = cut(_links(classes.select("rep", "blob", "members"), cosine=cosine, tables=tables_needed(cosine, bits, recall), bits=bits, seed=seed, bucket=bucket))
    far = met.groupBy(F.col("a").alias("rep")).agg(F.sum("far").alias("far"))
    placed = connected_components(met.select("a", "b")).withColumnRenamed("node", "rep")
    known = classes.join(far, "rep", "left").join(placed, "rep", "left").select(
        "blob", (F.col("members") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = packed.join(known, "blob").select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.col("vec_id").isNull() | ~usable(F.col("x"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

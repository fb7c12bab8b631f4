"""Near-duplicate vectors by random-hyperplane sign hashing in several tables, exact cosine verification and connected components.

Two vectors at the threshold angle agree in one sign with probability 1 - angle / pi, so in a table of ``bits`` signs with that to the power of
``bits``; the number of tables follows from the wanted chance that at least one of them brings a linked pair together.  Bits grow with the
logarithm of the number of vectors, which keeps the expected size of a bucket of unrelated vectors constant.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labels, pairs, saved, whole_groups
from .components import components

THRESHOLD = 0.93
RECALL = 0.999
#: Larger buckets are dealt out in pairs of blocks of about half this size.
BUCKET = 4096


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables of ``bits`` signs that bring a pair at ``threshold`` together with probability ``recall`` or more."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def hyperplanes(dim: int, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _codes(vectors: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """One integer per vector and table."""
    signs = (vectors @ planes > 0).reshape(len(vectors), -1, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / largest
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _by_dimension(vectors: pa.Array, sizes: np.ndarray):
    for dim in np.unique(sizes):
        where = np.flatnonzero(sizes == dim)
        yield int(dim), where, _matrix(vectors.take(pa.array(where)))


def _file(bits: int, tables: int):
    """(id, vector) -> one signature per table."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                sizes = batch.column("vector").value_lengths().to_numpy()
                out = np.empty((batch.num_rows, tables), np.int64)
                for dim, where, vectors in _by_dimension(batch.column("vector"), sizes):
                    out[where] = _codes(_unit(vectors), hyperplanes(dim, bits, tables), bits)
                offsets = np.arange(0, out.size + 1, tables, dtype=np.int32)
                codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, "codes"])

    return scan


def _verified(unit: np.ndarray, keys: np.ndarray, block: np.ndarray, cross: np.ndarray, threshold: float):
    """Positions of pairs in one bucket whose cosine reaches the threshold."""
    sizes = np.searchsorted(keys, keys, "right") - np.searchsorted(keys, keys, "left")
    small = np.flatnonzero(sizes <= 64)
    for left, right in pairs(keys[small], 100_000):
        a, b = small[left], small[right]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        near &= ~cross[a] | (block[a] != block[b])
        yield a[near], b[near]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    for start in starts[sizes[starts] > 64]:
        end = start + sizes[start]
        for i in range(start, end, 1024):
            for j in range(i, end, 1024):
                product = unit[i : min(i + 1024, end)] @ unit[j : min(j + 1024, end)].T
                a, b = np.nonzero(product >= threshold - 1e-9)
                value = product[a, b]
                a, b = a + i, b + j
                # close to the threshold the same sum decides as in small buckets
                close = np.flatnonzero(np.abs(value - threshold) <= 1e-9)
                value[close] = np.einsum("ij,ij->i", unit[a[close]], unit[b[close]])
                a, b = a[value >= threshold], b[value >= threshold]
                keep = (a < b) & (~cross[a] | (block[a] != block[b]))
                yield a[keep], b[keep]


def _search(bits: int, tables: int, threshold: float):
    """Rows sorted by bucket -> per vector the copies it gains as links here, and a vector of the same component.

    A pair counts in the first table that brings it together, so that no pair counts twice.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket", 20_000):
            ids, copies, stage = (table[c].to_numpy() for c in ("rep", "copies", "tab"))
            column = table["vector"].combine_chunks()
            gained, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for dim, where, vectors in _by_dimension(column, column.value_lengths().to_numpy()):
                unit = _unit(vectors)
                planes = hyperplanes(dim, bits, tables)
                keys, block, cross = (table[c].to_numpy()[where] for c in ("bucket", "block", "cross"))
                for a, b in _verified(unit, keys, block, cross, threshold):
                    if not len(a):
                        continue
                    used, slot = np.unique(np.r_[a, b], return_inverse=True)
                    codes = np.concatenate([_codes(unit[used[i : i + 4096]], planes, bits) for i in range(0, len(used), 4096)])
                    first = np.empty(len(a), bool)
                    for i in range(0, len(a), 50_000):
                        part = slice(i, i + 50_000)
                        same = codes[slot[: len(a)][part]] == codes[slot[len(a) :][part]]
                        first[part] = same.argmax(1) == stage[where[a[part]]]
                    a, b = where[a[first]], where[b[first]]
                    np.add.at(gained, a, copies[b])
                    np.add.at(gained, b, copies[a])
                    root = labels(len(ids), a, b, start=root)
            hit = np.flatnonzero(gained)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(gained[hit]), pa.array(ids[root[hit]])], ["rep", "gained", "root"])

    return scan


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label, any other columns).

    Vectors are compared only within equal non-null labels and equal lengths.  Those that are null, empty, zero or hold null or non-finite
    components, and rows with a null vec_id, link with nothing: 0 links, their own component, kept (a null vec_id gives a null component and
    kept true).  Equal vectors are collapsed first and count as links of each other; a repeated vec_id counts as another vector.  No row gives
    no row.
    """
    doubles = F.col("embedding").cast("array<double>")
    largest = F.array_max(F.transform(doubles, F.abs))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (largest > 0) & ~F.isnan(largest) & (largest < float("inf")) & ~F.exists("embedding", lambda x: x.isNull())
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), doubles.alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound"))
    usable = rows.where("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # a vec_id may be repeated with other vectors, so the collapsed vector has an identity of its own
    usable = saved(usable.withColumn("rep", F.xxhash64("label", "vector", "rep")))
    bits = max(12, math.ceil(math.log2(usable.count() + 1)))
    tables = tables_for(threshold, bits, recall)
    signed = saved(usable.mapInArrow(_file(bits, tables), "label string, vector array<double>, rep long, copies long, codes array<long>"))
    key = F.xxhash64("label", F.size("vector"), "tab", "code").alias("bucket")
    filed = signed.select("label", "vector", "rep", F.posexplode("codes").alias("tab", "code")).select(key, "rep", "tab")
    sizes = filed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.when(F.col("size") > bucket, F.ceil(F.col("size") / (bucket // 2))).otherwise(F.lit(1).cast("long"))
    met = filed.join(sizes.select("bucket", blocks.alias("blocks")), "bucket")
    dealt = (
        met.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("cross", F.col("block") != F.col("other"))
        .withColumn("bucket", F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))))
        .join(signed.select("rep", "copies", "vector"), "rep")
    )
    near = saved(
        dealt.select("bucket", "rep", "copies", "tab", "block", "cross", "vector")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_search(bits, tables, threshold), "rep long, gained long, root long")
    )
    gained = near.groupBy("rep").agg(F.sum("gained").alias("gained"))
    found = components(near.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    sums = usable.join(gained, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    sums = sums.select("label", "vector", (F.coalesce("gained", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    named = saved(rows.where("sound").join(sums, ["label", "vector"]).select("vec_id", "n_links", "root"))
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = named.join(least, "root").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

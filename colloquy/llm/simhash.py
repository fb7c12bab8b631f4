"""SimHash near-duplicates of documents by multi-index hashing.

The fingerprint of a text is the bitwise majority of the XXH64 hashes of its word shingles.  Two distinct fingerprints that differ in at most
``2 * segments * radius + segments - 1`` bits agree, in some segment, up to ``2 * radius`` bits; each fingerprint is therefore filed in a table
per segment under every value of a Hamming ball of ``radius`` around that segment (both sides enumerate half the distance and meet in the
middle), matches are fetched by sorting on the table key and complete distances are verified.  With 64 bits, 2 segments and radius 1 that
finds every pair at distance 4 or less (5 even) from 66 table rows a fingerprint, and nothing else than a match by accident or by nearness
shares a key of 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, labels, map_arrow, pairs, saved, texts, whole, whole_groups
from .components import components
from .jaccard import bands, content, joined, minima, shingle_set

SEED = 42
DISTANCE = 4
#: Groups above this size are searched by growing a component instead of by listing pairs.
DENSE = 512
#: Table keys with more fingerprints than this are dealt out as pairs of blocks of half as many.
HOT = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of ``text``: words split at ASCII white space, A-Z lower-cased, shingles of ``width`` words, repeats included.

    Fewer words than ``width`` make one shingle; no word (or null) gives 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint long) for every row of ``docs``; the long holds the 64 bits, signed."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, width) for _, part in texts(batch) for t in part), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, "doc_id long, fingerprint long")


def _grow(values: np.ndarray, distance: int) -> np.ndarray:
    """Component labels of one group, by breadth-first growth.  In a dense group the first steps take nearly all of it, so few comparisons remain."""
    out = np.arange(len(values))
    rest = np.arange(len(values))
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(values[rest] ^ values[queue.pop()]) <= distance
            if near.any():
                taken = rest[near]
                out[taken] = root
                queue.extend(taken.tolist())
                rest = rest[~near]
    return out


def _links(distance: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            keys = table["key"].to_numpy()
            values = table["fingerprint"].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            found = np.arange(len(keys))
            for at in np.flatnonzero(sizes > DENSE):
                span = slice(starts[at], starts[at] + sizes[at])
                found[span] = starts[at] + _grow(values[span], distance)
            small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= DENSE), sizes))
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in pairs(keys[small]):
                near = np.bitwise_count(values[small[a]] ^ values[small[b]]) <= distance
                ends.append((small[a[near]], small[b[near]]))
            if ends:
                found = labels(len(keys), *(np.concatenate(x) for x in zip(*ends)), start=found)
            linked = np.flatnonzero(found != np.arange(len(keys)))
            edges = np.unique(np.stack([values[linked], values[found[linked]]], 1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["u", "v"])

    return scan


def near_fingerprints(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose closure joins exactly those connected by steps of ``distance`` bits or fewer.

    Each table bucket yields a forest of its matches, not all their pairs; one of more than ``HOT`` fingerprints is searched in several tasks.
    """
    if distance > 5:
        raise ValueError("two segments with radius 1 on either side cover up to 5 differing bits")
    half = F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF))
    other = F.shiftrightunsigned("fingerprint", 32)
    ball = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << j for j in range(32)))])
    probes = F.concat(
        F.transform(ball, lambda m: half.bitwiseXOR(m)),
        F.transform(ball, lambda m: other.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32))),
    )
    filed = distinct.select(F.explode(probes).alias("key"), "fingerprint")
    halves = distinct.select(F.explode(F.array(half, other.bitwiseOR(F.lit(1 << 32)))).alias("half")).groupBy("half").agg(F.count("*").alias("n"))
    # a key's bucket is made of 33 halves, so where it is large one of them is
    large = saved(halves.where(F.col("n") > HOT / 33).select("half"))
    if large.limit(1).count():
        filed = _split(filed, large.select(F.explode(F.transform(ball, lambda m: F.col("half").bitwiseXOR(m))).alias("key")).distinct())
    return map_arrow(filed.repartition("key").sortWithinPartitions("key"), _links(distance), "u long, v long").distinct()


def _split(filed: DataFrame, suspects: DataFrame) -> DataFrame:
    """``filed`` (key, fingerprint) in which each pair of blocks of a hot key has a key of its own; only ``suspects`` can be hot."""
    sizes = filed.join(suspects, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    blocks = F.coalesce(F.ceil(F.col("n") / (HOT / 2)), F.lit(1))
    dealt = filed.join(saved(sizes), "key", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fingerprint"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(cell).alias("key"), "fingerprint")


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fingerprint, content, n, keys, sketch) for every row of ``docs``: what :func:`jaccard.joined` files texts by, beside the fingerprint."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in texts(batch):
                sets = [shingle_set(t) for t in part]
                least = [minima(s) for s in sets]
                columns = [
                    batch.column(0).slice(at, len(part)),
                    pa.array(np.fromiter((fingerprint(t, width) for t in part), np.uint64, len(part)).view(np.int64)),
                    pa.array(map(content, sets), pa.int64()),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([bands(m) if len(s) else [] for s, m in zip(sets, least)], pa.list_(pa.int64())),
                    pa.array([m.astype(np.uint8).tobytes() for m in least], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "content", "n", "keys", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, "doc_id long, fingerprint long, content long, n long, keys array<long>, sketch binary")


def _grouped(docs: DataFrame, distance: int, width: int, similar: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fingerprint) of every row, and (fingerprint, root, component_id) of every fingerprint; root names the group, whatever its ids.

    With ``similar`` groups are joined further by the similarity of their texts; see :func:`jaccard.joined`.
    """
    prints = saved(fingerprints(docs, width) if similar is None else _profiles(docs, width))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    found = components(near_fingerprints(distinct.select("fingerprint"), distance))
    rooted = distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    if similar is not None:
        roots = saved(rooted.select(F.col("fingerprint").alias("node"), "root"))
        filed = saved(prints.withColumnRenamed("fingerprint", "node").dropDuplicates(["node", "content"]))
        wider = joined(filed, docs, roots, similar)
        forget(filed, roots)
        rooted = distinct.join(wider.withColumnRenamed("node", "fingerprint"), "fingerprint")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, saved(rooted.join(named, "root").select("fingerprint", "root", "component_id"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of ``docs`` (doc_id, text, any other columns).

    component_id is the smallest doc_id reachable by links, itself included.  Equal fingerprints are collapsed before the search, so copies
    cost one row however many there are.  Null and empty texts have fingerprint 0 and are linked like any other; rows with a null doc_id take
    part and get the component's smallest non-null doc_id, null if there is none; repeated rows stay repeated; no row gives no row.
    """
    prints, groups = _grouped(docs, distance, width)
    return prints.join(groups, "fingerprint").select("doc_id", "fingerprint", "component_id")


def deduplicated(docs: DataFrame, distance: int = DISTANCE, width: int = 4, similar: float | None = None) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one whose doc_id names the group; of rows with that id, one of each group.

    Of a group all of whose ids are null one row stays, the one with the smallest text.  Null and empty texts are one group.  No row gives no row.  With ``similar`` texts whose sets of five-word shingles
    have that Jaccard similarity or more are near-duplicates too.
    """
    prints, groups = _grouped(docs, distance, width, similar)
    found = saved(prints.where("doc_id is not null").join(groups, "fingerprint").where("doc_id = component_id").select("doc_id", "fingerprint", "root").distinct())
    rows = prints.groupBy("doc_id").agg(F.count("*").alias("n"))
    # the ids grow with the documents: joined by sorting at every size, never by sending them to all executors
    kept = saved(found.select("doc_id").distinct().join(rows.hint("merge"), "doc_id")).hint("merge")
    kept_rows = docs.select("doc_id", whole(docs))
    once = kept_rows.join(kept.where("n = 1"), "doc_id", "left_semi").select("row__.*")
    # where an id is repeated its rows may be of several groups
    again = kept_rows.join(kept.where("n > 1"), "doc_id", "left_semi").withColumn("text", F.col("row__.text"))
    again = _first(_with_fingerprint(again, width).join(found, ["doc_id", "fingerprint"]), "root")
    nameless = docs.where("doc_id is null").select("doc_id", "text", whole(docs))
    nameless = _first(_with_fingerprint(nameless, width).join(groups.where("component_id is null").drop("component_id"), "fingerprint"), "root")
    return once.unionByName(again).unionByName(nameless)


def _first(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(key).orderBy("text"))).where("rank__ = 1").select("row__.*")


def _with_fingerprint(docs: DataFrame, width: int) -> DataFrame:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, width) for _, part in texts(batch) for t in part), np.uint64, batch.num_rows)
            yield batch.append_column("fingerprint", pa.array(values.view(np.int64)))

    return map_arrow(docs, scan, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.LongType())]))

"""Pairs of texts whose sets of word shingles are alike, by MinHash bands and exact verification.

A text is filed under ``BANDS`` keys, each of ``ROWS`` minima over its set of shingles, so a pair at Jaccard similarity s shares a key with
probability 1 - (1 - s^ROWS)^BANDS: at 0.8 three pairs in a million are missed, above it fewer.  All pairs of a key that lie in different groups
are compared, first by how many of all minima they have in common, which rules out pairs far below the threshold (it misses one in a million at
it), then, in the first key that they share, on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, saved, texts, whole_groups
from .components import components

BANDS, ROWS = 32, 5
SIMILAR, WIDTH = 0.8, 5
SEED = 43
#: Keys with more texts than this are dealt out as pairs of blocks of half as many.
HOT = 4096
#: Shingles of the texts that are verified together, but for the last text: 32 MB.
TOGETHER = 1 << 22
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the shingles of ``width`` words, words as in :func:`simhash.fingerprint`; fewer words make one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(width, len(words)) - 1 :].tolist())), np.uint64))


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * _MULTIPLIERS).min(0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def content(shingles: np.ndarray) -> int:
    """Names a set of shingles, so that equal ones are filed and fetched once."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(content, shingles) of the documents whose doc_id is ``wanted``, each set once."""

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in texts(batch):
                sets = [shingle_set(t) for t in part]
                yield pa.RecordBatch.from_arrays([pa.array(map(content, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["content", "shingles"])

    ids = wanted.select(F.col("doc_id").alias("wanted__")).distinct().hint("merge")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted__")), "left_semi")
    return saved(map_arrow(found.select("text"), named, "content long, shingles array<long>").dropDuplicates(["content"]))


def _verified(pairs: DataFrame, docs: DataFrame, similar: float) -> DataFrame:
    """(u, v) nodes of those (node, content, doc_id, other, other_content, other_id) whose sets are ``similar`` or more."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            alike = [similarity(left[i].values.to_numpy(), right[i].values.to_numpy()) >= similar for i in range(batch.num_rows)]
            yield batch.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    sets = _sets(docs, pairs.select("doc_id").union(pairs.select("other_id")))
    theirs = sets.select(F.col("content").alias("other_content"), F.col("shingles").alias("b"))
    both = pairs.join(sets.withColumnRenamed("shingles", "a"), "content").join(theirs, "other_content")
    edges = saved(map_arrow(both.select(F.col("node").alias("u"), F.col("other").alias("v"), "a", "b"), scan, "u long, v long").distinct())
    forget(sets)
    return edges


def _grown(roots: DataFrame, found: DataFrame, edges: DataFrame) -> DataFrame:
    grown = components(edges.union(found.select("node", "root")))
    return saved(roots.select("node").join(grown, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def _keyed(filed: DataFrame, found: DataFrame) -> DataFrame:
    return filed.join(found, "node").select("node", "content", "doc_id", "root", F.posexplode("keys").alias("band", "key"))


def _with_the_first(filed: DataFrame, found: DataFrame) -> DataFrame:
    """(node, content, doc_id, other, other_content, other_id): each text of a key of more than ``HOT`` texts beside the key's least, where these
    are in different groups, so a key of m texts gives m pairs."""
    keyed = _keyed(filed, found)
    hot = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "content", "root", "doc_id")).alias("first"), F.min("root").alias("low"), F.max("root").alias("high")).where((F.col("n") > HOT) & (F.col("low") != F.col("high")))
    near = keyed.join(hot.select("key", "first"), "key").where("root <> first.root")
    return near.select("node", "content", "doc_id", F.col("first.node").alias("other"), F.col("first.content").alias("other_content"), F.col("first.doc_id").alias("other_id")).distinct()


def _cells(filed: DataFrame, found: DataFrame) -> DataFrame:
    """(cell, bulk, band, node, content, root, doc_id, n, keys, sketch): the texts of each key that holds several groups, so that every two of them in
    different groups share a cell.

    A key of more than ``HOT`` texts is dealt out in blocks: those of its largest group (``bulk``), which need not meet each other, meet each block
    of the rest, and the blocks of the rest meet in pairs.
    """
    keyed = _keyed(filed, found)
    groups = keyed.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = groups.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    hot = F.col("all") > HOT
    large = F.when(hot, F.ceil(F.col("most.n") / (HOT / 2))).otherwise(0)
    small = F.when(hot, F.ceil((F.col("all") - F.col("most.n")) / (HOT / 2))).otherwise(1)
    sizes = sizes.select("key", hot.alias("hot"), large.alias("large"), small.alias("small"), F.col("most.root").alias("bulk_root"))
    bulk = F.col("hot") & (F.col("root") == F.col("bulk_root"))
    dealt = keyed.join(sizes, "key").withColumn("bulk", bulk).withColumn("block", F.pmod(F.xxhash64("node", "content"), F.when(F.col("bulk"), F.col("large")).otherwise(F.col("small"))))
    rest = F.sequence(F.lit(0).cast("long"), F.col("small") - 1)
    with_bulk = F.transform(F.sequence(F.lit(1).cast("long"), F.col("large")), lambda b: F.struct((-b).alias("a"), F.col("block").alias("b")))
    with_rest = F.transform(rest, lambda k: F.struct(F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b")))
    of_bulk = F.transform(rest, lambda k: F.struct((-F.col("block") - 1).alias("a"), k.alias("b")))
    places = F.when(F.col("bulk"), of_bulk).when(F.col("hot"), F.concat(with_bulk, with_rest)).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))))
    placed = dealt.select("node", "content", "root", "band", "bulk", "key", F.explode(places).alias("at"))
    named = placed.select("node", "content", "root", "band", "bulk", F.xxhash64("key", "at.a", "at.b").alias("cell"))
    return named.join(filed, ["node", "content"])


def _table(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _candidates(cell: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text of a cell with those of other groups that share ``least`` minima or more with it and no key of an earlier band."""
    sketch, keys = _table(cell["sketch"], np.uint8), np.stack(cell["keys"].to_pylist()).astype(np.int64)
    root, band, bulk = (cell[c].to_numpy() for c in ("root", "band", "bulk"))
    large = np.flatnonzero(bulk)
    for i in np.flatnonzero(~bulk):
        others = large if len(large) else np.arange(i + 1, len(root))
        others = others[(root[others] != root[i]) & (band[others] == band[i])]
        others = others[(sketch[others] == sketch[i]).sum(1) >= least]
        if len(others):
            yield i, others[(keys[others] == keys[i]).argmax(1) == band[i]]


def _to_verify(least: int):
    """(cell, at, node, content, root, doc_id, partners) of the candidates of cells, in cells of ``TOGETHER`` shingles; partners are places of the same cell."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 20_000):
            name = table["cell"].to_numpy()
            starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(name)]):
                cell = table.slice(a, b - a)
                found = [(i, others) for i, others in _candidates(cell, least) if len(others)]
                if not found:
                    continue
                block = np.cumsum(cell["n"].to_numpy()) // (TOGETHER // 2)
                left = np.repeat([i for i, _ in found], [len(o) for _, o in found])
                right = np.concatenate([o for _, o in found])
                low, high = np.minimum(block[left], block[right]), np.maximum(block[left], block[right])
                for p, q in np.unique(np.stack([low, high], 1), axis=0).tolist():
                    here = (low == p) & (high == q)
                    order = np.argsort(left[here], kind="stable")
                    l, r = left[here][order], right[here][order]
                    at = np.union1d(l, r)
                    ends = np.searchsorted(l, at, "right")
                    partners = [r[x:y] for x, y in zip(np.searchsorted(l, at, "left"), ends)]
                    sub = xxhash.xxh64_intdigest(b"%d %d %d" % (name[a], p, q))
                    rows = cell.select(["node", "content", "root", "doc_id"]).take(pa.array(at)).combine_chunks()
                    columns = [pa.array(np.full(len(at), sub, np.uint64).view(np.int64)), pa.array(at.astype(np.int32)), *(c.combine_chunks() for c in rows.columns), pa.array(partners, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "at", "node", "content", "root", "doc_id", "partners"])

    return scan


def _linked(similar: float):
    """(u, v) of pairs that are ``similar`` or more on their whole sets, as many as connect what such pairs connect."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 1_000):
            name, at, node, root = (table[c].to_numpy() for c in ("cell", "at", "node", "root"))
            shingles, partners = table["shingles"].combine_chunks(), table["partners"].combine_chunks()
            place = {pair: i for i, pair in enumerate(zip(name.tolist(), at.tolist()))}
            groups: dict[tuple[int, int], tuple[int, int]] = {}

            def group(of: tuple[int, int]) -> tuple[int, int]:
                while groups.get(of, of) != of:
                    groups[of] = of = groups.get(groups[of], groups[of])
                return of

            edges = []
            for i in range(len(node)):
                for other in partners[i].values.to_pylist():
                    j = place[name[i], other]
                    a, b = group((name[i], root[i])), group((name[i], root[j]))
                    if a != b and similarity(shingles[i].values.to_numpy(), shingles[j].values.to_numpy()) >= similar:
                        groups[a] = b
                        edges.append((node[i], node[j]))
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

    return scan


def joined(filed: DataFrame, docs: DataFrame, roots: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, root): the groups of ``roots`` (node, root), joined wherever texts of theirs are ``similar`` or more.

    ``filed`` has (node, content, doc_id, n, keys, sketch): a row for each node and set of shingles, with the id of a document of ``docs``
    that has it, the number of its shingles, the keys of its bands and a byte of each of its minima.

    Every two texts of a key that lie in different groups are compared: in cells of at most ``HOT`` texts by their minima, and what is near by these
    on whole sets.  In larger keys each text is compared with one of them before, which joins most of a group of copies for one comparison a
    text; what still lies apart then meets in blocks.  No pair of a key is left out.
    """
    found = roots
    first = saved(_with_the_first(filed, roots))
    if first.limit(1).count():
        edges = _verified(first, docs, similar)
        found = _grown(roots, roots, edges)
        forget(edges)
    forget(first)
    minima_in_common = int(BANDS * ROWS * similar - 5 * (BANDS * ROWS * similar * (1 - similar)) ** 0.5)
    schema = "cell long, at int, node long, content long, root long, doc_id long, partners array<int>"
    near = saved(map_arrow(_cells(filed, found).repartition("cell").sortWithinPartitions("cell"), _to_verify(minima_in_common), schema))
    sets = _sets(docs, near)
    edges = saved(map_arrow(near.join(sets, "content").repartition("cell").sortWithinPartitions("cell"), _linked(similar), "u long, v long").distinct())
    forget(near, sets)
    out = _grown(roots, found, edges)
    forget(edges, *([found] if found is not roots else []))
    return out

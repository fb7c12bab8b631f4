"""Vectors as product codes: whole-number Lloyd iterations whose parts wait in heaps until their assignment may have changed.

Vectors are filed in blocks.  For each position of a part, a block has a heap per codebook entry; a part waits in its entry's heap under its slack, the
distance to the second nearest entry less the distance to its own when it was last scanned, plus all that the entry and the farthest-moving other
entry had moved until then.  When an entry's sum of moves reaches the smallest key, that part's bounds are violated: it is popped, scanned exactly
against all entries and filed anew.  All other parts still have their nearest entry, so a round reads few of them.

A round is a map over the table of blocks: it writes the next table, with the heaps, and beside each block what its parts have added to and
taken from the sums of entries.  The driver sees codebooks only, whose size is fixed.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block: places in it fit into 16 bits.
BLOCK = 1 << 15
#: What rounding of square roots may take from a slack.
MARGIN = 1e-3
_STATE = "parts binary, codes binary, heap_keys binary, heap_rows binary, heap_sizes binary, entry array<int>, added array<long>, sums array<array<long>>"
_NAMES = ["vec_id", "label", *(c.split()[0] for c in _STATE.split(", "))]


def largest(width: int) -> int:
    """The largest component whose squared distances over ``width`` components surely fit into 62 bits."""
    return 1 << int((62 - np.log2(max(width, 1))) / 2 - 1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    limit = largest(vectors.shape[1] // PARTS)
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -limit, limit).astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part (the lower of equals), the squared distance to it and to the nearest of the others (-1: there is none)."""
    n, k = len(parts), len(entries)
    best, own, second = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, -1, np.int64)
    most = int(max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)))
    exact = 4 * most * most * max(parts.shape[1], 1) < 1 << 52  # whole numbers that doubles hold
    for at in range(0, n, 4096):
        here = parts[at : at + 4096]
        if exact:
            a, b = here.astype(np.float64), entries.astype(np.float64)
            apart = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        else:
            apart = np.zeros((len(here), k), np.int64)
            for c in range(parts.shape[1]):
                apart += (here[:, c, None] - entries[:, c]) ** 2
        place = apart.argmin(1)
        row = np.arange(len(here))
        best[at : at + 4096], own[at : at + 4096] = place, apart[row, place].astype(np.int64)
        if k > 1:
            apart[row, place] = np.inf if exact else np.iinfo(np.int64).max
            second[at : at + 4096] = apart.min(1).astype(np.int64)
    return best, own, second


class Heaps:
    """The heaps of one part position of a block: a list of (key, place) per entry."""

    def __init__(self, heaps: list[list[tuple[float, int]]]) -> None:
        self.heaps = heaps

    @classmethod
    def read(cls, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> Heaps:
        ends = np.cumsum(sizes)
        waiting = list(zip(keys.tolist(), rows.tolist()))
        return cls([waiting[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())])

    def written(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        waiting = [x for heap in self.heaps for x in heap]
        keys = np.fromiter((k for k, _ in waiting), np.float64, len(waiting))
        low = keys.astype(np.float32)
        low = np.where(low > keys, np.nextafter(low, np.float32(-np.inf)), low)  # rounded down, which keeps the heaps' order
        return low, np.fromiter((r for _, r in waiting), np.uint16, len(waiting)), np.array([len(h) for h in self.heaps], np.int32)

    def popped(self, moved: np.ndarray) -> np.ndarray:
        """Takes out the places whose key ``moved`` has reached."""
        out = []
        for heap, reached in zip(self.heaps, (moved + MARGIN).tolist()):
            while heap and heap[0][0] <= reached:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def push(self, places: np.ndarray, entries: np.ndarray, keys: np.ndarray) -> None:
        for place, entry, key in zip(places.tolist(), entries.tolist(), keys.tolist()):
            heapq.heappush(self.heaps[entry], (key, place))


def _slack(own: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(np.float64)) - np.sqrt(own.astype(np.float64)))


def _row(ids: pa.Array, labels: pa.Array, blobs: Iterable[np.ndarray], change: tuple[list, list, list]) -> pa.RecordBatch:
    one = pa.array([0, len(ids)], pa.int32())
    columns = [pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)]
    columns += [pa.array([c], t) for c, t in zip(change, (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))))]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _blocks(dimension: int):
    """Blocks of (vec_id, label, vector), in which every part waits to be popped, under entry 0."""

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, labels, vectors = (c.chunk(0) for c in table.columns)
        n = len(ids)
        parts = scaled(vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, dimension))
        parts = parts.astype(np.int16) if np.abs(parts).max(initial=0) < 1 << 15 else parts
        sizes = np.zeros((PARTS, ENTRIES), np.int32)
        sizes[:, 0] = n
        blobs = parts, np.zeros((PARTS, n), np.uint8), np.full(PARTS * n, -np.inf, np.float32), np.tile(np.arange(n, dtype=np.uint16), PARTS), sizes
        return _row(ids, labels, blobs, ([], [], []))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, BLOCK - count))
                at, count = at + held[-1].num_rows, count + held[-1].num_rows
                if count == BLOCK:
                    yield block(held)
                    held, count = [], 0
        if held:
            yield block(held)

    return scan


def _assigned(batches: Iterable[pa.RecordBatch], books: np.ndarray, moved: np.ndarray):
    """Each block with its parts, the codes before, the codes now and the heaps, once all parts are popped that ``moved`` concerns."""
    width = books.shape[2]
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
            n = len(ids)
            blobs = [batch.column(c)[i].as_buffer() for c in range(2, 7)]
            parts = np.frombuffer(blobs[0], np.int16 if len(blobs[0]) == 2 * n * PARTS * width else np.int64).reshape(n, PARTS, width)
            before = np.frombuffer(blobs[1], np.uint8).reshape(PARTS, n)
            keys, places = np.frombuffer(blobs[2], np.float32).reshape(PARTS, n), np.frombuffer(blobs[3], np.uint16).reshape(PARTS, n)
            sizes = np.frombuffer(blobs[4], np.int32).reshape(PARTS, ENTRIES)
            now, heaps = before.copy(), []
            for part in range(PARTS):
                heap = Heaps.read(keys[part], places[part], sizes[part])
                popped = heap.popped(np.pad(moved[part], (0, ENTRIES - moved.shape[1])))
                best, own, second = nearest(parts[popped, part].astype(np.int64), books[part])
                heap.push(popped, best, _slack(own, second) + moved[part][best])
                now[part][popped] = best
                heaps.append(heap)
            yield ids, labels, parts, before, now, heaps


def _round(books: np.ndarray, moved: np.ndarray, first: bool):
    """The next blocks, each with the change of its counts and sums by entry (part position * ENTRIES + index)."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, parts, before, now, heaps in _assigned(batches, books, moved):
            entries, added, sums = [], [], []
            for part in range(PARTS):
                changed = np.arange(len(ids)) if first else np.flatnonzero(before[part] != now[part])
                count, total = np.zeros(ENTRIES, np.int64), np.zeros((ENTRIES, books.shape[2]), np.int64)
                for codes, sign in ((now, 1), (before, -1)) if not first else ((now, 1),):
                    np.add.at(count, codes[part][changed], sign)
                    np.add.at(total, codes[part][changed], sign * parts[changed, part].astype(np.int64))
                touched = np.flatnonzero((count != 0) | (total != 0).any(1))
                entries += (part * ENTRIES + touched).tolist()
                added += count[touched].tolist()
                sums += total[touched].tolist()
            written = [h.written() for h in heaps]
            yield _row(ids, labels, [parts, now, *(np.concatenate(x) for x in zip(*written))], (entries, added, sums))

    return scan


def _coded(books: np.ndarray, moved: np.ndarray):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, parts, _, now, _ in _assigned(batches, books, moved):
            error = np.zeros(len(ids), np.int64)
            for part in range(PARTS):
                error += ((parts[:, part].astype(np.int64) - books[part][now[part]]) ** 2).sum(1)
            text = now.T.tobytes().hex()
            codes = [text[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return scan


def _moved(books: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry has moved, together with the farthest of the others of its part position."""
    moves = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64))
    far = np.sort(moves, 1)[:, ::-1]
    others = np.where(np.arange(moves.shape[1]) == moves.argmax(1)[:, None], far[:, 1:2] if moves.shape[1] > 1 else 0.0, far[:, :1])
    return moves + others


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, label, embedding, any other columns).

    Rows whose vector is null, or holds a null or a component that is not finite, are left out; so are vectors of a length that ``PARTS`` does not
    divide, or other than that of the smallest vec_id.  Codebooks begin as the parts of the smallest vec_ids (null last, then by vector), all of them where there are fewer
    than ``ENTRIES``.  Components are floor(``SCALE`` * x), cut at :func:`largest`, beyond which squares would not fit (of parts of 16: 2^28).  Repeated rows are vectors like others.
    label_error sums the errors of equal labels, nulls together.  No row gives no row.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = vectors.where(x.isNotNull() & (F.size(x) % PARTS == 0) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    begin = [r["embedding"] for r in usable.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()]  # ENTRIES rows
    dimension = len(begin[0]) if begin else 0
    if any(len(b) != dimension for b in begin):
        usable = usable.where(F.size("embedding") == dimension)
        begin = [r["embedding"] for r in usable.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()]
    else:
        usable = usable.where(F.size("embedding") == dimension)
    label = vectors.schema["label"].dataType.simpleString()
    if not begin:
        return usable.where("false").selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    width = dimension // PARTS
    books = scaled(np.array(begin, np.float64).reshape(len(begin), dimension)).reshape(len(begin), PARTS, width).transpose(1, 0, 2).copy()
    counts, sums, moved = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64), np.zeros(books.shape[:2])
    schema = f"vec_id array<long>, label array<{label}>, {_STATE}"
    blocks = saved(map_arrow(usable, _blocks(dimension), schema))
    for turn in range(ROUNDS):
        last, blocks = blocks, saved(map_arrow(blocks, _round(books, moved, turn == 0), schema))
        forget(last)
        change = blocks.select(F.explode(F.arrays_zip("entry", "added", "sums")).alias("c")).select("c.*")
        for row in change.groupBy("entry").agg(F.sum("added").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect():  # a row per entry
            part, entry = divmod(row["entry"], ENTRIES)
            counts[part, entry] += row["n"]
            sums[part, entry] += np.array(row["sums"], np.int64)
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        moved = moved + _moved(books, new)
        books = new
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = saved(map_arrow(blocks, _coded(books, moved), f"vec_id long, label {label}, code string, error long"))
    forget(blocks)
    totals = saved(coded.groupBy(F.col("label").alias("label__")).agg(F.sum("error").alias("label_error")))
    found = coded.join(totals, F.col("label").eqNullSafe(F.col("label__")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

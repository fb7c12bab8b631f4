"""Packing token sequences by cutting-stock column generation.

Documents longer than a sequence are cut into whole sequences and a rest.  Rests of up to ``SHORT`` ids are bundled by their exact
length; longer ones are rounded up by at most 3 %.  The histogram of what results (a bounded number of sizes, whatever the input) is
the demand of a cutting-stock problem: a linear program over filling patterns, to which a knapsack dynamic program adds the pattern of the best
reduced cost until the value is near its bound.  Patterns are rounded down and each takes the next documents of its sizes by rank.  The rests that
bundling and rounding leave over, or that no pattern fits well, are dealt into streams, laid end to end and cut freely, the last of a stream at powers
of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, release, saved

LENGTH = 4096
UNIT = 8
#: Rests of up to so many ids are bundled, eight of one length or a multiple of eight up to ``BUNDLE`` ids: a whole number of units.
SHORT, BUNDLE = 256, 512
END = 2
#: The least share of a sequence that a pattern fills.
FULL = 0.98
#: Left-over rests up to which their ids are broadcast.
FEW = 1 << 21
#: Rests that are ranked in one task: a share of all, within these bounds.
LEAST_RANKED, MOST_RANKED = 256, 1 << 20
#: Whole sequences' worth of left-over ids that one task lays end to end.
LAID = 64
WHOLE, LOOSE = 1 << 62, 1 << 61

#: Where the tokenizer cuts in any case: between a letter and ASCII punctuation, after such other than an apostrophe before a letter, around a digit.  (The small
#: letter of U+0130 ends in a mark.)
_EDGES = [(r"([^\PL\x{130}])([!-/:-@\[-`{-~])", r"\1 \2"), (r"([!-&(-/:-@\[-`{-~])(\pL)", r"\1 \2"), (r"[0-9]", r" \0 ")]
_COMBINING = "[\u0300-\u036f]"
#: The normaliser and pre-tokenizer of a file whose texts may be cut at ``_EDGES``; texts for any other file are encoded whole.
_CUTS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


class WordEncoder:
    """Token ids of texts.  For a tokenizer that cuts at white space and at ``_EDGES``, and lower-cases after composing characters, texts are cut there
    into parts in Arrow; each distinct part is encoded once, many at a time, and kept.  Beyond ``most`` parts those used only once since the last
    time are forgotten.  A text that spells a special token is encoded whole, as are all texts for another tokenizer.
    """

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.cuts = (described.get("normalizer"), described.get("pre_tokenizer")) == _CUTS
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.uses = np.empty(0, self.kind), np.zeros(1, np.int64), np.empty(0, np.int64)

    def _forget(self) -> None:
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        begin = self.starts[kept]
        lengths = self.starts[kept + 1] - begin
        names = list(self.slots)
        self.slots = {names[i]: n for n, i in enumerate(kept.tolist())}
        ends = np.concatenate([[0], np.cumsum(lengths)])
        self.ids = self.ids[np.repeat(begin - ends[:-1], lengths) + np.arange(ends[-1])]
        self.starts, self.uses = ends, np.ones(len(kept), np.int64)

    def _encoded(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """New parts in some order, their ids one after the other and how many each has.

        Those of letters are encoded in runs of 200, joined by spaces and told apart by word number, the others one by one.
        """
        order: list[str] = []
        ids, lengths = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        alone = [p for p in parts if not p.isalpha()]
        letters = [p for p in parts if p.isalpha()]
        for at in range(0, len(letters), 200):
            run = letters[at : at + 200]
            result = self.tokenizer.encode(" ".join(run), add_special_tokens=False)
            numbers = np.array(result.word_ids, np.int64) if None not in result.word_ids else np.empty(0, np.int64)
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            if len(cuts) + 1 == len(run) and len(numbers):
                order += run
                ids.append(np.array(result.ids, self.kind))
                lengths.append(np.diff(cuts, prepend=0, append=len(numbers)))
            else:  # some letter becomes two words when lower-cased
                alone += run
        found = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        ids.append(np.fromiter(chain.from_iterable(found), self.kind))
        lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        return order + alone, np.concatenate(ids), np.concatenate(lengths)

    def _slots(self, parts: list[str], counts: np.ndarray) -> np.ndarray:
        fresh = [p for p in parts if p not in self.slots]
        if len(self.slots) + len(fresh) > self.most:
            self._forget()
            fresh = [p for p in parts if p not in self.slots]
        if fresh:
            order, ids, lengths = self._encoded(fresh)
            self.slots.update(zip(order, range(len(self.slots), len(self.slots) + len(order))))
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.uses = np.concatenate([self.uses, np.zeros(len(order), np.int64)])
        slots = np.fromiter(map(self.slots.__getitem__, parts), np.int64, len(parts))
        self.uses[slots] += counts
        return slots

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text is empty."""
        text = pc.fill_null(column, "").cast(pa.large_string())
        if not self.cuts:
            return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(text.to_pylist(), add_special_tokens=False)]
        special = pc.match_substring(text, "<|")
        cut = pc.if_else(special, "", text)
        # a capital with a mark need not compose where its small letter does, so such texts keep their case
        cut = pc.if_else(pc.match_substring_regex(cut, _COMBINING), cut, pc.ascii_lower(cut))
        for edge, apart in _EDGES:
            cut = pc.replace_substring_regex(cut, edge, apart)
        lists = pc.ascii_split_whitespace(cut)
        parts = lists.flatten().dictionary_encode()
        indices = parts.indices.to_numpy()
        slots = self._slots(parts.dictionary.to_pylist(), np.bincount(indices, minlength=len(parts.dictionary)))[indices]
        begin = self.starts[slots]
        lengths = self.starts[slots + 1] - begin
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(begin - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(text[i].as_py(), add_special_tokens=False).ids, self.kind)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def _runs(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


PIECES = "piece_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _cut(path: str, length: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordEncoder(path))
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            release()
            doc_ids = batch.column(0).to_pylist()
            for at, to in _runs(batch.column(1)):
                rows = []
                for doc, ids in zip(doc_ids[at:to], encoder.encode(batch.column(1).slice(at, to - at))):
                    ids = np.append(ids, np.array([END], ids.dtype)).astype("<u4")
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        raw = piece.astype(encoder.kind).tobytes() if len(piece) < length else None
                        rows.append((number, doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), raw))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.binary()])], [x.split()[0] for x in PIECES.split(", ")])

    return scan


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits: its value and how often each item is in it."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_, values_ = sizes[order], values[order]
    for c in range(1, capacity + 1):
        k = np.searchsorted(sizes_, c, "right")
        best[c] = best[c - 1]
        if k:
            here = best[c - sizes_[:k]] + values_[:k]
            i = int(here.argmax())
            if here[i] > best[c] + 1e-12:
                best[c], choice[c] = here[i], order[i]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), pattern


def patterns(demand: np.ndarray, sizes: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 5000) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) of the rounded-down linear program; no item is used beyond its demand.

    Revised simplex with columns priced by :func:`knapsack`; ends when the value is within ``gap`` of a bound (the items' whole size, or the
    value over the best column's), or after ``most`` columns.  Whenever it ends, the basis covers the demand, so what rounding down leaves over is
    less than one use of each of ``len(sizes)`` patterns; a drift of the inverse is taken out by solving once more.  Patterns that fill less than
    ``FULL`` of a sequence are left out, as where all items are a little longer than half a sequence.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand.astype(float)
    bound = float(sizes @ demand) / capacity
    for _ in range(most):
        if x.sum() <= bound * (1 + gap):
            break
        duals = inverse.sum(0)
        value, column = knapsack(np.maximum(duals, 0), sizes, capacity)
        bound = max(bound, x.sum() / value)
        if value <= 1 + gap:
            break
        direction = inverse @ column
        ratios = np.full(m, np.inf)
        up = direction > 1e-9
        ratios[up] = x[up] / direction[up]
        out = int(ratios.argmin())
        step = ratios[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    x = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    left, used = demand.astype(np.int64).copy(), []
    for times, column in zip(np.floor(x + 1e-6).astype(np.int64), basis.T.round().astype(np.int64)):
        on = column > 0
        times = int(min(times, (left[on] // column[on]).min()))
        if times > 0 and column @ sizes >= FULL * capacity:
            used.append((times, column))
            left -= times * column
    return used


def _lay_end_to_end(length: int, kind: str):
    """Concatenate the rests of one stream and cut them into whole sequences, then powers of two."""

    def lay(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece_id")
        sequence, at, out = table["stream"][0].as_py() << 32, 0, []
        total = pc.sum(table["length"]).as_py()
        room = [length] * (total // length) + [1 << i for i in range(length.bit_length(), -1, -1) if (total % length) >> i & 1]
        for row in table.to_pylist():
            ids = np.frombuffer(row["ids"], kind).astype("<u4")
            done = 0
            while done < len(ids):
                take = min(len(ids) - done, room[0] - at)
                part = ids[done : done + take]
                out.append((row["doc_id"], row["start"] + done, take, zlib.crc32(part.tobytes()), row["doc_tokens"], LOOSE + sequence, at))
                done, at = done + take, at + take
                if at == room[0]:
                    room, sequence, at = room[1:], sequence + 1, 0
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return lay


def _bin(length: Column, whole: int) -> Column:
    """Lengths that are packed alike: exact up to ``SHORT``, above rounded up to 8, 16 or 32, never beyond a whole sequence."""
    rounded = length
    for least, step in ((SHORT, UNIT), (1024, 2 * UNIT), (2048, 4 * UNIT)):
        rounded = F.when(length > least, F.least(F.ceil(length / step) * step, F.lit(whole))).otherwise(rounded)
    return rounded.cast("int")


def _plan(histogram: list[tuple[int, int]], whole: int) -> tuple[list[tuple], list[tuple], int, int]:
    """From (bin, number of rests): a row per bin, a row per pattern and size, and how many rests and ids are left over.

    Of a bin: how many of its rests make one item, the item's size, its first item among those of the size, how many rests are in items and in how
    many parts they are ranked.  Of a pattern and size: the items from ``low`` to ``high``, ``each`` to a sequence, from sequence ``base`` on.
    """
    total = sum(n for _, n in histogram)
    ranked = min(max(total // 4096, LEAST_RANKED), MOST_RANKED)
    demand: dict[int, int] = {}
    bins = []
    for length, n in histogram:
        each = UNIT * max(1, BUNDLE // UNIT // length) if UNIT * length <= whole and length <= SHORT else 1
        size = -(-each * length // UNIT)
        bins.append((length, each, size, demand.get(size, 0), n // each * each, -(-n // ranked)))
        demand[size] = demand.get(size, 0) + n // each
    sizes = np.array(sorted(s for s in demand if demand[s]), np.int64)
    slots, taken, first = [], np.zeros(len(sizes), np.int64), 0
    for times, column in patterns(np.array([demand[s] for s in sizes.tolist()], np.int64), sizes, whole // UNIT):
        for i in np.flatnonzero(column):
            slots.append((int(sizes[i]), int(taken[i]), int(taken[i] + times * column[i]), int(column[i]), first))
            taken[i] += times * column[i]
        first += times
    used = dict(zip(sizes.tolist(), taken.tolist()))
    left = [n - each * min(max(used.get(size, 0) - at, 0), n // each) for (_, n), (_, each, size, at, _, _) in zip(histogram, bins)]
    return bins, slots, sum(left), sum(n * length for n, (length, _) in zip(left, histogram))


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of ``docs`` (doc_id, text, any other columns).

    Each document is its ids by the tokenizer file plus the end id; a null or empty text is the end id alone.  Every id is in exactly one
    piece.  Repeated rows and null doc_ids are documents like others; equal lengths go by the order in which pieces were cut.  No row gives no row.
    ``tokenizer`` is a path that every executor has; ``length`` is a multiple of 8.
    """
    spark = docs.sparkSession
    pieces = saved(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _cut(tokenizer, length), PIECES))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = pieces.where(F.col("length") == length).withColumn("sequence_id", F.col("piece_id") + F.lit(WHOLE)).withColumn("offset", F.lit(0).cast("long"))
    rests = pieces.where(F.col("length") < length).drop("ids").withColumn("bin", _bin(F.col("length"), length))
    histogram = sorted((r["bin"], r["n"]) for r in rests.groupBy("bin").agg(F.count("*").alias("n")).collect())  # as many rows as bins
    bins, slots, few, left = _plan(histogram, length)
    plan = F.broadcast(spark.createDataFrame(bins, "bin int, each long, size int, first long, bundled long, parts long"))  # a row per bin
    parted = rests.join(plan, "bin").withColumn("part", F.pmod(F.xxhash64("piece_id"), "parts"))
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("bin", "part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("bin", "part").orderBy("piece_id")
    # starts has a row per bin and 4,096th of the rests, or per 2^20 rests beyond 4 billion
    ranked = parted.join(F.broadcast(saved(starts)), ["bin", "part"]).withColumn("rank", F.col("ahead") + F.row_number().over(order) - 1)
    ranked = ranked.withColumn("item", F.when(F.col("rank") < F.col("bundled"), F.expr("first + rank div each"))).drop("each")
    table = F.broadcast(spark.createDataFrame(slots, "slot int, low long, high long, times long, base long"))  # patterns x sizes
    fits = (F.col("size") == F.col("slot")) & (F.col("item") >= F.col("low")) & (F.col("item") < F.col("high"))
    placed = saved(ranked.join(table, fits, "left").withColumn("sequence_id", F.expr("base + (item - low) div times")).select("piece_id", *out[:-1]))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "piece_id").rowsBetween(Window.unboundedPreceding, -1)
    filled = placed.where("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    over = placed.where("sequence_id is null").select("piece_id")
    loose = pieces.join(F.broadcast(over) if few <= FEW else over.hint("merge"), "piece_id", "left_semi")
    streams = max(1, -(-left // (LAID * length)))
    kind = "<u2" if _vocabulary(tokenizer) <= 1 << 16 else "<u4"
    dealt = loose.withColumn("stream", F.pmod(F.xxhash64("piece_id"), F.lit(streams)))
    laid = dealt.groupBy("stream").applyInArrow(_lay_end_to_end(length, kind), ", ".join(f"{c} long" for c in out))
    return whole.select(out).union(filled.select(out)).union(laid.select(out))


def _vocabulary(path: str) -> int:
    return WordEncoder(path).tokenizer.get_vocab_size()

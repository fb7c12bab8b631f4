"""Stupid-backoff scores of documents (Brants et al., 2007) from n-gram counts of the whole corpus.

Documents are dealt into blocks of bounded size by a hash.  A block asks for the counts of its distinct n-grams: their 56-bit hashes, sorted, are
cut by leading bits into one packed row per table partition, with how often the block has each.  A table partition adds up all blocks' counts
and answers each block in its own order; the block joins the answers to the n-grams of its documents and sums per document.  Packing makes a
row of a shuffle hold hundreds of n-grams; no n-gram, however frequent, costs a block more than one entry.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

ORDER = 3
BACKOFF = 0.4
CUTOFF = 2
BLOCK_BYTES = 8 << 20
#: Of G distinct n-grams about G / 2**56 of each one's like share its hash and are counted with it.
HASH_BITS = 56
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _packed(values: np.ndarray) -> bytes:
    """The bytes of ``values`` by significance, so that those that hardly vary lie together, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _values(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _packed_sorted(values: np.ndarray) -> bytes:
    return _packed(np.diff(values, prepend=np.uint64(0)))


def _sorted_values(raw: bytes) -> np.ndarray:
    return np.cumsum(_values(raw, "<u8"), dtype=np.uint64)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MULTIPLIER
    return values ^ (values >> np.uint64(29))


def ngram_hashes(column: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text, and for n = 1..order the hash of the n-gram that ends at each word (0 where the text has not so many words yet)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "").cast(pa.large_string())))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    counts = np.diff(np.concatenate([[0], np.cumsum(full)])[offsets])
    words = flat.filter(pa.array(full)).dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w, 42) for w in words.dictionary.to_pylist()], np.uint64)
    one = table[words.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    place = np.arange(len(one)) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = [one]
    for n in range(2, order + 1):
        longer = np.zeros(len(one), np.uint64)
        longer[1:] = _mix(whole[-1][:-1] * np.uint64(31) + one[1:] + np.uint64(n))
        longer[place < n - 1] = 0
        whole.append(longer)
    return counts, [w >> np.uint64(64 - HASH_BITS) for w in whole]


def _ask(order: int, bits: int):
    def ask(table: pa.Table) -> pa.Table:
        _, grams = ngram_hashes(table["text"].combine_chunks(), order)
        hashes, counts = np.unique(np.concatenate([g[g != 0] for g in grams]), return_counts=True)
        top = (hashes >> np.uint64(HASH_BITS - bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(top) else np.empty(0, np.int64)
        ends = np.r_[starts[1:], len(top)]
        rows = [(int(top[a]), _packed_sorted(hashes[a:b]), _packed(counts[a:b].astype("<u4"))) for a, b in zip(starts, ends)]
        block = table["block"][0].as_py()
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table([pa.array([block] * len(rows), pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["block", "part", "hashes", "counts"])

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Of one table partition: the sum over all blocks of each n-gram's count, in the order in which each block asked."""
    asked = [_sorted_values(r) for r in table["hashes"].to_pylist()]
    counts = np.concatenate([_values(r, "<u4") for r in table["counts"].to_pylist()])
    _, slot = np.unique(np.concatenate(asked), return_inverse=True)
    sums = np.bincount(slot, counts)[slot].astype("<u8")
    ends = np.cumsum([len(a) for a in asked])
    totals = [_packed(sums[e - len(a) : e]) for a, e in zip(asked, ends)]
    return pa.table([table["block"].combine_chunks(), table["part"].combine_chunks(), pa.array(totals, pa.binary())], ["block", "part", "totals"])


SCORES = "doc_id long, n_words long, n_full long, n_backed long, logscore_micro long"


def _score(order: int, cutoff: int, backoff: float, size: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words, grams = ngram_hashes(docs["text"].combine_chunks(), order)
        there = [g != 0 for g in grams]
        hashes, slots = np.unique(np.concatenate([g[t] for g, t in zip(grams, there)]), return_inverse=True)
        totals = np.concatenate([np.empty(0, "<u8"), *(_values(r, "<u8") for r in answers.sort_by("part")["totals"].to_pylist())]).astype(np.float64)
        if len(totals) != len(hashes):
            raise RuntimeError("a block's documents changed while they were scored")
        place = np.arange(len(grams[0])) - np.repeat(np.cumsum(words) - words, words)
        counts = [np.zeros(len(place)) for _ in grams]
        for count, t, slot in zip(counts, there, np.split(slots, np.cumsum([t.sum() for t in there])[:-1])):
            count[t] = totals[slot]
        value, level = counts[0] / size, np.ones(len(place), np.int64)
        for n in range(2, order + 1):
            has = place >= n - 1
            seen = has & (counts[n - 1] >= cutoff)
            context = np.concatenate([[1.0], counts[n - 2][:-1]])[: len(place)]
            full = np.divide(counts[n - 1], context, out=np.zeros(len(place)), where=seen)
            value = np.where(seen, full, np.where(has, backoff * value, value))
            level[seen] = n
        micro = np.rint(np.log(value) * 1e6).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(words)])

        def per_doc(x: np.ndarray) -> pa.Array:
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]), pa.int64())

        sums = map(per_doc, (level == order, level < np.minimum(place + 1, order), micro))
        return pa.table([docs["doc_id"].combine_chunks(), pa.array(words, pa.int64()), *sums], [c.split()[0] for c in SCORES.split(", ")])

    return score


def backoff_scores(docs: DataFrame, order: int = ORDER, cutoff: int = CUTOFF, backoff: float = BACKOFF) -> DataFrame:
    """One row of ``SCORES`` for every row of ``docs`` (doc_id, text, any other columns).

    Words are split at ASCII white space, A-Z lower-cased.  A word's score is c(n-gram) / c(its first n - 1 words) for the longest n up to
    ``order`` whose n-gram the corpus has ``cutoff`` times or more, times ``backoff`` for every order given up; at n = 1, c(word) / all words.
    Counts are over all of ``docs``.  ``logscore_micro`` sums millionths of natural logarithms, each rounded; ``n_full`` and ``n_backed`` count
    words scored at the full order and words for which an order was given up.  Null and empty texts have no words and score 0; null ids are
    kept, repeated rows stay repeated and count each time, no row gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(WORD)))).first()
    blocks = max(1, math.ceil((total[0] or 0) / BLOCK_BYTES))
    bits = max(6, math.ceil(math.log2(blocks)))
    # a row repeated very often is dealt out by the place in a file at which it is read, which both readings below agree on
    place = F.xxhash64("doc_id", "text", F.input_file_name(), F.input_file_block_start())
    dealt = rows.withColumn("block", F.pmod(place, F.lit(blocks)))
    asked = dealt.groupBy("block").applyInArrow(_ask(order, bits), "block long, part long, hashes binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "block long, part long, totals binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, cutoff, backoff, total[1] or 1), SCORES)

"""Exact k nearest binary codes by incremental multi-index hashing (Norouzi, Punjani and Fleet, 2012).

A code of 64 bits is filed under each of its four segments of 16 bits.  Round r looks up every key at distance exactly r from the query's
segment.  After round r each code at a distance of up to ``4 * (r + 1) - 1`` has been met, since at a greater radius in all four segments the
distances would add up to more.  A query leaves the search once its kth verified distance lies within that.

Codes are dealt by hash into parts of a bounded size, each with tables of its own, and queries into blocks of a bounded size.  Every block is
searched in every part, and the parts' nearest are merged.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, saved

SEGMENTS = 4
WIDTH = 16
#: Distinct codes of a part and queries of a block: 16 bytes each, in one task.
PART = 1 << 21
BLOCK = 1 << 18
#: Fewer queries than this are not divided for the sake of more tasks.
LEAST = 64


def sign_code(vector: Column, bits: int = SEGMENTS * WIDTH) -> Column:
    """A 64-bit code: bit i is set where component i is above zero.  Missing, null and NaN components set none; more than ``bits`` are refused."""
    fits = F.when(F.size(vector) > bits, F.raise_error(F.lit(f"a vector of more than {bits} components")).cast("array<double>"))
    doubles = fits.otherwise(F.transform(vector, lambda x: x.cast("double")))
    powers = F.transform(doubles, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(powers, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


@lru_cache(None)
def _ball(radius: int) -> np.ndarray:
    """The masks of ``radius`` bits of a segment."""
    masks = np.arange(1 << WIDTH)
    return masks[np.bitwise_count(masks) == radius]


def _keys(codes: np.ndarray) -> np.ndarray:
    """The table key of each code in each segment (segments x codes)."""
    return np.stack([((codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) + (s << WIDTH) for s in range(SEGMENTS)])


class Tables:
    """The segment tables of distinct ``codes``: the positions filed under key x are ``order[starts[x] : starts[x + 1]]``."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        keys = _keys(codes)
        self.order = np.concatenate([np.argsort(k, kind="stable").astype(np.int32) for k in keys]) if len(codes) else np.empty(0, np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(keys.ravel(), minlength=SEGMENTS << WIDTH))])

    def nearest(self, query: np.uint64, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) of the k codes nearest to ``query``, whose keys are ``base``; ties go to the smaller position."""
        found, apart = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(WIDTH + 1):
            probes = (base[:, None] ^ _ball(radius)).ravel()
            begin = self.starts[probes]
            sizes = self.starts[probes + 1] - begin
            ends = np.cumsum(sizes)
            met = self.order[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])]
            distances = np.bitwise_count(self.codes[met] ^ query).astype(np.int64)
            if len(found) >= k:
                near = distances <= apart[-1]
                met, distances = met[near], distances[near]
            found, once = np.unique(np.concatenate([found, met]), return_index=True)
            apart = np.concatenate([apart, distances])[once]
            best = np.argsort(apart, kind="stable")[:k]
            found, apart = found[best], apart[best]
            if len(found) >= k and apart[-1] <= SEGMENTS * (radius + 1) - 1:
                break
        return found, apart


def _search(k: int):
    def search(codes: pa.Table, queries: pa.Table) -> pa.Table:
        codes = codes.sort_by("least")  # so that a smaller position is a smaller id
        tables = Tables(codes["code"].to_numpy().view(np.uint64))
        wanted = queries["query"].to_numpy().view(np.uint64)
        hits = [tables.nearest(q, base, k) for q, base in zip(wanted, _keys(wanted).T)]
        sizes = [len(found) for found, _ in hits]
        positions = np.concatenate([np.empty(0, np.int64), *(found for found, _ in hits)])
        distances = np.concatenate([np.empty(0, np.int64), *(apart for _, apart in hits)])
        of = np.repeat(np.arange(len(wanted)), sizes)
        out = {"query_id": queries["query_id"].to_numpy()[of], "query": wanted[of].view(np.int64), "code": tables.codes[positions].view(np.int64)}
        out |= {"least": codes["least"].to_numpy()[positions], "distance": distances.astype(np.int32)}
        release()
        return pa.table(out)

    return search


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 10, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, match_id, distance): the k nearest other rows of ``codes`` (id, code long) for each of ``queries`` (id, code long).

    Ties go to the smaller id; a query's own id is left out; fewer rows than k give fewer matches.  Rows with a null id or code take no part.
    Repeated rows of ``codes`` count once.  Equal codes are filed once with their k + 1 smallest ids, more of which no result can hold.
    """
    clean = codes.where("id is not null and code is not null").select(F.col("id").cast("long").alias("id"), "code").distinct()
    for salt in (F.pmod(F.xxhash64("id"), F.lit(64)), F.lit(0)):
        clean = clean.withColumn("n", F.row_number().over(Window.partitionBy("code", salt).orderBy("id"))).where(F.col("n") <= k + 1)
    index = saved(clean.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = saved(queries.where("id is not null and code is not null").select(F.col("id").cast("long").alias("query_id"), F.col("code").alias("query")).distinct())
    n_codes, n_queries = index.count(), asked.count()
    parts = max(1, -(-n_codes // part))
    spread = min(-(-codes.sparkSession.sparkContext.defaultParallelism // parts), -(-n_queries // LEAST))
    blocks = max(1, -(-n_queries // block), spread)
    cell = F.col("part") * blocks + F.col("block")
    filed = index.select("code", F.col("ids")[0].alias("least"), F.pmod(F.xxhash64("code"), F.lit(parts)).alias("part"))
    filed = filed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(cell.alias("cell"), "code", "least")
    sent = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = sent.select(cell.alias("cell"), "query_id", "query")
    # a code among the k + 1 first by distance and least id may be the query's own; k others hold all of the k nearest ids
    both = filed.repartition(parts * blocks, "cell").groupBy("cell").cogroup(sent.repartition(parts * blocks, "cell").groupBy("cell"))
    met = both.applyInArrow(_search(k + 1), "query_id long, query long, code long, least long, distance int")
    of = Window.partitionBy("query_id", "query")
    near = met.withColumn("n", F.row_number().over(of.orderBy("distance", "least"))).where(F.col("n") <= k + 1).drop("n", "least")
    ids = near.join(index, "code").select("query_id", "query", "distance", F.explode("ids").alias("match_id")).where("match_id <> query_id")
    ranked = ids.withColumn("rank", F.row_number().over(of.orderBy("distance", "match_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "match_id", "distance")

"""Product codes against a plain Lloyd iteration on whole numbers, and what the heaps leave unread."""

import hashlib
import math
import random

import numpy as np
import pytest

from colloquy.llm import vector_codes as vc

SCHEMA = "vec_id long, label int, embedding array<float>, code string, parts string"


def plain(rows, parts=4):
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[tuple(math.floor(1024 * float(np.float32(x))) for x in r[2][p * len(r[2]) // parts : (p + 1) * len(r[2]) // parts]) for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:256]] for p in range(parts)]

    def assign():
        return [[min(((sum((x - y) ** 2 for x, y in zip(c[p], e)), i) for i, e in enumerate(books[p]))) for p in range(parts)] for c in cut]

    for _ in range(4):
        found = assign()
        for p in range(parts):
            members = {}
            for c, f in zip(cut, found):
                members.setdefault(f[p][1], []).append(c[p])
            for i, group in members.items():
                books[p][i] = tuple(sum(x) // len(group) for x in zip(*group))
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(kept, errors):
        by[r[1]] = by.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in range(parts) for e in books[p] for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in f), e, by[r[1]], digest) for r, f, e in zip(kept, found, errors)), key=repr)


def table(n, dimension=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dimension)] for _ in range(12)]
    rows = [(i, rng.choice([1, 1, 1, 2, None]), [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in rng.sample(range(5 * n), n)]
    rows += [rows[0], (3, 1, rows[0][2]), (-1, 2, [0.0] * dimension), (-2, 2, [0.0] * dimension), (None, None, rows[1][2])]
    rows += [(10**7, 1, None), (10**7 + 1, 1, [float("nan")] * dimension), (10**7 + 2, 1, [None] + [0.1] * (dimension - 1)), (10**7 + 3, None, [float("inf")] * dimension)]
    return [(i, label, v and [x if x is None else float(np.float32(x)) for x in v], "c", "p") for i, label, v in rows]


@pytest.mark.parametrize("n, block", [(700, 1 << 15), (400, 64), (30, 7)])
def test_compressed(spark, monkeypatch, n, block):
    monkeypatch.setattr(vc, "BLOCK", block)
    rows = table(n)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = vc.compressed(frame)
    assert sorted(map(tuple, found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == plain(rows)


def test_large_components_equal_vectors_and_empty_tables(spark):
    rng = random.Random(2)
    rows = [(i, 1, [float(np.float32(rng.gauss(0, 5e4))) for _ in range(8)], "c", "p") for i in range(300)]
    assert sorted(map(tuple, vc.compressed(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plain(rows)
    rows = [(i, None, [0.5] * 8, "c", "p") for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, vc.compressed(frame).collect()), key=repr) == plain(rows)
    assert vc.compressed(frame.limit(0)).count() == 0
    assert vc.compressed(frame.withColumn("embedding", frame.embedding.cast("array<float>")).where("vec_id < 0")).count() == 0
    odd = spark.createDataFrame([(1, 1, [0.1] * 8, "", ""), (2, 1, [0.1] * 4, "", ""), (3, 1, [0.1] * 3, "", ""), (4, 1, [], "", "")], SCHEMA)
    assert [r.vec_id for r in vc.compressed(odd).collect()] == [1]


def test_heaps_keep_every_part_whose_entry_is_still_nearest():
    rng = np.random.default_rng(3)
    parts = rng.normal(0, 300, (4000, 4)).astype(np.int64)
    book = parts[:64].copy()
    moved, read = np.zeros(64), []
    heap = vc.Heaps([[(-np.inf, i) for i in range(len(parts))], *[[] for _ in range(63)]])
    now = np.zeros(len(parts), np.int64)
    for _ in range(6):
        popped = heap.popped(moved)
        read.append(len(popped))
        best, own, second = vc.nearest(parts[popped], book)
        heap.push(popped, best, vc._slack(own, second) + moved[best])
        now[popped] = best
        heap = vc.Heaps.read(*heap.written())
        assert (now == ((parts[:, None] - book) ** 2).sum(2).argmin(1)).all()
        new = np.array([parts[now == e].sum(0) // max((now == e).sum(), 1) if (now == e).any() else book[e] for e in range(64)])
        moved, book = moved + vc._moved(book[None], new[None])[0], new
    assert read[0] == len(parts) and read[-1] < 0.7 * len(parts)

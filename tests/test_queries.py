"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

from colloquy.plans import all_queries, all_sql

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query(spark, duck, name):
    frame = all_queries()[name](spark, DATA)
    result = duck.execute(all_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    theirs = sorted((tuple(map(plain, row)) for row in result.fetchall()), key=repr)
    ours = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_query_without_sql_runs(spark, name):
    frame = all_queries()[name](spark, DATA)
    rows = frame.collect()
    assert frame.columns and all(len(r) == len(frame.columns) for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, all_queries()[name](spark, DATA).collect()))


def test_every_turn_of_a_recording_meets_a_cell(spark):
    from colloquy.plans.views import segments

    turns = {(r.rec, r.speaker, r.start) for r in segments(spark, DATA).collect()}
    for name in ("jon_06_whole_overlap_join", "jon_07_whole_midpoint_join"):
        assert {(r.rec, r.speaker, r.b_start) for r in all_queries()[name](spark, DATA).collect()} == turns
    assert all_queries()["prj_21_whole_status"](spark, DATA).where("turn > 0").count()


def test_seeded_shuffle_and_choice_by_plain_hashes(spark):
    import struct

    xxhash = pytest.importorskip("xxhash")
    from colloquy.plans.views import runs

    def number(name):
        plain = xxhash.xxh64_intdigest(struct.pack("<i", 42), xxhash.xxh64_intdigest(name.encode(), 42))
        return plain - (1 << 64) * (plain >> 63)

    names = [r.name for r in runs(spark, DATA).collect()]
    assert [r.name for r in all_queries()["srt_05_shuffle"](spark, DATA).collect()] == sorted(names, key=number) != sorted(names)
    chosen = {r.name: r.variant for r in all_queries()["srt_10_seeded_choice"](spark, DATA).collect()}
    assert chosen == {n: ("SER", "SR", "ER", "R")[number(n) % 4] for n in names} and len(set(chosen.values())) == 4

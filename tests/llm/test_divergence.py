"""Divergences of sources against the sum over all kept terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from colloquy.llm import divergence as dv

DOCS = "doc_id long, text string, lang string, source string, p long, z string, key string, value long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, listed=200):
    docs = [("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""), lang or "", source or "") for _, text, lang, source, *_ in rows]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        found = TERM.findall(text)
        seen[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        v = len(kept)

        def share(count, total):
            return 1 + 1_000_000_000 * (count + 1) // (total + v)

        shares = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][k] for k in kept)) for t in kept} for s in sources}
        every = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        q = {t: share(every[t], sum(every.values())) for t in kept}
        for s in sources:
            pairs = [(sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((shares[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, listed)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return sorted(out)


def table():
    rng = random.Random(4)
    vocabulary = [f"{rng.choice('abcdefgh')}{rng.choice('xyzé')}{i % 17 * 'o'}" for i in range(120)]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["hot", "hot", "a", "b", None, "ü"])
        start = hash_free(lang, source)
        words = [vocabulary[min(int(rng.expovariate(0.05)) + start, 119)] for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", "1", "-"]).join(w.upper() if rng.random() < 0.2 else w for w in words), lang, source))
    rows += [(900, None, "en", "empty"), (901, "", "xx", "a"), (902, "123 !", "xx", "b"), (903, "only twice", "yy", "a"), (904, "only twice", "yy", "b"), (None, "ÉÈ 日本 語", "en", "a"), (1, rows[1][1], "en", "a")]
    rows += [(905, "long " * 30_000 + "日本", "en", "b"), (905, "日本 long", "en", "hot"), (905, "日本 long", "en", "hot")]
    return [(*r, 1, "z", "k", 2) for r in rows]


def hash_free(*parts):
    return sum(len(p or "") * 3 for p in parts)


@pytest.mark.parametrize("counted, listed", [(200_000, 200), (40, 3)])
def test_audit(spark, monkeypatch, counted, listed):
    monkeypatch.setattr(dv, "COUNTED", counted)
    monkeypatch.setattr(dv, "LISTED", listed)
    rows = table()
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(map(tuple, dv.audit(frame).select("lang", "source", "part", "item", "value", "rank").collect())) == plain(rows, listed)
    assert dv.audit(frame.limit(0)).count() == 0


def test_shares_of_counts_beyond_a_long_product(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(dv._share(F.lit(10**15 + 7), F.lit(3 * 10**15 + 1)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 8) // (3 * 10**15 + 1)

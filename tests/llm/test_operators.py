"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, spans string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text or ""))


def prose(rng, n):
    return " ".join(rng.choice("the of and night river stone under walks green seven hollow maple quiet amber north lantern".split()) for _ in range(n))


def table():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 80)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "hot", "hot"])) for i in range(60)]
    long = prose(rng, 3000)
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \t\n ", "en", "hot"), (103, long, "en", "hot"), (104, long + " tail", "fr", "b")]
    rows += [(105, long, "en", "b"), (7, rows[7][1], "en", "a"), (None, "no id here at all", "en", "a"), (106, "1234 !!", "en", "a"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), "x", "y") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), DOCS).repartition(3).persist()


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_backoff_scores(docs):
    from colloquy.llm.ngram_scores import backoff_scores

    texts = [(r[0], words(r[1])) for r in table()]
    count = [None, Counter(), Counter(), Counter()]
    for _, w in texts:
        for n in (1, 2, 3):
            count[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    size, expected = sum(count[1].values()), []
    for doc, w in texts:
        total = full = backed = 0
        for j in range(len(w)):
            value, level = count[1][w[j],] / size, 1
            for n in (2, 3):
                if j >= n - 1:
                    gram = tuple(w[j - n + 1 : j + 1])
                    if count[n][gram] >= 2:
                        value, level = count[n][gram] / count[n - 1][gram[:-1]], n
                    else:
                        value *= 0.4
            total, full, backed = total + round(math.log(value) * 1e6), full + (level == 3), backed + (level < min(j + 1, 3))
        expected.append((doc, len(w), full, backed, total))
    assert rows(backoff_scores(docs)) == sorted(expected, key=repr)


def plain_simhash(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(n):
                if linked(a, b) and root[a] < root[b]:
                    root[b], changed = root[a], True
    return root


def test_near_duplicates(docs):
    from colloquy.llm.simhash import near_duplicates

    prints = [(r[0], plain_simhash(r[1])) for r in table()]
    root = plain_components(len(prints), lambda a, b: (prints[a][1] ^ prints[b][1]).bit_count() <= 4)
    least = defaultdict(list)
    for (doc, _), c in zip(prints, root):
        least[c] += [doc] if doc is not None else []
    expected = [(doc, fp - (1 << 64) * (fp >> 63), min(least[c], default=None)) for (doc, fp), c in zip(prints, root)]
    assert rows(near_duplicates(docs)) == sorted(expected, key=repr)


@pytest.mark.parametrize("dense, hot", [(2, 1 << 16), (512, 1 << 16), (512, 6)])
def test_near_fingerprints_on_random_balls(spark, monkeypatch, dense, hot):
    from colloquy.llm import simhash
    from colloquy.llm.components import components

    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(1)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(15)}
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) * (v >> 63),) for v in values], "fingerprint long")
    found = {r.node: r.root for r in components(simhash.near_fingerprints(frame)).collect()}
    root = plain_components(len(values), lambda a, b: (values[a] ^ values[b]).bit_count() <= 4)
    signed = [v - (1 << 64) * (v >> 63) for v in values]
    ours = defaultdict(set)
    for v in signed:
        ours[found.get(v, v)].add(v)
    theirs = defaultdict(set)
    for v, c in zip(signed, root):
        theirs[c].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_deduplicated_keeps_columns_and_clean_rows(docs):
    from colloquy.llm.simhash import deduplicated, near_duplicates

    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r.component_id for r in near_duplicates(docs).collect()}


def test_deduplicated_with_an_id_of_several_groups(spark):
    from colloquy.llm.simhash import deduplicated, near_duplicates

    rng = random.Random(4)
    one, two, three = (prose(rng, 60) for _ in range(3))
    rows = [(1, one), (1, two), (1, two), (2, two), (3, three), (2, three), (None, one), (None, "alone in here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = Counter((r.doc_id, r.text) for r in deduplicated(frame).collect())
    assert left == Counter([(1, one), (1, two), (2, three), (None, "alone in here")])
    assert deduplicated(frame.limit(0)).count() == 0 and near_duplicates(frame.limit(0)).count() == 0


def test_stage_removes_copies_of_similarity_of_four_fifths(spark):
    import corpus_pipeline
    from colloquy.llm.simhash import fingerprint

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    rng = random.Random(21)
    texts = []
    for base in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(words))
        for changed in (1, 3, 4, 5, 6, 9):
            copy = list(words)
            for i in range(changed):
                copy[(i * 21 + base) % 200] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets, prints = [shingles(t) for t in texts], [fingerprint(t) for t in texts]

    def near(a, b):
        return (prints[a] ^ prints[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    assert any((prints[a] ^ prints[a + 3]).bit_count() > 4 and near(a, a + 3) for a in range(0, len(texts), 7))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    left = {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, frame, "").collect()}
    assert left == set(plain_components(len(texts), near))


@pytest.mark.parametrize("hot, together, unlike", [(4096, 1 << 22, 5000), (300, 5_000, 1500)])
def test_joined_finds_every_pair_amid_texts_that_share_a_passage(spark, monkeypatch, hot, together, unlike):
    from colloquy.llm import jaccard, simhash

    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    rng = random.Random(8)

    def own(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    passage, texts, alike = own(104), [], []
    for _ in range(10):
        base = own(40)
        near = [*base]
        near[15:18] = own(3)
        alike.append((len(texts), len(texts) + 1))
        texts += [passage + base, passage + near]
    # a group of one root, far larger than the rest, and one text near it
    large = [passage + own(3) for _ in range(unlike // 2)]
    alike.append((len(texts), len(texts) + 1))
    texts += large + [passage + own(40) for _ in range(unlike)]
    rng.shuffle(order := list(range(len(texts))))
    place = {at: i for i, at in enumerate(order)}
    root = [at if not 20 <= at < 20 + len(large) - 1 else 20 for at in range(len(texts))]
    docs = spark.createDataFrame([(place[at], " ".join(t)) for at, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    filed = simhash._profiles(docs, 4).withColumn("node", F.col("doc_id")).drop("fingerprint").persist()
    roots = spark.createDataFrame([(place[at], place[root[at]]) for at in range(len(texts))], "node long, root long")
    found = {r.node: r.root for r in jaccard.joined(filed, docs, roots).collect()}
    assert len(found) == len(texts)
    sets = [set(zip(*(t[i:] for i in range(5)))) for t in texts]
    for a, b in alike:
        assert len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and found[place[a]] == found[place[b]]
    assert len({found[place[at]] for at in range(20, 20 + len(large))}) == 1
    # texts that only share the passage stay apart
    assert len(set(found.values())) == 10 + 1 + unlike


def test_components_of_a_path_and_a_star(spark):
    from colloquy.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_personal(text):
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        out += [("card", m)] * (13 <= len(digits) <= 19 and luhn(digits))
    out += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_personal_data(spark, docs):
    from colloquy.llm.pii import digest, personal_data, sanitised

    rng = random.Random(3)
    bits = ["a@b.c_d@e.f", "x.y@z", "joe@mail.example.com", "10.0.0.255", "1.2.3.256", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é", "ü ", "9" * 40, "12 34", "@", "+", "..", "0255.1.1.1", "\U0001f600"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "  ", "-"]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    texts += [r[1] for r in table()] + ["1" * 5000, "a" * 5000 + "@", "1 " * 3000, "4111 1111 1111 1111 " * 20]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    found = {r.doc_id: r for r in digest(personal_data(frame)).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        expected = plain_personal(t or "")
        assert [s for s in found[i].spans.split(",") if s and not s.startswith("term")] == expected, t
        assert found[i].base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert (found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone) == tuple(sum(e.startswith(k) for e in expected) for k in ("email", "ip", "card", "phone"))
    near = [(i, f"Text {i}: agent Zebulon Quark writes from zq@spy.example.org today") for i in range(4)] + [(i, f"other words today number {i} writes text agent from") for i in range(4, 400)]
    frame = spark.createDataFrame([(*r, "k") for r in near], "doc_id long, text string, kind string")
    spans = {r.doc_id: r.spans for r in digest(personal_data(frame)).collect()}
    assert spans[0] == "email:40:58,term:14:21,term:22:27" and all(not spans[i] for i in range(4, 400))
    texts = {r.doc_id: r.text for r in sanitised(frame).collect()}
    assert texts[1] == "Text 1: agent   writes from [EMAIL] today" and texts[9] == near[9][1]
    assert digest(personal_data(docs.limit(0))).count() == 0


TERM = re.compile(r"[^\W\d_]{3,}")


def plain_terms(texts, context, sure, most):
    """The terms that give an entity away, place by place, from counts of rows."""
    base = [[tuple(s.split(":")) for s in plain_personal(t)] for t in texts]
    base = [[(k, int(a), int(b)) for k, a, b in spans] for spans in base]

    def entity(t, k, a, b):
        return k, t[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])

    free = [[(m.start(), m.end(), m[0].lower()) for m in TERM.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in spans)] for t, spans in zip(texts, base)]
    met = [{(entity(t, k, a, b), w) for k, a, b in spans for x, y, w in words if x >= a - context and y <= b + context} for t, spans, words in zip(texts, base, free)]
    n_both = Counter(p for pairs in met for p in pairs)
    n_entity = Counter(e for t, spans in zip(texts, base) for e in {entity(t, *s) for s in spans})
    n_term = Counter(w for t in texts for w in {m[0].lower() for m in TERM.finditer(t)})
    def left(e, w):
        n, z = max(n_term[w], n_both[e, w]), sure * sure
        p = n_both[e, w] / n
        return -math.log2((p + z / n / 2 - math.sqrt(z / n * p * (1 - p) + (z / n) ** 2 / 4)) / (1 + z / n))

    out = []
    for words, pairs in zip(free, met):
        told = {w for e, w in pairs if left(e, w) <= most and left(e, w) < math.log2(len(texts) / n_entity[e])}
        out.append([f"term:{a}:{b}" for a, b, w in words if w in told])
    return out


def test_telling_terms(spark):
    from colloquy.llm.pii import digest, personal_data

    rng = random.Random(31)
    names = ["Zebulon", "Quark", "Ostrava", "Ünal"]
    texts = []
    for i in range(150):
        words = prose(rng, rng.randint(1, 30)).split() + [rng.choice(names)] * rng.randint(0, 2)
        rng.shuffle(words)
        if i % 3 == 0:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["a@b.cd", "éjoe@mail.example.com,", "10.0.0.1", "+1 555 123 4567"]))
            words += ["far"] * rng.randint(0, 30) + rng.sample(names, 1)
        if i % 10 == 0:  # a rare word near a rare address, and again far from it
            rare = "Xu" + "abcdefghijklmno"[i // 10] * 3
            words = [rare, *words, *["far"] * 30, f"u{i}@b.cd", rare.upper()]
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], "", "a@b.cd", "x" * 200 + "@b.cd Quark"]
    frame = spark.createDataFrame([(None if i == 5 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(3)
    expected = Counter(",".join(plain_personal(t) + terms) for t, terms in zip(texts, plain_terms(texts, 60, 1.645, 2.0)))
    assert sum("term" in e for e in expected) > 5
    assert Counter(r.spans for r in digest(personal_data(frame)).collect()) == expected


def test_a_text_is_treated_alike_in_a_table_ten_times_as_large(spark):
    from colloquy.llm.pii import personal_data

    rng = random.Random(12)
    said = [f"Zebulon {['', 'Quark '][i % 2]}{prose(rng, 5)} zq@spy.example.org {prose(rng, 9)}" for i in range(6)]
    said += [f"{prose(rng, 4)} Halvard wrote hv@spy.example.org", f"{prose(rng, 4)} Halvard wrote nothing", f"{prose(rng, 4)} Halvard wrote nothing", f"Unica saw 10.1.2.3 {prose(rng, 3)}"]
    other = [(100 + i, prose(rng, 20)) for i in range(900)]
    found = []
    for more in (90, 900):
        frame = spark.createDataFrame([*enumerate(said), *other[:more]], "doc_id long, text string")
        found.append({r.doc_id: [tuple(s) for s in r.spans] for r in personal_data(frame).where(f"doc_id < {len(said)}").collect()})
    assert found[0] == found[1]
    words = {(said[i][a:b], action) for i, spans in found[0].items() for kind, a, b, action in spans if kind == "term"}
    assert ("Zebulon", "remove") in words and ("Unica", "generalise") in words and not any(w == "Halvard" for w, _ in words)


def test_personal_data_in_a_text_full_of_it(spark):
    import time

    from colloquy.llm.pii import digest, personal_data

    text = "mail joe@example.com or 10.0.0.1 now " * 12_000
    began = time.perf_counter()
    found = digest(personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (found.n_email, found.n_ip) == (12_000, 12_000) and found.base_sha256 == hashlib.sha256(",".join(plain_personal(text)).encode()).hexdigest()
    assert time.perf_counter() - began < 60


def test_near_vectors(spark):
    from colloquy.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(2)
    out = []
    for c in range(12):
        centre = rng.standard_normal(16)
        out += [(centre + rng.standard_normal(16) * 0.15, c % 3) for _ in range(12)]
    out += [(out[0][0], 0), (out[0][0], 0), (out[0][0], 1), (out[0][0] * 3, 0), (np.zeros(16), 0), (np.full(16, np.nan), 0), (np.full(16, np.inf), 1), (out[5][0], None), (out[5][0][:8], 2)]
    data = [(i, [float(np.float32(x)) for x in v], l, "x") for i, (v, l) in enumerate(out)]
    data += [(900, None, 0, "x"), (901, [], 0, "x"), (902, [None] + [1.0] * 15, 0, "x"), (None, data[3][1], 0, "x")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    ok = [d[0] is not None and d[2] is not None and bool(d[1]) and None not in d[1] and all(map(math.isfinite, d[1])) and any(d[1]) for d in data]

    def linked(a, b):
        if a == b or not (ok[a] and ok[b]) or data[a][2] != data[b][2] or len(data[a][1]) != len(data[b][1]):
            return False
        x, y = np.array(data[a][1]), np.array(data[b][1])
        return x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93

    root = plain_components(len(data), linked)
    expected = [(d[0], sum(linked(i, j) for j in range(len(data))), data[root[i]][0], d[0] == data[root[i]][0]) for i, d in enumerate(data)]
    assert rows(near_vectors(frame)) == sorted(expected, key=repr)
    assert rows(near_vectors(frame, bucket=4)) == sorted(expected, key=repr)
    assert near_vectors(frame.limit(0)).count() == 0


def test_near_vectors_recall_at_dimension_64(spark):
    from colloquy.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(17)
    centres = rng.standard_normal((500, 64))
    vectors = np.concatenate([centres, *[centres + rng.standard_normal((500, 64)) * s for s in (0.2, 0.27, 0.29)]]).astype(np.float32).astype(float)
    vectors = np.concatenate([vectors, vectors[:1] + rng.standard_normal((600, 64)) * 0.02])  # one large bucket
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    links = near.sum(1) - 1
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").repartition(4)
    found = {r.vec_id: r.n_links for r in near_vectors(frame, bucket=256).collect()}
    counted = np.array([found[i] for i in range(len(vectors))])
    assert (counted <= links).all() and links.sum() > 2000
    # of pairs beside the large bucket, which are the hard ones
    assert counted[1:2000].sum() >= 0.995 * links[1:2000].sum() and counted[2000:].sum() >= 0.999 * links[2000:].sum()
    repeated = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert rows(near_vectors(repeated)) == sorted([(1, 1, 1, True)] * 3 + [(2, 1, 1, False)], key=repr)


def test_nearest_codes(spark):
    from colloquy.llm.hamming_search import nearest_codes, sign_code

    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(150)] + [5] * 30 + [7]
    data = [(i, v - (1 << 64) * (v >> 63)) for i, v in enumerate(values)] + [(None, 1), (999, None), (3, values[3] - (1 << 64) * (values[3] >> 63))]
    frame = spark.createDataFrame(data, "id long, code long").repartition(3)
    queries = [0, 50, 100, 150, 160, 180]
    found = rows(nearest_codes(frame, frame.where(F.col("id").isin(*queries)), k=5))
    expected = []
    for q in queries:
        best = sorted(((values[q] ^ v).bit_count(), i) for i, v in enumerate(values) if i != q)[:5]
        expected += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
    assert found == sorted(expected, key=repr)
    chosen = frame.where(F.col("id").isin(*queries))
    assert rows(nearest_codes(frame, chosen, k=5, part=40, block=2)) == found
    assert nearest_codes(frame.limit(0), chosen, k=5).count() == 0 and nearest_codes(frame, frame.limit(0), k=5).count() == 0
    assert len(rows(nearest_codes(frame.where("id < 3"), chosen, k=5))) == 2 + 3 * 5
    code = spark.createDataFrame([([1.0, -1.0, None, 2.0, float("nan"), 0.0] + [1.0] * 58,)], "v array<float>").select(sign_code(F.col("v"))).first()[0]
    assert code % (1 << 64) == ((1 << 64) - 1) & ~0b110110
    with pytest.raises(Exception, match="more than 64"):
        spark.createDataFrame([([1.0] * 65,)], "v array<float>").select(sign_code(F.col("v"))).collect()


@pytest.mark.parametrize("small", [65_536, 1])
def test_mixed(spark, docs, small):
    from colloquy.llm.mixing import mixed, mixture

    found = mixed(docs, small=small).select("doc_id", "source", F.col("size__").alias("size"), F.col("source_size__").alias("total"), F.col("target__").alias("target"), F.col("taken__").alias("taken")).collect()
    data = table()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((r[0], r[3], len(words(r[1]))) for r in data)
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2 * sizes[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = Counter()
    for r in found:
        assert r.total == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert target[s] - 1 < taken[s] <= target[s]
    again = mixture(docs, small=small)
    assert again.columns == docs.columns
    assert Counter(w for r in again.collect() for w in [r.source] * len(words(r.text))) == taken
    assert all(r.n_chars == len(r.text) for r in again.collect())
    assert mixed(docs.limit(0)).count() == 0 and mixture(docs.limit(0)).count() == 0


def test_mixed_takes_the_smallest_keys_and_shares_repeats(spark):
    from colloquy.llm.mixing import mixed

    data = [(i, "word " * (i % 7 + 1), "ab"[i % 2]) for i in range(400)] + [(1000, "one two three", "c")] * 50 + [(1001, "junkjunkjunkjunkjunk " * 9, "c")]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    for small in (65_536, 3):
        found = mixed(frame, quality=F.when(F.col("source") == "a", 0.001).otherwise(F.col("doc_id") % 3 + 1), small=small).collect()
        for source, repeats in (("a", 1), ("b", 1), ("c", 50)):
            rows, target = [r for r in found if r.source == source], [r.target__ for r in found if r.source == source][0]
            total = rows[0].source_size__
            assert total == sum(r.size__ for r in rows) and target - repeats < sum(r.taken__ for r in rows) <= target
            quality = {r.doc_id: 0.001 if source == "a" else r.doc_id % 3 + 1 for r in rows}
            key = {r.doc_id: -math.log((int(hashlib.md5(f"42|{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / quality[r.doc_id] for r in rows}
            left, epochs = math.floor(target) - int(target / total) * total, int(target / total)
            if repeats == 1:
                for r in sorted(rows, key=lambda r: key[r.doc_id]):
                    part = min(left, r.size__)
                    assert r.taken__ == epochs * r.size__ + part
                    left -= part


def check_packed(data, found, path):
    """Every id in exactly one piece, sequences without gaps; the padding as a share of all ids, and what filled sequences hold."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = [(d[0], tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [2]) for d in data]
    by_id = defaultdict(list)
    for d, i in ids:
        by_id[d].append(i)
    pieces = Counter()
    for doc, i in ids:
        pieces[doc, len(i)] += len(i)
    for r in found:
        pieces[r.doc_id, r.doc_tokens] -= r.length
        assert any(zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for i in by_id[r.doc_id] if len(i) == r.doc_tokens)
    assert not any(pieces.values())
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    return padded / max(1, sum(len(i) for _, i in ids)), sum(r.length for r in found if r.sequence_id < 1 << 61)


@pytest.mark.parametrize("limit", [None, 3, 0])
def test_packed(spark, docs, limit):
    public = pytest.importorskip("public_tokenizers")
    from colloquy.llm.packing import packed

    path = public.path("word_bpe_49k.json")
    data = table() if limit is None else table()[:limit]
    data = [(*d[:1], (d[1] or "") + (" <|endoftext|>x İstanbul É́   a b" if d[0] == 5 else "") if d[1] is not None else None, *d[2:]) for d in data]
    data += [(300, "river seven " * 40_000, None, None, 0, "x", "y")] if limit is None else []
    padding, _ = check_packed(data, packed(spark.createDataFrame(data, DOCS).repartition(3), path).collect(), path)
    assert padding <= 0.02


@pytest.mark.parametrize("most", [12, 60, 600])
def test_packed_by_patterns(spark, most):
    public = pytest.importorskip("public_tokenizers")
    from colloquy.llm.packing import packed

    rng = random.Random(most)
    data = [(i, prose(rng, rng.randint(most // 3, most))) for i in range(150_000 // most)] + [(1_000_000 + i, None) for i in range(2000)]
    found = packed(spark.createDataFrame(data, "doc_id long, text string").repartition(4), public.path("word_bpe_49k.json")).collect()
    padding, filled = check_packed(data, found, public.path("word_bpe_49k.json"))
    assert padding <= 0.02 and (most == 600 or filled > 0)


def test_word_encoder_cuts_where_the_tokenizer_cuts():
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from colloquy.llm.packing import WordEncoder

    rng = random.Random(1)
    bits = ["don't", "a'S", "-'s", "'tis", "5's", "a5b", "T̈", "ẗ", "J̌", "É", "é", "İ", "<|endoftext|>", "<|", "“'s", "’s", "≠", "1́", "½", "…", "a…b", "A-b", "中文", "\xa0", "\n", " ", "K", "1,000", "!!a", "we'LL", "Ⅷ", "\x00", "\U0001f600"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randint(1, 15))) for _ in range(3000)]
    encoder = WordEncoder(public.path("word_bpe_49k.json"), most=2000)
    for at in range(0, 3000, 500):
        found = encoder.encode(pa.array(texts[at : at + 500]))
        assert [i.tolist() for i in found] == [e.ids for e in encoder.tokenizer.encode_batch(texts[at : at + 500], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from colloquy.llm.packing import WordEncoder

    tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(6)
    bits = ["The ", "don't", "  ", "\n\n", "É", "É", "42", "x_y", "…", "日本", "<|endoftext|>", "ing", "'LL", "\t", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(200)] + [None, ""]
    plain = Tokenizer.from_file(tokenizers.path(name))
    encoder = WordEncoder(tokenizers.path(name))
    assert encoder.cuts == name.startswith("word")
    found = encoder.encode(pa.array(texts, pa.string()))
    assert [f.tolist() for f in found] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_patterns_reach_the_bound():
    from colloquy.llm.packing import patterns

    rng = np.random.default_rng(0)
    sizes = np.array([7, 20, 33, 61, 100, 129, 180, 256])
    demand = rng.integers(500, 2000, len(sizes))
    used = patterns(demand, sizes, 512)
    assert all((c * sizes).sum() <= 512 for _, c in used)
    covered = sum(t * c for t, c in used)
    assert (covered <= demand).all() and covered.sum() > 0.97 * demand.sum()
    assert sum(t for t, _ in used) <= 1.02 * (covered * sizes).sum() / 512 + len(sizes)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_secrets(spark, docs):
    from colloquy.llm.secrets import BASE, checksum, digest, redacted, secret_spans

    rng = random.Random(4)
    bits = ["Password = 'abc", "token:", "toKen", "SECRET=", "api_key", "apikey : ", '"', "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGHIJ123456", "İ", "ſecret=abcdefg", "K", "é", " ", "=", "password=password=password", "passwd"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(300)] + [r[1] for r in table()]
    frame = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kind string").repartition(3)
    found = {r.doc_id: r for r in digest(secret_spans(frame)).collect()}
    for i, t in enumerate(texts):
        expected = plain_secrets(t or "")
        assert [s for s in found[i].spans.split(",") if s.split(":")[0] in BASE] == expected, t
        assert found[i].base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
    body = "".join(rng.choice("abcXYZ019") for _ in range(30))
    good, bad = f"ghp_{body}{checksum(body)}", f"ghp_{body}000000"
    frame = spark.createDataFrame([(1, f"use {good} now", "k"), (2, f"use {bad} now", "k"), (3, None, "k")], "doc_id long, text string, kind string")
    assert [r.spans for r in digest(secret_spans(frame)).orderBy("doc_id").collect()] == ["github:4:44", "", ""]
    assert [r.text for r in redacted(frame).orderBy("doc_id").collect()] == ["use [GITHUB] now", f"use {bad} now", None]
    assert secret_spans(docs.limit(0)).count() == 0


def test_secrets_with_checksums_and_long_runs(spark):
    import base64
    import json
    import time

    from colloquy.llm.secrets import checksum, digest, find_secrets, redacted, secret_spans

    def part(value):
        return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")

    body = "a1B2" * 7 + "xY"
    jwt = f"{part({'alg': 'HS256'})}.{part({'sub': 'me'})}.c2ln"
    der = base64.b64encode(b"\x30\x06" + b"abcdef").decode()
    short = base64.b64encode(b"\x30\x07" + b"abcdef").decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{der}\n-----END RSA PRIVATE KEY-----"
    cases = [(f"npm_{body}{checksum(body)}", "npm"), (f"npm_{body}000000", None), (jwt, "jwt"), (jwt.replace(".", "..", 1), None), ("eyJxx." + jwt, None), ("eyJxx " + jwt, "jwt"), (pem, "pem"), (pem.replace(der, short), None), (pem.replace("END RSA", "END"), None)]
    for text, kind in cases:
        found = [k for _, _, k in find_secrets(f"see {text} there") if k not in ("assign", "access", "hex")]
        assert found == ([kind] if kind else []), text
    began = time.perf_counter()
    for text in ("eyJ" * 300_000, "eyJ." * 200_000, "-----BEGIN PRIVATE KEY-----\n" * 20_000, "token" * 150_000, "password= " * 100_000, "AKIA" * 200_000, "f" * 1_000_000):
        find_secrets(text)
    assert time.perf_counter() - began < 30
    frame = spark.createDataFrame([(1, "token=abcdefgh", 14), (1, "token=abcdefgh", 14), (None, None, 0), (2, "", 0)], "doc_id long, text string, n_chars int")
    assert sorted(r.n_assign for r in digest(secret_spans(frame)).collect()) == [0, 0, 1, 1]
    assert sorted((r.text or "", r.n_chars) for r in redacted(frame).collect()) == [("", 0), ("", 0), ("[ASSIGN]", 8), ("[ASSIGN]", 8)]


def test_language(spark):
    from colloquy.llm.language import accepted, held_out, predictions, train

    rng = random.Random(6)
    parts = {"en": "the th ing and er on ou sh".split(), "de": "der sch ung ein ich ß ä und".split(), "es": "el ción os que ñ la ado".split()}
    data = []
    for i in range(300):
        lang = rng.choice(list(parts))
        data.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang, "s"))
    truth = {d[0]: d[2] for d in data}
    data = [(a, b, None if zlib.crc32(str(a).encode()) % 3 == 1 else c, d) for a, b, c, d in data]
    data += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 !? 34", "en", "s"), (None, "the and the ing", "en", "s")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, score string").repartition(3)
    model = train(frame, held_out(F.col("doc_id")))
    found = {r.doc_id: r for r in predictions(frame, model).collect()}
    assert model.languages == ("de", "en", "es") and (model.weights == 0).mean() > 0.5
    right = [found[i].lang_pred == lang for i, lang in truth.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(right) > 60 and np.mean(right) > 0.97
    assert all(found[i].lang_pred == "und" for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in found.values())
    assert {r.doc_id for r in accepted(frame, model).collect()} >= set(truth) - {i for i in truth if found[i].score < 0.5}
    empty = train(frame.limit(0), held_out(F.col("doc_id")))
    assert [tuple(r)[1:] for r in predictions(frame.limit(1), empty).collect()] == [("und", 0.0)]


def plain_counts(text):
    """The features of every 1-, 2- and 3-gram, one at a time."""
    points, mask, counts = list(map(ord, text.lower())), 0xFFFFFFFF, Counter()
    one = [p * 0x9E3779B1 & mask for p in points]
    for i in range(len(one)):
        two = three = None
        if i + 1 < len(one):
            two = ((one[i] ^ 0x5BD1E995) * 31 + one[i + 1]) & mask
        if i + 2 < len(one):
            three = ((two ^ 0x27D4EB2F) * 31 + one[i + 2]) & mask
        for value in (one[i], two, three):
            if value is not None:
                value = (value ^ value >> 15) * 0x85EBCA6B & mask
                counts[value >> 17] += 1
    return counts


def test_language_learns_from_no_held_out_row_and_scores_whole_texts(spark, monkeypatch):
    from colloquy.llm import language

    rng = random.Random(12)
    parts = {"en": "the th ing and er".split(), "de": "der sch ung ein ß".split()}
    data = [(i, " ".join(rng.choice(parts[l]) for _ in range(rng.randint(5, 40))), l, "x") for i in range(120) for l in [rng.choice(["en", "de"])]]
    data += [data[5]] * 40 + [(None, "the and", "en", "x"), (500, None, "de", "x"), (501, "der ein", None, "x")]
    schema = "doc_id long, text string, lang string, key string"
    learned = language.train(spark.createDataFrame(data, schema).repartition(3), language.held_out(F.col("doc_id")))
    changed = [(d, "zzz qqq " * 50, "xx", k) if d is not None and zlib.crc32(str(d).encode()) % 3 == 1 else (d, t, l, k) for d, t, l, k in data]
    again = language.train(spark.createDataFrame(changed, schema).repartition(5), language.held_out(F.col("doc_id")))
    assert learned.languages == again.languages == ("de", "en")
    assert np.array_equal(learned.weights, again.weights) and np.array_equal(learned.bias, again.bias)
    long = "the ing und sch " * 9000 + "İ ß"
    for chunk in (7, 1 << 16):
        monkeypatch.setattr(language, "CHUNK", chunk)
        for text in ("a", "ab", "The thing, ßen", long[:2000] if chunk == 7 else long):
            counts = plain_counts(text)
            assert {i: n for i, n in enumerate(language.gram_counts(text).tolist()) if n} == counts
            logits = [learned.bias[k] + sum(n * float(learned.weights[i, k]) for i, n in counts.items()) / sum(counts.values()) for k in range(2)]
            odds = [math.exp(x - max(logits)) for x in logits]
            lang, score = learned.predict(text)
            assert lang == learned.languages[logits.index(max(logits))] and score == pytest.approx(max(odds) / sum(odds), rel=1e-4)
    tied = language.Model(("de", "en"), np.zeros((language.FEATURES, 2), np.float32), np.zeros(2))
    assert tied.predict("abc") == ("de", 0.5)  # ties go to the language that sorts first


def test_licenses(spark, docs):
    from colloquy.llm.licenses import PHRASES, TEMPLATES, license_scan

    rng = random.Random(8)
    bits = ["Under the MIT", "license", "License", "under", "the", "mit", "apache license", "version 2", "version 2.0", "CC-BY-NC", "cc by", "nc", "é", " ", "\n", ",", "cc", "by"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "", "-", ". "]) for _ in range(rng.randint(1, 25))) for _ in range(300)] + [r[1] for r in table()]
    frame = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(3)
    found = {r.doc_id: r for r in license_scan(frame).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        places, labels = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            places, labels = places + at, labels | ({label} if at else set())
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), t
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    full = re.sub(r"<<[^>]*>>", " ", TEMPLATES[0][1])
    short = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", TEMPLATES[0][1])
    broken = full.replace("sublicense", "license")
    frame = spark.createDataFrame([(1, "Copyright X. " + full.upper()), (2, short + " end"), (3, broken), (4, full[:200])], "doc_id long, text string")
    assert [r.labels for r in license_scan(frame).orderBy("doc_id").collect()] == ["mit", "mit", "", ""]
    assert license_scan(docs.limit(0)).count() == 0


def test_licenses_need_their_last_clause_and_their_own_elements():
    from colloquy.llm.licenses import TEMPLATES, scan_text

    for label, template in TEMPLATES:
        full = re.sub(r"<<(?:var|number):[0-9]+>>", " 4 ", re.sub(r"<<(?:begin|end)Optional>>", " ", template))
        assert label in scan_text("Notice. " + full)[5].split(","), label
        if len(full) > 400:
            tail = full.split()
            # a phrase that names the license may stand in it, which scores less than its wording
            assert scan_text(" ".join(tail[:-1]))[6] < 1 and scan_text(" ".join([*tail[:-2], "otherwise", *tail[-2:]]))[6] < 1
    cases = {"": "cc-by", "-NonCommercial": "cc-by-nc", "-NoDerivatives": "cc-by-nd", "-ShareAlike": "cc-by-sa", "-NonCommercial-ShareAlike": "cc-by-nc-sa", "-NonCommercial-NoDerivatives": "cc-by-nc-nd"}
    for name, label in cases.items():
        for version in (" 4.0 International", " 3.0 Unported", ""):
            assert scan_text(f"This work is licensed under a Creative Commons Attribution{name}{version} License.")[5:] == (label, 1.0)


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from colloquy.llm.secrets import find_secrets, redact

    rng = random.Random(11)
    parts = {"en": "the th ing and er on ou sh".split(), "de": "der sch ung ein ich ß ä und".split()}

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    data = [(i, text(lang, rng.randint(30, 60)), lang, rng.choice(["a", "b"])) for i in range(80) for lang in [rng.choice(["en", "de"])]]
    data += [(100 + i, data[i][1], data[i][2], "b") for i in range(10)]
    data += [(200, data[3][1] + ' password = "hunter2hunter2"' + text("en", 200), "en", "a"), (201, "1234 5678", "en", "a"), (202, None, None, None), (203, "", "de", "b")]
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), frame.schema)
        assert docs.columns == frame.columns
        seen[name] = docs.collect()
    by_id = {d[0]: d for d in data}
    assert {r.doc_id for r in seen["language"]} == set(by_id) - {201, 202, 203}
    left = {r.doc_id for r in seen["near_duplicates"]}
    prints = {i: plain_simhash(by_id[i][1]) for i in left | {r.doc_id for r in seen["language"]}}
    ids = sorted(prints)
    root = plain_components(len(ids), lambda a, b: (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 4)
    assert left == {ids[r] for r in root}
    texts = {r.doc_id: r.text for r in seen["secrets"]}
    assert set(texts) == left and all(t == redact(by_id[i][1], find_secrets(by_id[i][1])) for i, t in texts.items()) and "[ASSIGN]" in texts[200] and "hunter2" not in texts[200]
    counted, taken = Counter(), Counter()
    for i in left:
        counted[by_id[i][3]] += len(words(texts[i]))
    for r in seen["mixing"]:
        taken[r.source] += len(words(r.text))
    assert sum(taken.values()) == pytest.approx(1.5 * sum(counted.values()), abs=2)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0).keys() == {r.doc_id for r in seen["mixing"]}
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in seen["mixing"])


def test_pipeline_of_an_empty_table_and_of_odd_rows(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars int, rank__ string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    rng = random.Random(2)
    odd = [(None, None, None, None), (None, prose(rng, 40), "en", None), (None, prose(rng, 40), "en", "a"), (5, prose(rng, 50), "en", "a"), (5, "", "en", None), (7, " ", None, "b")]
    odd += [odd[3]] * 3 + [(9, prose(rng, 4000), "en", "b")]
    spark.createDataFrame([(*r, 0, "x") for r in odd], schema).write.parquet(str(tmp_path / "odd/documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "odd/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, str(tmp_path)).collect()
        assert [f.name for f in spark.createDataFrame(kept, docs.schema).schema] == docs.columns
        docs = spark.createDataFrame(kept, docs.schema)
        if name == "near_duplicates":
            assert Counter(r.doc_id for r in kept) == Counter([None, None, 5, 9])
        if name == "mixing":
            assert all(r.n_chars == len(r.text) for r in kept)


def test_backoff_scores_of_an_empty_table_and_of_one_row_repeated(spark):
    from colloquy.llm.ngram_scores import backoff_scores

    frame = spark.createDataFrame([(None, "a b c a")] * 50 + [(1, "")], "doc_id long, text string").repartition(3)
    found = rows(backoff_scores(frame))
    assert len(found) == 51 and len(set(found)) == 2 and (1, 0, 0, 0, 0) in found
    a, b = math.log(100 / 200), math.log(50 / 100)  # a; a b
    expected = round(a * 1e6) + round(b * 1e6) + 2 * round(math.log(1.0) * 1e6)
    assert [r for r in found if r[0] is None][0][1:] == (4, 2, 0, expected)
    assert backoff_scores(frame.limit(0)).count() == 0

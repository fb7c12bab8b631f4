"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams of the lower-cased text, hashed to ``FEATURES`` columns, as relative frequencies times inverse document
frequencies.  The document frequencies are counted over all documents that may be learned from.  The weights are trained by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded sample of labelled documents, ``per_language`` of each language; a
temperature fitted on a part of the sample that the weights have not seen calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, texts

FEATURES = 1 << 15
#: The bound of the training sample: documents of each language.
PER_LANGUAGE = 500
CHUNK = 1 << 16
UNKNOWN = "und"


def _mixed(points: np.ndarray) -> np.ndarray:
    points ^= points >> np.uint32(15)
    points *= np.uint32(0x85EBCA6B)
    return points >> np.uint32(32 - FEATURES.bit_length() + 1)


def gram_counts(text: str) -> np.ndarray:
    """How often each feature occurs among the 1-, 2- and 3-grams of ``text``, which is gone through in pieces of ``CHUNK`` characters."""
    text = text.lower()
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        one = points * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(31) + one[1:]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(31) + one[2:]
        counts += np.bincount(_mixed(np.concatenate([one[:CHUNK], two[:CHUNK], three[:CHUNK]])), minlength=FEATURES)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """``weights`` (features x languages, float32) have the inverse document frequencies and the temperature multiplied in."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its probability; ``und`` with score 0 where there is no letter, or nothing was learned."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        counts = gram_counts(text)
        logits = self.bias + counts.astype(np.float32) @ self.weights / counts.sum()
        odds = np.exp(logits - logits.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents of ``docs`` each feature occurs, and how many there are.  What reaches the driver is one row per feature."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for _, part in texts(batch):
                for text in part:
                    if text:
                        seen[:-1] += gram_counts(text) > 0
                    total += 1
        seen[-1] = total
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["feature", "n"])

    rows = map_arrow(docs.select("text"), scan, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(FEATURES + 1, np.int64)
    counts[rows["feature"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts[:-1], int(counts[-1])


def _sample(labelled: DataFrame, per_language: int) -> list:
    """(language, features, frequencies) of up to ``per_language`` documents of each language, those with the smallest hashes; a repeated row counts once."""
    keyed = labelled.withColumn("key", F.xxhash64("doc_id", "text"))
    # four times the wanted share of the hashes holds the smallest ones but for a chance that never happens, and is all that is put in order
    share = keyed.groupBy("lang").agg((4 * per_language / F.approx_count_distinct("key")).alias("share"))  # a row a language
    least = keyed.select("lang", "key").join(F.broadcast(share), "lang").where(F.col("key") / 2.0**64 + 0.5 <= F.col("share"))
    ranked = least.select("lang", "key").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    keys = ranked.where(F.col("rank") <= per_language).select("lang", "key")  # per_language rows of each language: broadcast within that bound
    chosen = keyed.join(F.broadcast(keys), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column(0).to_pylist()
            for at, part in texts(batch):
                out = []
                for language, text in zip(languages[at:], part):
                    counts = gram_counts(text)
                    used = np.flatnonzero(counts)
                    out.append((language, used.astype("<u4").tobytes(), (counts[used] / counts.sum()).astype("<f4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary()))], ["lang", "used", "share"])

    rows = map_arrow(chosen.select("lang", "text"), scan, "lang string, used binary, share binary").collect()
    rows = sorted((r["lang"], bytes(r["used"]), bytes(r["share"])) for r in rows)
    return [(a, np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(c, "<f4").astype(np.float64)) for a, b, c in rows]


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, steps: int = 6000, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and bias of multinomial logistic regression by FTRL-proximal with elastic-net penalties.

    The rows are gone through four times, or as often as makes ``steps`` steps of a small sample.
    """
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def solve(used):
        zu, nu = z[used], n[used]
        w = -(zu - np.sign(zu) * l1) / ((beta + np.sqrt(nu)) / alpha + l2)
        return np.where(np.abs(zu) <= l1, 0.0, w)

    for epoch in range(max(4, -(-steps // max(1, len(rows))))):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            y, used, x = rows[i]
            used, x = np.append(used, FEATURES), np.append(x, 1.0)
            w = solve(used)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None]
            nu = n[used]
            z[used] += g - (np.sqrt(nu + g * g) - np.sqrt(nu)) / alpha * w
            n[used] = nu + g * g
    w = solve(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The factor on the logits, from 1/16 to 64, with the least log loss; 1 without data."""
    if not len(truth):
        return 1.0

    def loss(t):
        s = logits * t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(truth)), truth]).mean())

    return min((2.0 ** (k / 8) for k in range(-32, 49)), key=loss)


def train(docs: DataFrame, held_out: Column, per_language: int = PER_LANGUAGE) -> Model:
    """A model learned from the text and non-null lang of the rows of ``docs`` that are not ``held_out``, and from nothing else.

    Document frequencies are of all those rows, a repeated row counted each time.  Rows without a letter teach nothing; with no labelled row the
    model knows no language.
    """
    teach = docs.where(F.col("lang").isNotNull() & ~held_out & F.col("text").rlike(r"\p{L}"))
    counts, total = _document_frequencies(teach)
    idf = np.log((1 + total) / (1 + counts)) + 1
    rows = _sample(teach.select("doc_id", "lang", "text"), per_language)
    languages = tuple(sorted({r[0] for r in rows}))
    weighed = []
    for language, used, share in rows:
        x = share * idf[used]
        weighed.append((languages.index(language), used, x, np.sqrt((x * x).sum())))
    typical = float(np.median([r[3] for r in weighed])) if weighed else 1.0
    weighed = [(y, used, x / typical) for y, used, x, _ in weighed]
    tune = [r for i, r in enumerate(weighed) if i % 5 == 4]
    learn = [r for i, r in enumerate(weighed) if i % 5 != 4]
    if not languages:
        return Model((), np.zeros((FEATURES, 0), np.float32), np.zeros(0))
    weights, bias = ftrl(learn, len(languages))
    logits = np.array([bias + x @ weights[used] for _, used, x in tune])
    scale = temperature(logits, np.array([y for y, _, _ in tune], int))
    return Model(languages, (weights * idf[:, None] / typical * scale).astype(np.float32), bias * scale)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` from its whole text alone.

    Text that is null or has no letter is ``und`` with score 0; null ids are kept, repeated rows stay repeated, no row gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # features x languages: its size does not depend on the rows

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in texts(batch):
                found = [sent.value.predict(t) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is known with a score of ``least`` or more.

    Null, empty and letterless texts have no language and go; null ids and other columns are kept, repeated rows stay repeated, no row gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t) for _, part in texts(batch) for t in part]
            yield batch.filter(pa.array([a != UNKNOWN and b >= least for a, b in found], pa.bool_()))

    return map_arrow(docs, scan, docs.schema)

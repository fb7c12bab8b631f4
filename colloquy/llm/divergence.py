"""How far sources of a language are apart: chi-square-like divergences of smoothed term shares, in whole numbers, by inclusion-exclusion over supports.

A pair of sources has a summand for every kept term of the language, but most terms occur in neither or in one of them.  With a value f(p, q)
for a term of shares p and q, and z the share of a term that does not occur, the sum over all V terms is

    V f(zg, zh) + sum over g's terms of (f(p, zh) - f(zg, zh)) + sum over h's terms of (f(zg, q) - f(zg, zh)) + sum over both's of the rest,

where the one-sided sums need only how many terms of a source occur how often (a histogram), and only terms that occur in both are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_arrow, pairs, saved, texts, whole_groups

SCALE = 1_000_000_000
#: A term is kept that is in so many documents of its language; terms are listed to this rank.
LEAST_DOCUMENTS, LISTED = 3, 200
#: Distinct terms that a task counts before it passes them on.
COUNTED = 200_000
#: A-Z become small, other ASCII that is no letter becomes a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of letters and of everything beyond ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _counted(most: int):
    """(lang, source, term, n, docs) of a task's documents (lang, source, text), added up as far as ``most`` terms go."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def put() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                columns = [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array([t.decode("utf-8", "surrogatepass") for t in n]), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield from pa.Table.from_arrays(columns, ["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=50_000)
            counts.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in texts(batch):
                for lang, source, text in zip(langs[at:], sources[at:], part):
                    if not (own := Counter(terms(text))):
                        continue
                    n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                    held -= len(n)
                    n.update(own)
                    docs.update(own.keys())
                    held += len(n)
                    if held >= most:
                        yield from put()
                        held = 0
        yield from put()

    return scan


def _share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / whole), exact at any size; ``whole`` is N + V, and there is no term where it is 0."""
    product = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    return F.call_function("div", product, whole.cast("decimal(20,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums (lang, source, item, value) over the terms that two sources of a language share, from (lang, term, source, p, z) in the order of a
    number for each (lang, term), ``key``."""

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    for table in whole_groups(batches, "key", 50_000):
        key, p, z = (table[c].to_numpy() for c in ("key", "p", "z"))
        lang, source, term = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "source", "term"))
        word, known = term.indices.to_numpy(), len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64) * known + source.indices.to_numpy()
        for a, b in pairs(key):
            same = (group[a] // known == group[b] // known) & (word[a] == word[b])  # two terms may have one number
            a, b = a[same], b[same]
            for i, j in ((a, b), (b, a)):
                value = apart(p[i], p[j]) - apart(p[i], z[j]) - apart(z[i], p[j]) + apart(z[i], z[j])
                both, place = np.unique(group[i] * known + group[j] % known, return_inverse=True)
                total = np.zeros(len(both), np.int64)
                np.add.at(total, place, value)
                columns = [lang.dictionary.take(pa.array(both // known // known)), source.dictionary.take(pa.array(both // known % known)), source.dictionary.take(pa.array(both % known)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of each language of ``docs`` (text, lang, source, any other columns).

    Part ``pair``: every other source of the language with the sum of floor((p - q)^2 / q) over all kept terms, p of ``source`` and q of ``item``; 0 where
    no term is kept.  Part ``term``: the ``LISTED`` terms of the source that it has most beyond its language, by the same value.  A term is kept that is
    in ``LEAST_DOCUMENTS`` rows of its language.  Nulls are empty strings, and the empty string is a language and a source like others; a repeated
    row is a document of its own; a source without a term has pairs but no terms; ties go by the item's bytes.  No row gives no row.
    """
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = map_arrow(read, _counted(COUNTED), "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    alike = Window.partitionBy("lang", "term")
    summed = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = summed.withColumn("in__", F.sum("docs").over(alike)).withColumn("total", F.sum("n").over(alike)).where(F.col("in__") >= LEAST_DOCUMENTS)
    kept = saved(kept.select("lang", "term", "source", "n", "total"))

    # V and N of a language, N of a source, and the share of a term that it does not have
    vocabulary = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = read.select("lang", "source").distinct().join(vocabulary, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "size"])
    groups = groups.withColumn("all", F.col("size") + F.col("v")).withColumn("lang_all", F.col("lang_n") + F.col("v"))
    groups = saved(groups.withColumn("z", F.when(F.col("v") > 0, _share(F.lit(0), F.col("all"))).otherwise(0)))

    shares = kept.join(groups.select("lang", "source", "all", "lang_all", "z"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("all")))
    above = shares.withColumn("q", _share(F.col("total"), F.col("lang_all"))).where("p > q")
    telling = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LISTED)

    # every two sources of a language: the constant, then what is added by the terms of one and of both
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("item_z"))
    both = groups.select("lang", "source", "v", "z").join(other, "lang").where("source <> item")
    constant = both.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _apart(F.col("z"), F.col("item_z"))).otherwise(0).alias("value"))
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    priced = both.select("lang", "source", "item", "z", "item_z").join(histogram, ["lang", "source"])
    own = F.col("times") * (_apart(F.col("p"), F.col("item_z")) - _apart(F.col("z"), F.col("item_z")))
    theirs = F.col("times") * (_apart(F.col("item_z"), F.col("p")) - _apart(F.col("item_z"), F.col("z")))
    priced = priced.groupBy("lang", "source", "item").agg(_total(own).alias("own"), _total(theirs).alias("theirs"))
    one_sided = priced.select("lang", "source", "item", F.col("own").alias("value")).union(priced.select("lang", "item", "source", "theirs"))
    posted = shares.select("lang", "term", "source", "p", "z", F.xxhash64("lang", "term").alias("key")).repartition("key").sortWithinPartitions("key")
    shared = map_arrow(posted, _overlaps, "lang string, source string, item string, value long")
    value = constant.union(one_sided).union(shared).groupBy("lang", "source", "item").agg(_total(F.col("value")).cast("long").alias("value"))
    value = value.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    out = saved(value.unionByName(telling))
    forget(kept, groups)
    return out


def _total(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,0)"))

"""A corpus cleaned and packed for training: five stages, each a table of documents in and a table out.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir).  All but the last return the columns of ``documents``; where a stage changes
texts, ``n_chars`` counts the new ones.  In every stage an empty table gives an empty one, null ids are kept, repeated rows are rows like others and
columns more than those of ``documents`` are carried along; null and empty texts end with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import jaccard, language, mixing, packing, secrets, simhash
from colloquy.llm.common import forget, saved


#: Rows that pass to a Python worker at a time.  Documents are long; batches of Spark's default size, held on both sides, are what takes most memory.
BATCH = 1000


def _in_small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is less likely than not; all others stay unchanged."""
    _in_small_batches(spark)
    return language.accepted(docs, language.train(docs, language.held_out(F.col("doc_id"))))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one with the smallest doc_id: fingerprints near by op2, or five-word similarity of 0.8 or more."""
    _in_small_batches(spark)
    return simhash.deduplicated(docs, similar=jaccard.SIMILAR)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    _in_small_batches(spark)
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps, cuts or leaves out documents so that each source comes to its target."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    _in_small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The first stage trains a model, which SQL cannot express; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        last, docs = docs, saved(stage(spark, docs, sf_dir))
        forget(last)  # what a stage has read is not needed once it is written
    return STAGES[-1][1](spark, docs, sf_dir)

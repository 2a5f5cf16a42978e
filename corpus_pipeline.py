"""From raw documents to token ids: quality, duplicates, repeated passages, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents.
"""

import uuid

from pyspark.sql import functions as F

from vacantia.llm import bpe, fertility, minhash, mixing, suffixes
from vacantia.llm.shared import ready
from vacantia.session import checkpoint_dir, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark, docs, sf_dir):
    """Documents whose base rules and tokeniser fertility hold; the others go."""
    return fertility.measure(docs).filter("kept").select(*COLUMNS)


def minhash_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return minhash.deduplicate(docs, shingle=5, percent=80).select(*COLUMNS)


def suffix_dedup(spark, docs, sf_dir):
    """Documents without the bytes that a repeated 200-byte string covers; emptied ones stay, empty."""
    return suffixes.without_repeats(docs).select(*COLUMNS)


def source_mix(spark, docs, sf_dir):
    """Documents as often as the mixture of sources takes them; a repeat is a row of its own."""
    return mixing.mix(docs).select(*COLUMNS)


def bpe_encode(spark, docs, sf_dir):
    """Token ids of every document of the mixture, with what they decode to as a hash."""
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", minhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("source mixing", source_mix),
    ("byte-level bpe", bpe_encode),
]

#: Fertility, MinHash, suffixes and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``; each is written and read again."""
    spark = prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ready(docs)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.withColumn("ids", F.col("ids").cast("array<int>"))

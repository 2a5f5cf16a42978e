"""Settings, stored tables and column helpers that the operators of this subpackage share."""

import uuid

from pyspark.sql import functions as F

from vacantia.session import checkpoint_dir

#: Rows per Arrow batch; texts inside a batch are cut further by ``texts.chunks``.
BATCH_ROWS = 500


def ready(df):
    """Session of ``df``, with Arrow batches of bounded size."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def stored(df):
    """Write ``df`` as Parquet to the shared checkpoint folder and read it again.

    Cuts the lineage: a lost executor costs only its own tasks, and later steps neither
    recompute the texts nor keep shuffle files alive.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df, id_col="doc_id", text_col="text"):
    """Only id and text, under names no other column can clash with."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_key(text):
    """16 bytes that equal texts share."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def word_count(text):
    """Number of maximal runs free of ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")

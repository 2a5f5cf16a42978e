"""Search for a substring by an index of trigrams over a stored order."""

import sys
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vacantia.operators import order_index

#: Buckets of the index: a search reads one for each trigram of its term.
BUCKETS = 256
INDEX = "gram string, _range int, bucket int"


def _grams(text):
    """The distinct trigrams (of characters) of a text; none of shorter texts."""
    return {text[k : k + 3] for k in range(len(text) - 2)}


def _range_grams(texts):
    """``_range, gram`` of rows ``_range`` and ``text`` (in lower case): the trigrams of a range once for each batch of rows."""
    def run(batches):
        for batch in batches:
            ranges, grams = [], []
            for number, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), lambda r: r[0]):
                found = set().union(*(_grams(t) for _, t in rows if t))
                ranges += [number] * len(found)
                grams += found
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(grams, pa.string())], ["_range", "gram"])

    return texts.mapInArrow(run, "_range int, gram string")


def _bucket(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_text_index(df, columns, order, path, rows=order_index.RANGE_ROWS):
    """Store ``df`` in an order and, for every trigram of ``columns``, the ranges that hold it.

    An order that brings like texts together makes for few ranges per trigram. The index has
    at most a row for each trigram and range, whatever the rows.
    """
    order_index.write_order(df, order, path, rows)
    spark = df.sparkSession
    schema = StructType([*df.schema.fields, StructField("_range", IntegerType())])
    stored = spark.read.schema(schema).parquet(f"{path}/data")
    texts = stored.select("_range", F.explode(F.array(*columns)).alias("text"))
    distinct = _range_grams(texts.select("_range", F.lower("text"))).distinct().withColumn("bucket", _bucket(F.col("gram")))
    distinct.repartition("bucket").sortWithinPartitions("bucket", "gram", "_range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")


def candidate_ranges(spark, path, term):
    """Ranges that hold all trigrams of the term; None where the term is too short to tell."""
    grams = sorted(_grams(spark.range(1).select(F.lower(F.lit(term))).first()[0]))
    if not grams:
        return None
    buckets = spark.range(1).select(F.array(*[_bucket(F.lit(g)) for g in grams])).first()[0]
    index = spark.read.schema(INDEX).parquet(f"{path}/grams")
    hits = index.filter(F.col("bucket").isin(sorted(set(buckets))) & F.col("gram").isin(grams))
    full = hits.groupBy("_range").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    return sorted(r["_range"] for r in full.select("_range").collect())


def search(spark, path, schema, term, where):
    """Stored rows for which ``where`` holds, a condition that implies that an indexed column has ``term`` in it.

    Only the ranges with all trigrams of the term are read; the condition itself decides. Terms of
    one or two characters read everything.
    """
    ranges = candidate_ranges(spark, path, term)
    if ranges is None:
        return spark.read.schema(schema).parquet(f"{path}/data").filter(where)
    return order_index.read_ranges(spark, path, schema, ranges).filter(where)


# the function over batches travels with the job, so that workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

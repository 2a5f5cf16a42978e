"""Table orders and exact chunk numbers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.session import scratch_path


def canonical_keys():
    """Company, then title, in lower case; the url settles ties."""
    empty = F.lit("")
    return [F.lower(F.coalesce("company", empty)), F.lower(F.coalesce("title", empty)), F.coalesce("url", empty)]


def canonical_order():
    return [key.asc() for key in canonical_keys()]


def jobs_db_order():
    return [F.col("first_seen").desc_nulls_last(), F.lower("company").desc(), F.col("job_id").asc()]


def with_row_numbers(df, order, folder=None, keys=None):
    """Add ``row_number`` (from 0) in the given order without a single-task window.

    The table is range-partitioned and sorted once, then numbered by ``number_rows``. ``keys`` are the
    expressions of an order that ascends in all: a sort works its expressions out at every comparison, so
    they become columns first.
    """
    ranged = df.repartitionByRange(*order)
    if keys:
        named = {f"_key{k}": key for k, key in enumerate(keys)}
        return number_rows(ranged.withColumns(named).sortWithinPartitions(*named).drop(*named), folder)
    return number_rows(ranged.sortWithinPartitions(*order), folder)


def number_rows(df, folder=None):
    """Add ``row_number`` (from 0) to a sorted table, in the order its rows have.

    The table is written to ``folder`` (by default a new one among the intermediate tables),
    which the caller may drop once the result is used; row counts per partition then turn
    positions within partitions into global ones.
    """
    folder = folder or scratch_path(df.sparkSession, "numbered")
    placed = (
        df.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
        .withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    placed.write.parquet(folder)
    placed = df.sparkSession.read.schema(placed.schema).parquet(folder)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    # one row per partition of the table, so neither the window nor the broadcast grows with the data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn("row_number", F.col("_start") + F.col("_at"))
        .drop("_part", "_at", "_start")
    )


def with_chunks(df, order, rows=fixed.CHUNK_ROWS, folder=None, keys=None):
    """Add ``chunk``: rows 0..rows-1 in chunk 0 and so on."""
    numbered = with_row_numbers(df, order, folder, keys)
    return numbered.withColumn("chunk", F.floor(F.col("row_number") / rows).cast("bigint"))

"""A stored order: sorted ranges with counts and statistics, so that a page, a box of the map or a
search reads its own ranges only.

``data/_range=k`` holds the rows of range ``k`` of the order, ``index`` a row for each range:
its number, its rows, the rows before it and what ``stats`` asks for.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vacantia import fixed_values as fixed

#: Rows of a range.
RANGE_ROWS = 1_000_000
#: Sorted parts of a table at most: the splitters of each are sampled by way of the driver. Ranges are cut inside the parts.
PARTS = 200
#: Numbers of ranges that a part may use.
PART_RANGES = 1 << 22
INDEX = "_range int, rows bigint, start bigint"


def write_order(df, order, path, rows=RANGE_ROWS, stats=None):
    """Store ``df`` in the given order, in ranges of about ``rows`` rows.

    ``order`` should end in columns that identify a row. The table is counted, sampled for the
    splitters of PARTS parts at most, shuffled and sorted once; the ranges are cut from the sorted
    parts, so what the driver sees does not grow with their number. ``stats`` (name to
    aggregate) go into the index, a value for each range.
    """
    ranges = max(1, math.ceil(df.count() / rows))
    parts = min(ranges, PARTS)
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    if ranges > parts:
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        number = F.spark_partition_id() * F.lit(PART_RANGES) + F.floor(at / rows).cast("int")
    else:
        number = F.spark_partition_id()
    placed = placed.withColumn("_range", number)
    placed.sortWithinPartitions("_range", *order).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/data")
    written = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/data")
    counts = written.groupBy("_range").agg(F.count("*").alias("rows"), *[agg.alias(n) for n, agg in (stats or {}).items()])
    _started(counts).write.mode("overwrite").parquet(f"{path}/index")


def _started(counts):
    """Counts per range with the rows before each: one row per range, 10 ** 6 of them for 10 ** 12 rows."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def read_ranges(spark, path, schema, ranges):
    """Rows of some ranges; no other file is listed."""
    folders = [f"{path}/data/_range={k}" for k in ranges]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def page(spark, path, schema, order, number=1, size=fixed.PAGE_SIZES[0], where=None):
    """One page of a stored order; a page number out of range falls back to 1.

    Without ``where`` the index tells the one or two ranges that the page lies in, and only
    their files are listed and read. With a filter the ranges are counted anew under it, a
    scan of the filter's columns without a sort, and again only the page's ranges are sorted.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    if where is not None:
        rows = spark.read.schema(StructType([*schema.fields, StructField("_range", IntegerType())])).parquet(f"{path}/data").filter(where)
        index = _started(rows.groupBy("_range").agg(F.count("*").alias("rows")))
    total = index.agg(F.max(F.col("start") + F.col("rows"))).first()[0] or 0
    pages = math.ceil(total / size)
    if number < 1 or number > pages > 0:
        number = 1
    first = (number - 1) * size
    overlap = (F.col("start") < first + size) & (F.col("start") + F.col("rows") > first)
    ranges = index.filter(overlap).orderBy("_range").select("_range", "start").collect()
    if not ranges:
        return spark.createDataFrame([], schema)
    rows = read_ranges(spark, path, schema, [r["_range"] for r in ranges])
    if where is not None:
        rows = rows.filter(where)
    return rows.orderBy(*order).offset(first - ranges[0]["start"]).limit(size)

"""State in hash buckets: a batch rewrites only the buckets that its keys fall into.

``data/version=n/bucket=b`` holds bucket ``b`` as batch ``n`` left it; ``index/version=n`` names,
for every bucket, the version in force after batch ``n``. Index ``n`` is a function of index ``n - 1``
and batch ``n``, so a batch that is run again overwrites its own version only. The index has a
row for each bucket, whatever the state holds; those rows are all the driver sees.
"""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vacantia.session import drop_path
from vacantia.streaming.tables import latest_version, version_path

BUCKETS = 256
INDEX = "bucket int, version bigint, buckets int, stamp string"
#: Index row of the state as a whole: number of buckets and the stamp of the last batch.
WHOLE = -1


def bucket_of(keys, buckets):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _schema(schema):
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def with_fields(schema, ddl):
    """A schema and further fields."""
    return StructType([*_schema(schema).fields, *_schema(ddl).fields])


def read_index(spark, path, version):
    """``{bucket: version}`` after a batch, its number of buckets and its stamp; a missing index is an error."""
    rows = spark.read.schema(INDEX).parquet(version_path(f"{path}/index", version)).collect()
    whole = next(r for r in rows if r["bucket"] == WHOLE)
    return {r["bucket"]: r["version"] for r in rows if r["bucket"] != WHOLE}, whole["buckets"], whole["stamp"]


def _write_index(spark, path, version, index, buckets, stamp):
    rows = [(b, v, buckets, stamp) for b, v in [*sorted(index.items()), (WHOLE, version)]]
    spark.createDataFrame(rows, INDEX).coalesce(1).write.mode("overwrite").parquet(version_path(f"{path}/index", version))


def _folder(path, bucket, version):
    return f"{version_path(f'{path}/data', version)}/bucket={bucket}"


def read_buckets(spark, path, index, schema):
    """The rows of some buckets in the versions named."""
    folders = [_folder(path, b, v) for b, v in sorted(index.items())]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read_state(spark, path, schema, version=None):
    """The whole state after the last batch, or after ``version``; no rows before the first."""
    version = latest_version(spark, f"{path}/index") if version is None else version
    if version is None:
        return spark.createDataFrame([], _schema(schema))
    return read_buckets(spark, path, read_index(spark, path, version)[0], _schema(schema))


def last_stamp(spark, path):
    """What the last batch was stamped with; None before the first."""
    version = latest_version(spark, f"{path}/index")
    return None if version is None else read_index(spark, path, version)[2]


def _write(spark, rows, path, version, keys, buckets):
    """Write rows by bucket; the buckets that got any."""
    folder = version_path(f"{path}/data", version)
    dealt = rows.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    written = spark.read.schema(with_fields(rows.schema, "bucket int")).parquet(folder)
    return [r["bucket"] for r in written.select("bucket").distinct().collect()]


def fold_buckets(stream, path, schema, keys, step, checkpoint, prepare=None, stamp=None, initial=None, buckets=BUCKETS):
    """Run ``state = step(batch, state, epoch)`` over all available micro-batches, bucket by bucket.

    ``prepare(batch)`` adds the key columns where rows lack them. ``step`` sees the batch and
    the state rows of its buckets, and returns what these buckets hold from then on, with columns of
    ``schema``. ``stamp(epoch)`` is a text kept with the batch's index. A batch without rows
    changes no bucket.
    """
    schema = _schema(schema)

    def on_batch(batch, epoch):
        spark = batch.sparkSession
        if epoch > 0:
            index, number, _ = read_index(spark, path, epoch - 1)
            if number != buckets:
                raise ValueError(f"{path} has {number} buckets, not {buckets}")
        else:
            newest = latest_version(spark, f"{path}/index")
            if newest is not None and newest > 0:
                raise ValueError(f"{path} holds version {newest}, but the stream starts at batch 0: restore its checkpoint")
            index = {}
            if initial is not None:
                index = dict.fromkeys(_write(spark, initial.select(*schema.names), path, -1, keys, buckets), -1)
        rows = prepare(batch) if prepare else batch
        touched = [r["_bucket"] for r in rows.select(bucket_of(keys, buckets).alias("_bucket")).distinct().collect()]
        if touched:
            state = read_buckets(spark, path, {b: index[b] for b in touched if b in index}, schema)
            filled = _write(spark, step(rows, state, epoch).select(*schema.names), path, epoch, keys, buckets)
            index = {b: v for b, v in index.items() if b not in set(touched)} | dict.fromkeys(filled, epoch)
        _write_index(spark, path, epoch, index, buckets, stamp(epoch) if stamp else None)

    return (
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def drop_old(spark, path, keep=2):
    """Remove bucket versions that none of the last ``keep`` indexes names; the number removed.

    Not while a stream runs. A batch can only be run again from the index before it.
    """
    newest = latest_version(spark, f"{path}/index")
    if newest is None:
        return 0
    kept = [read_index(spark, path, v)[0].items() for v in range(max(0, newest - keep + 1), newest + 1)]
    oldest = max(0, newest - keep + 1)
    removed = 0
    named = {pair for items in kept for pair in items}
    for version in range(oldest - 1, -1, -1):
        try:
            before = read_index(spark, path, version)[0]
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                break
            raise
        for bucket, at in before.items():
            if (bucket, at) not in named:
                drop_path(spark, _folder(path, bucket, at))
                named.add((bucket, at))
                removed += 1
        drop_path(spark, version_path(f"{path}/index", version))
    return removed

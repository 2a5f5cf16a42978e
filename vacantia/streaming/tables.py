"""State tables kept by ``foreachBatch``: every micro-batch writes the next version.

Version ``n`` is a function of version ``n - 1`` and batch ``n``. A batch that is run
again after a failure overwrites its own version only, so results stay exact, and each
version is read back from files, so no lineage builds up.
"""

from pyspark.sql import functions as F

from vacantia.sources.files import or_empty


def version_path(path, version):
    return f"{path}/version={version}"


def read_version(spark, path, version, schema):
    """A version that must be there: a missing one is an error, not an empty state."""
    return spark.read.schema(schema).parquet(version_path(path, version))


def version_before(spark, path, epoch, schema, initial=None):
    """State that batch ``epoch`` starts from.

    The first batch starts from ``initial`` (or nothing), but only where no version exists:
    after a lost checkpoint epochs count from 0 again, and then going on would overwrite
    what is there.
    """
    if epoch > 0:
        return read_version(spark, path, epoch - 1, schema)
    newest = latest_version(spark, path)
    if newest is not None and newest > 0:
        raise ValueError(f"{path} holds version {newest}, but the stream starts at batch 0: restore its checkpoint")
    return initial if initial is not None else spark.createDataFrame([], schema)


def latest_version(spark, path):
    """Highest version in the folder, from the file listing alone; None when empty."""
    files = or_empty(
        spark,
        lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").load(path).select("path"),
        "path string",
    )
    return files.agg(F.max(F.regexp_extract("path", r"version=(\d+)", 1).cast("int"))).first()[0]


def read_latest(spark, path, schema):
    version = latest_version(spark, path)
    return spark.createDataFrame([], schema) if version is None else read_version(spark, path, version, schema)


def fold(stream, path, schema, step, checkpoint, initial=None, also=None):
    """Run ``state = step(batch, state)`` over all available micro-batches.

    ``also(batch, state, epoch)`` may write further results of a batch before its state.
    """
    def on_batch(batch, epoch):
        spark = batch.sparkSession
        state = version_before(spark, path, epoch, schema, initial)
        if also is not None:
            also(batch, state, epoch)
        step(batch, state).write.mode("overwrite").parquet(version_path(path, epoch))

    return (
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

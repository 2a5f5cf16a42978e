"""The recurring jobs as streams over landing folders."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.operators import facets, merge, seen
from vacantia.operators.joins import last_per_group
from vacantia.plans.jobs import alert_cycle
from vacantia.schemas import STATE_SEEN
from vacantia.streaming import buckets
from vacantia.streaming.tables import fold, latest_version, read_version, version_before, version_path


def files(spark, path, schema, per_batch=1, file_format="parquet"):
    """Landing folder as a stream, ``per_batch`` files per micro-batch."""
    return spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", per_batch).load(path)


def _last_day(batch, name):
    """The run's day: the latest in the batch (one value)."""
    return batch.agg(F.max(name)).first()[0]


def seen_stream(sightings, path, checkpoint, days=fixed.PRUNE_DAYS, initial=None):
    """Seen state over ``job_id, day``: expiry counts from the last sighting of an id.

    A batch without sightings has no day and leaves the state as it is.
    """
    def step(batch, state):
        day = _last_day(batch, "day")
        return state if day is None else seen.next_state(batch, state, day, days)

    return fold(sightings, path, STATE_SEEN, step, checkpoint, initial)


def merge_stream(scrapes, path, checkpoint, as_of, order, days=fixed.RETENTION_DAYS, initial=None, n_buckets=buckets.BUCKETS):
    """Rolling table of postings: every landed scrape is laid over the kept rows of its buckets.

    ``as_of(epoch)`` is the time of each run as text, never before the one of the run before. Rows that grow
    too old leave with the next batch that touches their bucket; ``merged_table`` leaves them out before that.
    """
    def step(batch, state, epoch):
        stamp = F.lit(as_of(epoch)).cast("timestamp")
        return merge.merge(state.drop("posting_key"), batch.drop("posting_key"), stamp, order, days)

    return buckets.fold_buckets(
        scrapes, path, buckets.with_fields(scrapes.schema, "posting_key string"), ["posting_key"], step, checkpoint,
        prepare=merge.with_posting_key, stamp=as_of, initial=initial, buckets=n_buckets)


def merged_table(spark, path, schema, days=fixed.RETENTION_DAYS):
    """The rolling table after the last run; rows too old by then are left out.

    Buckets that the last run touched have had their old rows dropped by it; its own rows stay
    whatever their age, as in ``merge``.
    """
    schema = buckets.with_fields(schema, "posting_key string")
    version = latest_version(spark, f"{path}/index")
    if version is None:
        return spark.createDataFrame([], schema)
    index, _, stamp = buckets.read_index(spark, path, version)
    now, before = [{b: v for b, v in index.items() if (v == version) == touched} for touched in (True, False)]
    kept = buckets.read_buckets(spark, path, before, schema).filter(
        merge.is_fresh(F.col("scraped_at"), F.lit(stamp).cast("timestamp"), days))
    return buckets.read_buckets(spark, path, now, schema).union(kept)


def alert_stream(postings, snapshots, path, checkpoint, as_of, row_id, keep=(), days=fixed.PRUNE_DAYS, **answers):
    """Alert run per landed batch; open and new jobs are written next to the state.

    ``as_of(epoch)`` gives the time of each run.
    """
    def on_batch(batch, epoch):
        spark = batch.sparkSession
        state = version_before(spark, f"{path}/state", epoch, STATE_SEEN)
        cycle = alert_cycle(
            batch, snapshots, state, as_of(epoch), row_id=row_id, keep=keep, days=days,
            verified_at=version_path(f"{path}/verified", epoch), **answers)
        cycle.open_jobs.write.mode("overwrite").parquet(version_path(f"{path}/open", epoch))
        cycle.new_jobs.write.mode("overwrite").parquet(version_path(f"{path}/new", epoch))
        cycle.state.write.mode("overwrite").parquet(version_path(f"{path}/state", epoch))

    return (
        postings.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


COMPANY_ROWS = "company string, jobs bigint"


def progressive_stream(postings, path, checkpoint):
    """Rows per company as the table grows chunk by chunk; see ``board_progress``."""
    def step(batch, state):
        counts = batch.groupBy("company").agg(F.count("*").alias("jobs"))
        return state.union(counts).groupBy("company").agg(F.sum("jobs").alias("jobs"))

    return fold(postings, path, COMPANY_ROWS, step, checkpoint)


def board_progress(spark, path, version):
    """Board statistics after a chunk."""
    return read_version(spark, path, version, COMPANY_ROWS).agg(
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"), F.count("company").alias("companies")
    )


DEAD = "platform string, slug string"


def dead_slug_stream(dead, path, checkpoint, n_buckets=buckets.BUCKETS):
    """Cache of dead slugs (``DEAD``) that grows run by run, in buckets; ``buckets.read_state`` reads it."""
    def step(batch, state, epoch):
        return state.union(batch.select("platform", "slug")).distinct()

    return buckets.fold_buckets(dead, path, DEAD, ["platform", "slug"], step, checkpoint, buckets=n_buckets)


STATUS = "key string, status string, ts timestamp, event_id bigint"


def status_stream(events, path, checkpoint, toggle=False):
    """Current status per key from set events; with ``toggle`` a repeat clears it."""
    def step(batch, state):
        both = state.unionByName(batch.select("key", "status", "ts", "event_id"))
        if not toggle:
            return last_per_group(both, ["key"], ["ts", "event_id"])
        last = both.groupBy("key").agg(F.max(F.struct("ts", "event_id")).alias("at"))
        return facets.toggled_status(both).join(last, "key").select("key", "status", "at.ts", "at.event_id")

    return fold(events, path, STATUS, step, checkpoint)

"""Writers of chunks, manifest, reports, state and feeds."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.display import published_at, rfc822
from vacantia.operators.order import canonical_keys, canonical_order, jobs_db_order, with_chunks
from vacantia.schemas import SLIM_COLUMNS, SLIM_TYPES
from vacantia.session import drop_path, scratch_path
from vacantia.sources import chunk_set
from vacantia.sources.files import read_manifest


def slim(postings):
    """The front-end fields only; absent ones are null."""
    have = set(postings.columns)
    return postings.select(*[F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in SLIM_TYPES.items()])


def with_initial(salaries):
    """Shard letter of a lookup row: the first character of its key."""
    return salaries.withColumn("initial", F.lower(F.left("key", F.lit(1))))


def write_chunks(postings, folder, last_updated, rows=fixed.CHUNK_ROWS):
    """Sorted slim postings as gzip JSON arrays of ``rows`` rows, then the manifest that names them.

    The rows are stored as they come, as a sort goes over its input twice, and sorted once into
    a scratch table, which gives them their numbers, and dealt out by chunk. The new set lies beside the published one until all its chunks are
    written; the manifest then changes over in one step (``sources.chunk_set``), so a run that
    fails leaves the old set as it was. Returns the manifest: chunks, totalJobs, last_updated.
    """
    spark = chunk_set.register(postings.sparkSession)
    came, scratch = scratch_path(spark, "slim"), scratch_path(spark, "numbered")
    fields = [
        F.when(F.col("coords").isNotNull(), F.array("coords.lat", "coords.lng")).alias("coords") if n == "coords" else F.col(n)
        for n in SLIM_COLUMNS
    ]
    try:
        postings = slim(postings)
        postings.write.parquet(came)
        numbered = with_chunks(spark.read.schema(postings.schema).parquet(came), canonical_order(), rows, scratch, canonical_keys())
        drop_path(spark, came)
        lines = numbered.select("chunk", "row_number", F.to_json(F.struct(*fields)).alias("line"))
        dealt = lines.repartition("chunk").sortWithinPartitions("chunk", "row_number").select("chunk", "line")
        dealt.write.format(chunk_set.FORMAT).mode("overwrite").option("last_updated", last_updated).save(folder)
    finally:
        for path in (came, scratch):
            drop_path(spark, path)
    return read_manifest(spark, folder)


def _write_document(one_row, path):
    one_row.coalesce(1).write.mode("overwrite").json(path)


def metadata(totals, last_updated, source="automated"):
    """Published summary from the one-row run totals."""
    return totals.select(
        F.lit(last_updated).alias("last_updated"), "total_companies", "active_companies", "total_jobs", "recruiter_jobs",
        F.lit(source).alias("source_type"), F.lit(fixed.SOURCE_LABELS).alias("platforms"),
    )


def with_merged_total(meta, merged):
    """Metadata with the row count of the merged table instead of the scrape's."""
    count = merged.agg(F.count("*").alias("total_jobs"))
    both = meta.drop("total_jobs").unionByName(count, allowMissingColumns=True)
    return both.agg(*[F.max(n).alias(n) for n in meta.columns])


def write_table(df, path, by=None):
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_all_jobs(postings, path):
    write_table(postings, path, by="ats")


def write_companies(companies, path):
    companies.select("slug").distinct().orderBy("slug").write.mode("overwrite").json(path)


def write_active_companies(counts, path):
    counts.groupBy("slug").agg(F.sum("jobs").alias("jobs")).orderBy("slug").write.mode("overwrite").json(path)


def write_dead_slugs(old, new, path):
    """Union of the known and the newly dead, sorted."""
    old.union(new).distinct().orderBy("platform", "slug").write.mode("overwrite").json(path)


def write_salary_shards(salaries, path):
    """Lookup rows in one folder per initial."""
    rows = with_initial(salaries)
    rows.repartition("initial", F.pmod(F.xxhash64("key"), F.lit(16))).write.mode("overwrite").partitionBy("initial").json(path)


def append_trend(day, path):
    """Write the day's record; writing a day again replaces it."""
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def jobs_db(jobs, last_updated):
    """Envelope of the open alert jobs, newest first: total, stamp and rows.

    The rows stay a table; ``write_jobs_db`` writes the envelope next to it.
    """
    ordered = jobs.orderBy(*jobs_db_order())
    envelope = jobs.agg(F.lit(last_updated).alias("last_updated"), F.count("*").alias("total"))
    return envelope, ordered


def write_jobs_db(jobs, path, last_updated):
    envelope, ordered = jobs_db(jobs, last_updated)
    ordered.write.mode("overwrite").json(f"{path}/jobs")
    _write_document(envelope, f"{path}/envelope")


def feed_items(new_jobs, as_of, feed_link):
    """Feed rows of the new jobs, newest first; one notice row when there are none."""
    stamp = F.lit(as_of).cast("timestamp")
    empty = F.lit("")
    place = F.when(F.coalesce("location", empty) != "", F.col("location")).otherwise(F.lit("Not specified"))
    seen = F.coalesce(F.date_format("first_seen", "yyyy-MM-dd"), empty)
    items = new_jobs.select(
        F.concat_ws(" — ", F.coalesce("title", F.lit("Untitled")), F.coalesce("company", empty)).alias("title"),
        F.coalesce("application_url", empty).alias("link"),
        F.concat(
            F.coalesce("title", empty), F.lit(" at "), F.coalesce("company", empty), F.lit(" ("), place, F.lit(") via "),
            F.coalesce("platform_source", empty), F.lit(". First seen: "), seen, F.lit("."),
        ).alias("description"),
        published_at(F.col("date_posted").cast("string"), F.col("first_seen").cast("string"), stamp).alias("published"),
        F.coalesce("job_id", "application_url").alias("guid"),
        F.coalesce("platform_source", empty).alias("category"),
    )
    notice = new_jobs.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.concat(F.lit("No new matches this run ("), F.date_format(stamp, "yyyy-MM-dd HH:mm"), F.lit(" UTC)")).alias("title"),
        F.lit(feed_link).alias("link"),
        F.lit("The alert system ran but found no new listings matching your filters.").alias("description"),
        stamp.alias("published"),
        F.concat(F.lit("no-new-"), F.date_format(stamp, "yyyyMMddHHmm")).alias("guid"),
        F.lit(None).cast("string").alias("category"),
    )
    rows = items.unionByName(notice).withColumn("pubDate", rfc822(F.col("published")))
    return rows.orderBy(F.col("published").desc(), "guid").drop("published")


def write_feed(items, path):
    items.write.mode("overwrite").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)


def write_seen(state, path):
    """A new version of the state as its own folder; readers take the latest one."""
    state.orderBy("job_id").write.mode("overwrite").parquet(path)

"""Mergeable counts of distinct companies: a sketch per chunk, united when read."""

from pyspark.sql import functions as F

from vacantia.functions.text import first_non_empty
from vacantia.streaming.tables import version_path

#: A sketch has 2 ** LOG_K registers; the standard error of its count is about 1.04 / sqrt(2 ** LOG_K), 1.6 percent.
LOG_K = 12
CHUNK = "jobs bigint, recruiter_jobs bigint, companies binary"


def sketched(postings, *by):
    """Rows, recruiter rows and the sketch of companies, per group of ``by`` or in all (``CHUNK``)."""
    names = [F.col(n) for n in ("company_slug", "company") if n in postings.columns]
    recruiters = F.count_if("is_recruiter") if "is_recruiter" in postings.columns else F.lit(0).cast("bigint")
    return postings.groupBy(*by).agg(
        F.count("*").alias("jobs"), recruiters.alias("recruiter_jobs"), F.hll_sketch_agg(first_non_empty(*names), LOG_K).alias("companies"))


def united(sketches, *by):
    """Totals over many chunks; the companies of several chunks count once, within the sketch's error."""
    companies = F.hll_sketch_estimate(F.hll_union_agg("companies"))
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"), F.coalesce(F.sum("recruiter_jobs"), F.lit(0)).alias("recruiter_jobs"),
        F.coalesce(companies, F.lit(0)).alias("companies"))


def sketch_stream(postings, path, checkpoint):
    """One sketch row for every landed chunk: a batch writes that row and reads nothing back."""
    def on_batch(batch, epoch):
        sketched(batch).write.mode("overwrite").parquet(version_path(path, epoch))

    return (
        postings.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def progress(spark, path, version):
    """Board statistics after chunk ``version``, from the sketches of the chunks up to it."""
    rows = spark.read.schema(f"{CHUNK}, version int").parquet(path)
    return united(rows.filter(F.col("version") <= version))

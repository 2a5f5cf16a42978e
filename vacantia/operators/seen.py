"""First and last sighting of every job, carried from run to run."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.operators.joins import first_per_group, lookup_join


def mark_new(jobs, seen, row_id):
    """Add ``is_new``: the first row (by ``row_id``) of every id the state does not hold.

    ``row_id`` names columns that together identify a row. The join back runs on them,
    not on the job id, so copies of one job cannot pile up in a task.
    """
    firsts = first_per_group(jobs.select("job_id", *row_id), ["job_id"], row_id)
    new_rows = firsts.join(seen.select("job_id"), "job_id", "left_anti").select(
        *row_id, F.lit(True).alias("is_new")
    )
    return jobs.join(new_rows, list(row_id), "left").withColumn(
        "is_new", F.coalesce("is_new", F.lit(False))
    )


def _refreshed(jobs, seen, today):
    current = jobs.select("job_id").distinct().withColumn("_current", F.lit(True))
    return seen.join(current, "job_id", "full").select(
        "job_id",
        F.when(F.col("_current") & F.col("first_seen").isNull(), today).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(F.col("_current"), today).otherwise(F.col("last_seen")).alias("last_seen"),
        "_current",
    )


def next_state(jobs, seen, today, days=fixed.PRUNE_DAYS):
    """State after a run: current ids refreshed or added, ids unseen for too long dropped."""
    today = F.lit(today).cast("date")
    kept = F.col("_current") | (F.col("last_seen") >= F.date_sub(today, days))
    return _refreshed(jobs, seen, today).filter(kept).drop("_current")


def refresh(jobs, seen, today):
    """State with current ids refreshed or added and nothing pruned."""
    return _refreshed(jobs, seen, F.lit(today).cast("date")).drop("_current")


def prune(seen, current_ids, today, days=fixed.PRUNE_DAYS):
    """Drop ids that are not current and were last seen before ``today - days``."""
    current = current_ids.select("job_id").distinct().withColumn("_current", F.lit(True))
    cutoff = F.date_sub(F.lit(today).cast("date"), days)
    return (
        seen.join(current, "job_id", "left")
        .filter(F.col("_current") | (F.col("last_seen") >= cutoff))
        .drop("_current")
    )


def attach_state(jobs, state):
    """Jobs with their first_seen and last_seen (null where the state has none)."""
    return lookup_join(jobs.drop("first_seen", "last_seen"), state, "job_id")


def empty_state(spark):
    """State to start from, also after a reset."""
    return spark.createDataFrame([], "job_id string, first_seen date, last_seen date")

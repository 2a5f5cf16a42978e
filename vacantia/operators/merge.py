"""Rolling merge of scrapes: keyed upsert with a retention window."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.classify import posting_key
from vacantia.operators.joins import last_per_group


def with_posting_key(df):
    """Add ``posting_key`` and drop rows that have none."""
    return df.withColumn(
        "posting_key", posting_key(F.col("ats"), F.col("company"), F.col("url"))
    ).filter("posting_key IS NOT NULL")


def is_fresh(scraped_at, as_of, days=fixed.RETENTION_DAYS):
    """At most ``days`` whole days old; rows without a readable stamp count as fresh."""
    stamp = F.try_to_timestamp(scraped_at)
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(stamp)) / F.lit(86400))
    return F.coalesce(age <= days, F.lit(True))


def stale_count(existing, as_of, days=fixed.RETENTION_DAYS):
    return with_posting_key(existing).agg(
        F.count_if(~is_fresh(F.col("scraped_at"), as_of, days)).alias("stale")
    )


def merge(existing, new, as_of, order, days=fixed.RETENTION_DAYS):
    """Fresh existing rows with new rows laid over them, one row per posting key.

    A new row beats an existing one; inside a side the last row by ``order`` wins.
    """
    kept = with_posting_key(existing).filter(is_fresh(F.col("scraped_at"), as_of, days))
    sides = kept.withColumn("_side", F.lit(0)).unionByName(
        with_posting_key(new).withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    return last_per_group(sides, ["posting_key"], ["_side", *order]).drop("_side")

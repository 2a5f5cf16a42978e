"""Joins and first-row picks that stay even when one key holds much of the table."""

from functools import reduce
from operator import or_

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


def _order(columns):
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def lookup_join(left, right, on, how="left", implied=()):
    """Join one row per key (``right``) onto rows whose keys may be very uneven.

    A result grouped by ``on`` is already partitioned by it, so Spark would join it in
    place and a hot key of ``left`` would end in one task. The extra hash key asks for a
    fresh shuffle of both sides, which is the shape AQE can split into even parts. Where
    ``right`` proves small at run time AQE turns the join into a broadcast instead. Rows with
    a null key match nothing; they are dealt out by their other columns, not into one task.
    ``implied`` names columns that follow from others: they add nothing to that and need not be worked out for it.
    """
    on = [on] if isinstance(on, str) else list(on)
    key = F.xxhash64(*on)
    right = right.dropna(subset=on)
    if how == "inner":
        left, spread = left.dropna(subset=on), key
    else:
        plain = [f.name for f in left.schema.fields if not isinstance(f.dataType, MapType | VariantType)]
        some = [n for n in plain if n not in implied] or plain
        no_key = reduce(or_, [F.col(c).isNull() for c in on])
        spread = F.when(no_key, F.xxhash64(*[F.col(f"`{c}`") for c in some])).otherwise(key)
    return (
        left.withColumn("_key_hash", spread)
        .join(right.withColumn("_key_hash", key), ["_key_hash", *on], how)
        .drop("_key_hash")
    )


def first_per_group(df, keys, order, n=1):
    """First ``n`` rows of every group.

    Spark limits each group inside the map tasks before the shuffle, so a hot group
    sends at most ``n`` rows per task to the reducer.
    """
    window = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def last_per_group(df, keys, order):
    return first_per_group(df, keys, [c.desc() for c in _order(order)])

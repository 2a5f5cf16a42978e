"""State kept by key: a run writes what its own keys change, not the whole state.

The state lives in the stream's checkpoint (RocksDB with a changelog); every change is also
a row of an append-only log of Parquet files. ``read_state`` reads the former, ``last_changes``
rebuilds the state from the latter.
"""

import datetime as dt
import sys
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vacantia import fixed_values as fixed
from vacantia.operators.joins import last_per_group
from vacantia.sources.files import or_empty

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
DAY_MS = 86_400_000


@contextmanager
def key_store(spark):
    """The store of keyed state for the streams started inside; other streams keep their own."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _millis(day):
    return (day - dt.date(1970, 1, 1)).days * DAY_MS


class SeenProcessor(StatefulProcessor):
    """First and last sighting of one job, and a timer for as long as it is known.

    Every call to the state is a round trip out of Python, so a sighting reads and writes the state and leaves
    the timer alone; a timer that runs out after a later sighting is set anew to the day that follows from it.
    """

    def __init__(self, days):
        self.days = days

    def init(self, handle):
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_seen date, last_seen date")

    def _timer(self, last_seen):
        # at noon of the last day that keeps the job; runs move the watermark from midnight to midnight
        return _millis(last_seen) + self.days * DAY_MS + DAY_MS // 2

    def handleInputRows(self, key, rows, timerValues):
        today = max(row["day"] for row in rows)
        old = self.seen.get()
        # the watermark is the last run's day: what that run would have dropped has only not been swept yet
        known = old is not None and self._timer(old[1]) >= timerValues.getCurrentWatermarkInMs()
        if old is not None and not known:
            yield Row(job_id=key[0], first_seen=old[0], last_seen=old[1], change="gone")
        first = old[0] if known else today
        self.seen.update((first, today))
        if old is None:
            self.handle.registerTimer(self._timer(today))
        yield Row(job_id=key[0], first_seen=first, last_seen=today, change="seen" if known else "new")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.seen.get()
        due = self._timer(old[1])
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return
        self.seen.clear()
        yield Row(job_id=key[0], first_seen=old[0], last_seen=old[1], change="gone")

    def handleInitialState(self, key, initialState, timerValues):
        self.seen.update((initialState["first_seen"], initialState["last_seen"]))
        self.handle.registerTimer(self._timer(initialState["last_seen"]))

    def close(self):
        pass


SEEN_CHANGE = "job_id string, first_seen date, last_seen date, change string"


def keyed_seen_stream(sightings, log, checkpoint, days=fixed.PRUNE_DAYS, initial=None):
    """Seen state over ``job_id, day`` with a timer per job; ``day`` is the run's day on all its rows.

    The log gets a row for every job of a run (``change`` is ``new`` or ``seen``) and one for every job
    whose timer ran out (``gone``), ``days`` days after its last sighting. Expiry needs no pass
    over the state. Runs land in the order of their days: rows of a day before the last run's
    are late and do not count. Rows without job or day count nowhere; a run without rows changes nothing.

    ``initial`` (``job_id, first_seen, last_seen``) is the state to start from, as after a lost checkpoint.
    """
    timed = sightings.filter("job_id IS NOT NULL AND day IS NOT NULL").withColumn(
        "_at", F.col("day").cast("timestamp")).withWatermark("_at", "0 seconds")
    start = None if initial is None else initial.filter("job_id IS NOT NULL").groupBy("job_id")
    changes = timed.groupBy("job_id").transformWithState(
        SeenProcessor(days), SEEN_CHANGE, "Append", "EventTime", initialState=start)
    return _logged(changes, log, checkpoint)


class StatusProcessor(StatefulProcessor):
    """The current status of one key; with ``toggle`` setting it once more clears it."""

    def __init__(self, toggle):
        self.toggle = toggle

    def init(self, handle):
        self.status = handle.getValueState("status", "status string, micros bigint, event_id bigint")

    def handleInputRows(self, key, rows, timerValues):
        events = [(row["micros"], row["event_id"], row["status"]) for row in rows]
        if self.status.exists():
            status, micros, number = self.status.get()
            events.append((micros, number, status))
        # an unreadable stamp comes first, as in an ascending sort
        events.sort(key=lambda e: [(x is not None, x or 0) for x in e[:2]])
        now = None
        for event in events:
            now = None if self.toggle and now is not None and now == event[2] else event[2]
        micros, number, _ = events[-1]
        if now is None:
            self.status.clear()
        else:
            self.status.update((now, micros, number))
        yield Row(key=key[0], status=now, micros=micros, event_id=number)

    def close(self):
        pass


STATUS_CHANGE = "key string, status string, micros bigint, event_id bigint"


def keyed_status_stream(events, log, checkpoint, toggle=False):
    """Current status per key from set events (``key, status, ts, event_id``); the log gets a row per key and batch.

    A null status deletes. Rows without a key count nowhere.
    """
    stamped = events.filter("key IS NOT NULL").select("key", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id")
    changes = stamped.groupBy("key").transformWithState(StatusProcessor(toggle), STATUS_CHANGE, "Append", "None")
    return _logged(_with_ts(changes), log, checkpoint)


def _with_ts(rows):
    return rows.select(*[F.timestamp_micros("micros").alias("ts") if n == "micros" else n for n in rows.columns])


def _has_files(spark, path):
    files = or_empty(
        spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path"), "path string")
    return not files.isEmpty()


def _logged(changes, log, checkpoint):
    """Start the stream. The files of a log belong to one checkpoint and are written once."""
    spark = changes.sparkSession
    if _has_files(spark, log) and not _has_files(spark, f"{checkpoint}/commits"):
        raise ValueError(
            f"{log} was written under another checkpoint: restore that one, or begin a new log "
            "with the last state of this one as initial")
    with key_store(spark):
        return (
            changes.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )


def read_state(spark, checkpoint, name):
    """Keyed state of a stopped stream: its key and value columns. ``name`` is ``seen`` or ``status``."""
    rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return _with_ts(rows.select("key.*", "value.*"))


def last_changes(log):
    """The seen state a log of changes ends in."""
    order = [F.col("last_seen"), F.col("change") == "gone", F.col("first_seen")]
    return last_per_group(log, ["job_id"], order).filter("change <> 'gone'").drop("change")


# the processors travel with the job, so that workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

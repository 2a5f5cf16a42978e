import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import merge, seen
from vacantia.plans import jobs as whole_jobs
from vacantia.schemas import PAGE_SNAPSHOT, STATE_SEEN
from vacantia.streaming import buckets, cycles, keyed, tables


def land(df, folder, pieces):
    for piece in pieces:
        df.filter(piece).coalesce(1).write.mode("append").parquet(folder)


def test_seen_state_expires_from_the_last_sighting(spark, tmp_path):
    days = [("a", 1), ("a", 20), ("b", 1), ("c", 40), ("a", 45), ("b", 45)]
    df = spark.createDataFrame([(j, dt.date(2026, 1, 1) + dt.timedelta(d)) for j, d in days], "job_id string, day date")
    land(df, str(tmp_path / "in"), [f"day = DATE'2026-01-01' + {d}" for d in (1, 20, 40, 45)])
    stream = cycles.files(spark, str(tmp_path / "in"), df.schema)
    cycles.seen_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = {r.job_id: (r.first_seen - dt.date(2026, 1, 1)).days for r in tables.read_latest(spark, str(tmp_path / "state"), STATE_SEEN).collect()}
    # a is refreshed in time; b was dropped on day 40 and starts again
    assert got == {"a": 1, "b": 45, "c": 40}
    assert tables.latest_version(spark, str(tmp_path / "state")) == 3


def test_merge_stream_equals_batches(spark, tmp_path):
    df = spark.createDataFrame(
        [(f"u{i % 5}", "Lever", "c", f"t{i}", "2026-06-10T00:00:00Z" if i % 3 else "2026-01-01T00:00:00Z", i) for i in range(20)],
        "url string, ats string, company string, title string, scraped_at string, n int")
    pieces = ["n < 8", "n >= 8 AND n < 14", "n >= 14"]
    land(df, str(tmp_path / "in"), pieces)
    # the last run is so late that only its own rows and those of June still count
    stamps = ["2026-06-14 12:00:00", "2026-06-15 12:00:00", "2026-07-09 12:00:00"]
    stream = cycles.files(spark, str(tmp_path / "in"), df.schema)
    cycles.merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda e: stamps[e], ["n"], n_buckets=3).awaitTermination()
    state = df.limit(0)
    for piece, stamp in zip(pieces, stamps):
        state = merge.merge(state.drop("posting_key"), df.filter(piece), F.lit(stamp).cast("timestamp"), ["n"])
    got = cycles.merged_table(spark, str(tmp_path / "out"), df.schema)
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in state.collect())


def files_of(spark, path, version):
    """Files of every bucket in force after a batch."""
    index, _, _ = buckets.read_index(spark, path, version)
    return {b: sorted(os.listdir(f"{path}/data/version={v}/bucket={b}")) for b, v in index.items()}


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    df = spark.createDataFrame(
        [(f"u{i}", "Lever", "c", f"t{i}", "2026-06-10T00:00:00Z", i) for i in range(60)] + [("u3", "Lever", "c", "new", "2026-05-20T00:00:00Z", 99)],
        "url string, ats string, company string, title string, scraped_at string, n int")
    path = str(tmp_path / "out")
    stamps = ["2026-06-14 00:00:00", "2026-06-15 00:00:00", "2026-06-16 00:00:00", "2026-07-20 00:00:00"]

    def run(piece):
        land(df, str(tmp_path / "in"), [piece])
        cycles.merge_stream(cycles.files(spark, str(tmp_path / "in"), df.schema), path, str(tmp_path / "cp"), lambda e: stamps[e], ["n"], n_buckets=8).awaitTermination()

    run("n < 60")
    run("n = 99")
    first, second = files_of(spark, path, 0), files_of(spark, path, 1)
    changed = [b for b in first if first[b] != second[b]]
    assert len(first) == 8 and len(changed) == 1 and os.listdir(f"{path}/data/version=1").count(f"bucket={changed[0]}") == 1
    rows = {r["url"]: r["title"] for r in cycles.merged_table(spark, path, df.schema).collect()}
    assert len(rows) == 60 and rows["u3"] == "new"
    run("n > 1000")  # a batch without rows
    assert files_of(spark, path, 2) == second
    # a batch that is run again overwrites its own version
    buckets_before = files_of(spark, path, 1)
    assert buckets.drop_old(spark, path, keep=2) == 1 and files_of(spark, path, 1) == buckets_before
    assert cycles.merged_table(spark, path, df.schema).count() == 60
    run("n = 5")  # 40 days later: the others are too old, though their buckets were not touched
    assert [r["n"] for r in cycles.merged_table(spark, path, df.schema).collect()] == [5]
    with pytest.raises(Exception, match="restore its checkpoint"):
        cycles.merge_stream(cycles.files(spark, str(tmp_path / "in"), df.schema), path, str(tmp_path / "lost"), lambda e: stamps[0], ["n"], n_buckets=8).awaitTermination()
    with pytest.raises(Exception, match="8 buckets"):
        land(df, str(tmp_path / "in"), ["n = 6"])
        cycles.merge_stream(cycles.files(spark, str(tmp_path / "in"), df.schema), path, str(tmp_path / "cp"), lambda e: stamps[3], ["n"], n_buckets=9).awaitTermination()


def test_bucketed_state_starts_from_a_table(spark, tmp_path):
    df = spark.createDataFrame([("Lever", "a"), ("Lever", "b"), ("Ashby", "a"), (None, None)], cycles.DEAD)
    land(df, str(tmp_path / "in"), ["slug = 'a'", "slug IS NULL"])
    assert buckets.read_state(spark, str(tmp_path / "none"), cycles.DEAD).count() == 0 and buckets.last_stamp(spark, str(tmp_path / "none")) is None
    buckets.fold_buckets(
        cycles.files(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), cycles.DEAD, ["platform", "slug"],
        lambda batch, state, epoch: state.union(batch).distinct(), str(tmp_path / "cp"), stamp=str, initial=df.filter("slug = 'b'"), buckets=4).awaitTermination()
    got = buckets.read_state(spark, str(tmp_path / "out"), cycles.DEAD).collect()
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))
    assert buckets.last_stamp(spark, str(tmp_path / "out")) == "1"


def test_alert_stream_equals_cycles(spark, tmp_path):
    df = spark.createDataFrame(
        [("IT Manager", "acme", f"https://x.com/{i % 4}", "Lever", "Remote", True, "senior", False, i) for i in range(9)]
        + [("Nurse", "acme", "https://x.com/n", "Lever", "Remote", True, "mid", False, 9)],
        "title string, company string, url string, ats string, location string, remote boolean, skill_level string, is_recruiter boolean, n int")
    pages = spark.createDataFrame(
        [("https://x.com/0", None, 404, "t", "", "", None, None)], PAGE_SNAPSHOT)
    land(df, str(tmp_path / "in"), ["n < 3", "n >= 3"])
    stream = cycles.files(spark, str(tmp_path / "in"), df.schema)
    days = ["2026-06-13 00:00:00", "2026-06-14 00:00:00"]
    cycles.alert_stream(stream, pages, str(tmp_path / "out"), str(tmp_path / "cp"), lambda e: days[e], ["n"], keep=["n"]).awaitTermination()
    state = seen.empty_state(spark)
    for epoch, piece in enumerate(["n < 3", "n >= 3"]):
        cycle = whole_jobs.alert_cycle(df.filter(piece), pages, state, days[epoch], row_id=["n"], keep=["n"])
        for name, want in (("open", cycle.open_jobs), ("new", cycle.new_jobs)):
            got = spark.read.parquet(tables.version_path(f"{tmp_path}/out/{name}", epoch))
            assert sorted(r.n for r in got.collect()) == sorted(r.n for r in want.collect())
        state = cycle.state
    assert sorted((r.n, str(r.first_seen)) for r in got.collect()) == [(3, "2026-06-14")]


def test_status_stream_keeps_toggles_across_batches(spark, tmp_path):
    events = [("a", "saved", 1), ("a", "saved", 2), ("a", "saved", 3), ("b", "saved", 1), ("b", "saved", 3), ("c", "saved", 1), ("c", "applied", 2)]
    df = spark.createDataFrame(events, "key string, status string, event_id bigint").withColumn("ts", F.timestamp_seconds("event_id"))
    land(df, str(tmp_path / "in"), ["event_id = 1", "event_id = 2", "event_id = 3"])
    stream = cycles.files(spark, str(tmp_path / "in"), df.schema)
    cycles.status_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), toggle=True).awaitTermination()
    got = tables.read_latest(spark, str(tmp_path / "out"), cycles.STATUS).collect()
    assert sorted((r.key, r.status) for r in got) == [("a", "saved"), ("c", "applied")]


DAY0 = dt.date(2026, 1, 1)


def sightings(spark, rows):
    return spark.createDataFrame([(j, DAY0 + dt.timedelta(d)) for j, d in rows], "job_id string, day date")


def seen_rows(df):
    return sorted((r["job_id"], (r["first_seen"] - DAY0).days, (r["last_seen"] - DAY0).days) for r in df.collect())


def keyed_run(spark, folder, pieces, df, log="log", checkpoint="cp", **kwargs):
    land(df, str(folder / "in"), pieces)
    stream = cycles.files(spark, str(folder / "in"), df.schema)
    query = keyed.keyed_seen_stream(stream, str(folder / log), str(folder / checkpoint), **kwargs)
    query.awaitTermination()
    return query


def test_keyed_seen_state_equals_the_rewritten_one(spark, tmp_path):
    rnd = random.Random(8)
    days = [2, 5, 40, 41, 75, 76, 140]
    rows = [(f"j{rnd.randrange(25)}", d) for d in days for _ in range(12)]
    df = sightings(spark, [*rows, *rows[:5]])
    pieces = [f"day = DATE'2026-01-01' + {d}" for d in days]
    keyed_run(spark, tmp_path, pieces, df)
    cycles.seen_stream(
        cycles.files(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "state"), str(tmp_path / "cp2")).awaitTermination()
    want = seen_rows(tables.read_latest(spark, str(tmp_path / "state"), STATE_SEEN))
    assert seen_rows(keyed.read_state(spark, str(tmp_path / "cp"), "seen")) == want
    log = spark.read.parquet(str(tmp_path / "log"))
    assert seen_rows(keyed.last_changes(log)) == want
    born, gone = log.filter("change = 'new'").count(), log.filter("change = 'gone'").count()
    assert gone > 0 and born - gone == len(want)


def test_a_keyed_run_writes_its_own_keys_only(spark, tmp_path):
    df = sightings(spark, [*[(f"j{k}", 1) for k in range(500)], ("j1", 2), ("x", 2), (None, 2), ("y", 3)])
    query = keyed_run(spark, tmp_path, ["day = DATE'2026-01-02'"], df)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] >= 500
    query = keyed_run(spark, tmp_path, ["day = DATE'2026-01-03'"], df)  # the same checkpoint goes on
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < sum(written) < 20
    assert spark.read.parquet(str(tmp_path / "log")).filter("last_seen = DATE'2026-01-03'").count() == 2
    state = seen_rows(keyed.read_state(spark, str(tmp_path / "cp"), "seen"))
    assert len(state) == 501 and ("j1", 1, 2) in state and ("x", 2, 2) in state


def test_keyed_state_after_a_lost_checkpoint(spark, tmp_path):
    rows = [("a", 1), ("b", 1), ("a", 20), ("c", 20), ("b", 45), ("a", 46)]
    df = sightings(spark, rows)
    keyed_run(spark, tmp_path, [f"day = DATE'2026-01-01' + {d}" for d in (1, 20)], df)
    with pytest.raises(ValueError, match="another checkpoint"):
        keyed_run(spark, tmp_path, [], df, checkpoint="lost")
    saved = keyed.last_changes(spark.read.parquet(str(tmp_path / "log")))
    (tmp_path / "next").mkdir()
    keyed_run(spark, tmp_path / "next", [f"day = DATE'2026-01-01' + {d}" for d in (45, 46)], df, initial=saved)
    got = seen_rows(keyed.read_state(spark, str(tmp_path / "next/cp"), "seen"))
    # as without the loss: no run came between the 30th day of b and its next sighting
    assert got == [("a", 1, 46), ("b", 1, 45), ("c", 20, 20)]


def test_keyed_status_equals_the_rewritten_one(spark, tmp_path):
    rnd = random.Random(3)
    events = [(f"k{rnd.randrange(6)}", rnd.choice(["saved", "applied", "ignored", None]), n) for n in range(90)]
    df = spark.createDataFrame([*events, (None, "saved", 1)], "key string, status string, event_id bigint").withColumn(
        "ts", F.timestamp_seconds(F.floor(F.col("event_id") / 2)))
    land(df, str(tmp_path / "in"), ["event_id < 30", "event_id >= 30 AND event_id < 33", "event_id >= 33"])
    for toggle in (False, True):
        stream = cycles.files(spark, str(tmp_path / "in"), df.schema)
        keyed.keyed_status_stream(stream, str(tmp_path / f"log{toggle}"), str(tmp_path / f"cp{toggle}"), toggle).awaitTermination()
        got = {r["key"]: r["status"] for r in keyed.read_state(spark, str(tmp_path / f"cp{toggle}"), "status").collect()}
        want = {}
        for key, status, _ in events:
            want[key] = None if toggle and want.get(key) == status else status
        assert got == {k: s for k, s in want.items() if s is not None}


class Calls:
    """One job's state and timers, counting the calls that go out of Python."""

    def __init__(self):
        self.value, self.timers, self.calls, self.now = None, set(), 0, 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_a_sighting_leaves_the_timer_alone():
    job = Calls()
    processor = keyed.SeenProcessor(8)
    processor.init(job)
    changes, spent = [], []
    for day, seen in [(1, True), (6, True), (13, True), (20, False), (24, False), (30, True)]:
        before = job.calls
        today = dt.date(1970, 1, 1) + dt.timedelta(day)
        if seen:
            changes += [(day, r["change"]) for r in processor.handleInputRows(("a",), iter([{"day": today}]), job)]
        spent.append(job.calls - before)
        job.now = day * keyed.DAY_MS
        for timer in sorted(t for t in job.timers if t <= job.now):
            job.timers.remove(timer)
            changes += [(day, r["change"]) for r in processor.handleExpiredTimer(("a",), job, None)]
        assert len(job.timers) == (job.value is not None)
    assert changes == [(1, "new"), (6, "seen"), (13, "seen"), (24, "gone"), (30, "new")]
    assert spent == [3, 2, 2, 0, 0, 3]

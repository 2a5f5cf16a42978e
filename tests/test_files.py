import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from vacantia.sinks import files as sinks
from vacantia.sources import chunk_set
from vacantia.sources import files as sources
from vacantia.sources import watch_list

SLIM = "title string, company string, location string, url string, ats string, skill_level string, is_recruiter boolean, workplaceType string, scraped_at string, remote boolean, coords struct<lat:double,lng:double>, salary struct<p25:bigint,median:bigint,p75:bigint,n:bigint>"


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_chunks_round_trip(spark, tmp_path):
    data = [(f"t{i % 7}", f"C{i}", "Remote", f"u{i}", "Lever", "mid", False, None, "2026-06-01T00:00:00Z", True, (1.5, -2.0) if i % 2 else None, (1, 2, 3, 5)) for i in range(95)]
    df = spark.createDataFrame(data, SLIM)
    folder = str(tmp_path / "chunks")
    manifest = sinks.write_chunks(df, folder, "2026-06-14T00:00:00Z", rows=20).first()
    assert (manifest.chunks, manifest.totalJobs) == (5, 95)
    back = sources.read_chunks(spark, folder)
    assert sorted(tuple(r) for r in back.select(df.columns).collect()) == sorted(tuple(r) for r in df.collect())
    check = sources.manifest_check(sources.read_manifest(spark, folder), back).first()
    assert (check.announced, check.found) == (95, 95)
    # every chunk is one JSON array in canonical order, named by a row of a list
    names = {r["name"]: r["path"] for r in sources.read_chunk_names(spark, folder).collect()}
    assert sorted(names) == [f"jobs_chunk_{k}.json.gz" for k in range(5)]
    for k in range(5):
        companies = [row["company"].lower() for row in json.loads(gzip.open(tmp_path / "chunks" / names[f"jobs_chunk_{k}.json.gz"], "rt").read())]
        assert len(companies) == (20 if k < 4 else 15) and companies == sorted(companies)


def published(spark, folder):
    return sorted(r["title"] for r in sources.read_chunks(spark, folder).collect())


def some_jobs(spark, titles, bad=()):
    df = spark.createDataFrame([(t, f"C{k}", "u", k) for k, t in enumerate(titles)], "title string, company string, url string, k int")
    if bad:
        df = df.withColumn("title", F.when(F.col("k").isin(*bad), F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    return df


def test_a_chunk_set_is_published_whole(spark, tmp_path):
    folder = str(tmp_path / "set")
    first = [f"a{k}" for k in range(50)]
    sinks.write_chunks(some_jobs(spark, first), folder, "1", rows=7)
    assert published(spark, folder) == sorted(first)
    # what no list names is never opened: strays, half-written files, files of a lost attempt
    (current,) = (tmp_path / "set").glob("set-*")
    attempt = next(p for p in current.iterdir() if p.is_dir())
    for path in (tmp_path / "set" / "jobs_chunk_0.json.gz", attempt / "jobs_chunk_99.json.gz", current / "jobs_chunk_1.json.gz"):
        path.write_bytes(b"\x1f\x8b half")
    assert published(spark, folder) == sorted(first)
    # a write that fails half-way leaves the set in force, and nothing of its own
    lines = spark.createDataFrame([(k // 3, k, "{}") for k in range(30)], "chunk bigint, row_number bigint, line string").withColumn(
        "line", F.when(F.col("row_number") == 20, F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        lines.repartition(4, "chunk").sortWithinPartitions("chunk").select("chunk", "line").write.format(
            chunk_set.FORMAT).mode("overwrite").save(folder)
    assert published(spark, folder) == sorted(first) and len(list((tmp_path / "set").glob("set-*"))) == 1
    # the next set takes over; readers that planned on the one before still find it, older ones go
    for stamp in ("2", "3"):
        sinks.write_chunks(some_jobs(spark, [stamp]), folder, stamp)
        assert published(spark, folder) == [stamp]
    assert not current.exists() and len(list((tmp_path / "set").glob("set-*"))) == 2
    sinks.write_chunks(some_jobs(spark, []), folder, "4")
    assert published(spark, folder) == [] and sources.read_manifest(spark, folder).first().totalJobs == 0


def test_chunks_are_planned_one_by_one(spark, tmp_path):
    folder = str(tmp_path / "set")
    sinks.write_chunks(some_jobs(spark, [f"a{k}" for k in range(40)]), folder, "1", rows=5)
    rows = sources.read_chunks(spark, folder)
    assert rows.rdd.getNumPartitions() == 8
    with pytest.raises(Exception, match="as a whole"):
        spark.createDataFrame([(0, "{}")], "chunk bigint, line string").write.format(chunk_set.FORMAT).mode("append").save(folder)
    unsorted = spark.createDataFrame([(0, "{}"), (1, "{}"), (0, "{}")], "chunk bigint, line string").coalesce(1)
    with pytest.raises(Exception, match="twice"):
        unsorted.write.format(chunk_set.FORMAT).mode("overwrite").save(folder)
    assert rows.count() == 40


def test_many_chunks_are_read_several_at_a_time(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "set")
    sinks.write_chunks(some_jobs(spark, [f"a{k}" for k in range(400)]), folder, "1", rows=2)
    rows = sources.read_chunks(spark, folder)
    assert rows.rdd.getNumPartitions() == 50 and published(spark, folder) == sorted(f"a{k}" for k in range(400))
    # a task takes no more chunks once it has rows enough, and no task is without chunks
    monkeypatch.setattr(chunk_set, "PART_ROWS", 5)
    parts = chunk_set.ChunkReader(folder).partitions()
    assert [len(p.named) for p in parts] == [3] * 66 + [2]
    monkeypatch.setattr(chunk_set, "LEAST_PARTS", 1000)
    assert [len(p.named) for p in chunk_set.ChunkReader(folder).partitions()] == [1] * 200
    # lists that do not tell the rows, as other publishers write them
    put(tmp_path / "jobs_manifest.json", {"chunks": [f"jobs_chunk_{k}.json.gz" for k in range(9)]})
    assert [len(p.named) for p in chunk_set.ChunkReader(str(tmp_path)).partitions()] == [1] * 9
    assert chunk_set.ChunkReader(str(tmp_path / "nowhere")).partitions() == [chunk_set.Chunks([])]


def test_rows_of_chunks_are_worked_out_once(spark, tmp_path):
    """The sort goes over its input twice: to find the ranges, then to deal the rows out."""
    read = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(f"t{k}", "c", "u") for k in range(60)], 3).map(lambda row: (read.add(1), row)[1])
    sinks.write_chunks(spark.createDataFrame(rows, "title string, company string, url string"), str(tmp_path / "set"), "1", rows=7)
    assert read.value == 60 and len(published(spark, str(tmp_path / "set"))) == 60


def test_scratch_tables_of_chunks_go(spark, tmp_path):
    from vacantia.session import checkpoint_dir

    where = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    sinks.write_chunks(some_jobs(spark, ["a", "b"]), str(tmp_path / "set"), "1")
    assert set(os.listdir(where)) <= before


def test_chunks_named_but_absent_are_skipped(spark, tmp_path):
    put(tmp_path / "jobs_manifest.json", {"chunks": ["jobs_chunk_0.json.gz", "jobs_chunk_1.json.gz"], "totalJobs": 1, "last_updated": "x"})
    for name in ("jobs_chunk_0", "jobs_chunk_9"):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            json.dump([{"title": name, "coords": [1.0, 2.0]}], f)
    assert [r.title for r in sources.read_chunks(spark, str(tmp_path)).collect()] == ["jobs_chunk_0"]
    assert sources.read_chunks(spark, str(tmp_path / "nowhere")).count() == 0


def test_lists_lookups_and_state(spark, tmp_path):
    assert sources.read_companies(spark, put(tmp_path / "c.json", ["a", "b", "a"]), "Lever").count() == 2
    assert sources.read_companies(spark, str(tmp_path / "none.json"), "Lever").count() == 0
    assert sources.read_dead_slugs(spark, put(tmp_path / "bad.json", "{nope"), "lever").count() == 0
    gaz = put(tmp_path / "g.json", {"schema": ["lat", "city", "admin", "country", "lng"], "data": [[1.5, "X", "A", "US", "2"], [1, " ", "A", "US", 2]]})
    assert [tuple(r) for r in sources.read_gazetteer(spark, gaz).collect()] == [(0, "X", "A", "US", 1.5, 2.0)]
    one = {"p25": 1, "median": 2, "p75": 3, "n": 5}
    both = put(tmp_path / "s.json", {"primary": {"a|b|mid": one}, "fallback": {"b|mid": one}})
    assert sorted((r.tier, r.key, r.salary.median) for r in sources.read_salary_lookup(spark, both).collect()) == [("fallback", "b|mid", 2), ("primary", "a|b|mid", 2)]
    (tmp_path / "shards").mkdir()
    put(tmp_path / "shards" / "x.json", {"x|b|mid": one})
    put(tmp_path / "shards" / "y.json", {"y|b|mid": one})
    assert sources.read_salary_shards(spark, str(tmp_path / "shards")).count() == 2
    seen = put(tmp_path / "seen.json", {"a": {"first_seen": "2026-06-01", "last_seen": "oops"}})
    assert [(r.job_id, str(r.first_seen), r.last_seen) for r in sources.read_seen(spark, seen).collect()] == [("a", "2026-06-01", None)]
    assert sources.read_seen(spark, put(tmp_path / "list.json", "[1, 2]")).count() == 0
    status = put(tmp_path / "st.json", {"u1": {"status": "saved", "date": "2026-06-01T00:00:00.000Z"}})
    assert [(r.key, r.status) for r in sources.read_statuses(spark, status).collect()] == [("u1", "saved")]
    jobs = put(tmp_path / "db.json", {"total": 1, "jobs": [{"job_id": "j", "is_live": True, "first_seen": "2026-06-14"}]})
    assert [(r.job_id, r.is_live, str(r.first_seen)) for r in sources.read_jobs_db(spark, jobs).collect()] == [("j", True, "2026-06-14")]


def test_trends_and_candidates(spark, tmp_path):
    day = {"date": "2026-04-05", "total_jobs": 3, "active_companies": 2, "recruiter_jobs": 1, "by_platform": {"lever": 3}, "by_tier": {"mid": 3}}
    path = put(tmp_path / "daily.jsonl", json.dumps(day, indent=2) + "\n" + json.dumps(day | {"date": "2026-04-06"}, indent=2) + "\n")
    got = sources.read_trends(spark, path).collect()
    assert [str(r.date) for r in got] == ["2026-04-05", "2026-04-06"] and got[0].by_platform == {"lever": 3}
    lines = put(tmp_path / "c.txt", "# x\n\n Lever : slug:1 \nfoo:bar\nplain\nworkday:a|wd1|b\n")
    assert sorted((r.platform, r.slug, r.known) for r in sources.read_candidates(spark, lines).collect()) == [
        ("foo", "foo:bar", False), ("lever", "slug:1", True), ("unknown", "plain", False), ("workday", "a|wd1|b", True)]
    days = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "date string, n int")
    sinks.append_trend(days, str(tmp_path / "t"))
    sinks.append_trend(days.filter("n = 2").withColumn("n", F.lit(9)), str(tmp_path / "t"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 9]


def test_watch_list(spark, tmp_path):
    path = put(tmp_path / "w.yaml", 'greenhouse:\n  - slug: "a"\n    name: "A Co"\n    tags: [x, y]\n  - justtext\n  - name: "no slug"\nlever:\nworkday:\n  - slug: "c|wd5|s"\n')
    got = [tuple(r) for r in watch_list.read_watch_list(spark, path).collect()]
    assert got == [("greenhouse", "a", "A Co", ["x", "y"]), ("workday", "c|wd5|s", "c|wd5|s", [])]


def test_feed(spark, tmp_path):
    schema = "job_id string, title string, company string, application_url string, location string, platform_source string, date_posted date, first_seen date"
    none = spark.createDataFrame([], schema)
    assert sinks.feed_items(none, "2026-06-14 11:19:00", "l").first().title == "No new matches this run (2026-06-14 11:19 UTC)"
    one = spark.createDataFrame([("j", "Boss & Co", "A<b>", "u", "", "Lever", None, None)], schema)
    items = sinks.feed_items(one.withColumn("first_seen", F.lit("2026-06-01").cast("date")), "2026-06-14 11:19:00", "l")
    row = items.first()
    assert row.description == "Boss & Co at A<b> (Not specified) via Lever. First seen: 2026-06-01."
    assert row.pubDate == "Mon, 01 Jun 2026 00:00:00 +0000"
    sinks.write_feed(items, str(tmp_path / "feed"))
    text = "".join(p.read_text() for p in (tmp_path / "feed").glob("part-*"))
    assert "<item>" in text and "Boss &amp; Co" in text

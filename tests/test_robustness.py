"""State that must not get lost, and bad rows that must not stop a job."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions import display, money, pages
from vacantia.operators import alerts, facets, reports, seen, verify
from vacantia.operators.joins import lookup_join
from vacantia.plans import jobs as whole_jobs
from vacantia.plans import sample_tables as sample
from vacantia.schemas import STATE_SEEN
from vacantia.sinks import files as sinks
from vacantia.sources import boards, watch_list
from vacantia.sources import files as sources
from vacantia.streaming import cycles, tables

SMALL = "/root/testdata/sf0.001"
RAW = "ats string, slug string, page int, offset int, total int, status_code int, content_type string, body string"


def landed(spark, rows):
    full = [(ats, slug, 0, offset, None, code, "application/json", body) for ats, slug, offset, code, body in rows]
    return spark.createDataFrame(full, RAW)


def sightings(spark, days):
    return spark.createDataFrame([(j, dt.date(2026, 1, d)) for j, d in days], "job_id string, day date")


def test_empty_batch_keeps_the_state(spark, tmp_path):
    landing = str(tmp_path / "in")
    for days in ([("a", 1), ("b", 2)], [], [("b", 5)]):
        sightings(spark, days).coalesce(1).write.mode("append").parquet(landing)
    stream = cycles.files(spark, landing, "job_id string, day date")
    cycles.seen_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp"), days=30).awaitTermination()
    state = tables.read_latest(spark, str(tmp_path / "state"), STATE_SEEN)
    assert {r.job_id for r in state.collect()} == {"a", "b"}
    assert tables.latest_version(spark, str(tmp_path / "state")) == 2


def test_a_lost_version_is_an_error(spark, tmp_path):
    landing, state, checkpoint = (str(tmp_path / n) for n in ("in", "state", "cp"))

    def run(day, path, at):
        sightings(spark, [(f"j{day}", day)]).coalesce(1).write.mode("append").parquet(landing)
        cycles.seen_stream(cycles.files(spark, landing, "job_id string, day date"), path, at).awaitTermination()

    run(1, state, checkpoint)
    run(2, state, checkpoint)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        run(3, str(tmp_path / "elsewhere"), checkpoint)  # batch 2 finds no version 1
    with pytest.raises(Exception, match="restore its checkpoint"):
        run(4, state, str(tmp_path / "other"))  # batches count from 0 again


def test_refresh_drops_nothing_and_copies_are_new_once(spark):
    state = spark.createDataFrame([("old", None, None)], STATE_SEEN)
    jobs = spark.createDataFrame([("x", 1), ("x", 2), ("old", 3)], "job_id string, n int")
    assert {r.job_id for r in seen.refresh(jobs, state, "2026-06-14").collect()} == {"x", "old"}
    assert {(r.n, r.is_new) for r in seen.mark_new(jobs, state, ["n"]).collect()} == {(1, True), (2, False), (3, False)}
    with pytest.raises(TypeError):
        whole_jobs.alert_cycle(jobs, jobs, state, "2026-06-14")


def test_merge_stream_leaves_its_input_alone(spark, tmp_path):
    stream = cycles.files(spark, str(tmp_path), "url string, ats string, company string, title string, scraped_at string")
    before = len(stream.schema)
    cycles.merge_stream(stream, str(tmp_path / "s"), str(tmp_path / "c"), F.lit("2026-06-14").cast("timestamp"), ["title"]).awaitTermination()
    assert len(stream.schema) == before


def test_bad_numbers_cost_their_own_field(spark, column):
    html = lambda value: '<script type="application/ld+json">{"@type":"JobPosting","baseSalary":{"value":%s}}</script>' % value
    values = ['{"minValue":"NaN"}', '{"minValue":1e30}', '{"minValue":"abc"}', "9223372036854775807", '"NaN"', '{"minValue":1000,"maxValue":1e30}', '{"minValue":90000,"maxValue":"120000"}']
    got = column(lambda F: pages.json_ld_salary(pages.json_ld(F.col("x"))), [html(v) for v in values])
    assert got == [None, None, None, None, None, "$1,000+", "$90,000 – $120,000"]
    assert column(lambda F: money.dollars(F.col("x")), [float("nan"), 1e300, -1e300, 5.0, None], "x double") == [None, None, None, "$5", None]


def test_bad_stamps_and_bodies_cost_their_own_row(spark):
    job = {"id": "1", "text": "Boss", "hostedUrl": "u", "categories": {"location": "Miami, FL"}}
    rows = [("Lever", f"s{k}", 0, 200, json.dumps([job | {"createdAt": v}])) for k, v in enumerate([1700000000000, 9223372036854775807, -9223372036854775808, 0])]
    rows += [("Lever", "bad", 0, 200, '{"ok":false}'), ("Lever", "odd", 0, 200, "<html>")]
    raw = landed(spark, rows)
    watched = raw.select(F.lit("lever").alias("platform"), "slug", F.col("slug").alias("name"))
    found = {r.company_slug: r.date_posted for r in watch_list.lever(raw, watched).collect()}
    assert found == {"s0": dt.date(2023, 11, 14), "s1": None, "s2": None, "s3": None}
    assert boards.normalise(raw, "Lever").count() == 4


def test_whole_locations_and_all_hits(spark):
    place = "Office based in one of the many buildings of our campus, " * 3 + "Jacksonville, Florida"
    posting = spark.createDataFrame(
        [("u", "IT Manager", "acme", "Lever", place, None, "senior", False)],
        "url string, title string, company string, ats string, location string, remote boolean, skill_level string, is_recruiter boolean")
    (row,) = alerts.filter_jobs(alerts.to_alert_jobs(posting)).collect()
    assert row.location == place
    hits = [{"title": f"t{k}", "externalPath": f"/p{k}", "locationsText": "x"} for k in range(150)]
    pages_ = [("Workday", "acme|wd1|ext", 100 * k, 200, json.dumps({"total": 300, "jobPostings": [h | {"externalPath": h["externalPath"] + f"-{k}"} for h in hits]})) for k in range(2)]
    raw = landed(spark, pages_).withColumn("search_term", F.lit(fixed.WORKDAY_SEARCH_TERMS[0]))
    watched = spark.createDataFrame([("workday", "acme|wd1|ext", "Acme")], "platform string, slug string, name string")
    assert watch_list.workday(raw, watched).count() == 300
    marks = spark.createDataFrame([(chr(0x61 + k) if k < 26 else chr(0x430 + k), 1.0, 1.0, 5) for k in range(40)], "company string, lat double, lng double, median int")
    marks = marks.withColumns({"coords": F.struct("lat", "lng"), "salary": F.struct("median"), "url": F.col("company")})
    assert facets.map_markers(marks, (0, 0, 2, 2), ["company"]).count() == 40


def test_boards_count_what_the_normalisers_keep(spark):
    sitemap = '<urlset><url><loc>https://x.icims.com/jobs/intro</loc></url>%s</urlset>'
    rows = [
        ("iCIMS", "empty", 0, 200, sitemap % ""), ("iCIMS", "one", 0, 200, sitemap % "<url><loc>https://x.icims.com/jobs/1/boss/job</loc></url>"),
        ("Workday", "bad", 0, 200, '{"total":1,"jobPostings":[{"title":"a"}]}'), ("Lever", "gone", 0, 404, None)]
    found = {r.slug: (r.jobs, r.status_code) for r in boards.fetch_results(landed(spark, rows)).collect()}
    assert found == {"empty": (0, 200), "one": (1, 200), "bad": (0, 200), "gone": (0, 404)}
    assert [(r.ats, r.slug) for r in reports.newly_dead(boards.fetch_results(landed(spark, rows))).collect()] == [("Lever", "gone")]


def test_the_last_answer_counts(spark):
    jobs = spark.createDataFrame([("https://acme.wd5.myworkdayjobs.com/ext/job/Miami/Boss_R1",)], "application_url string")
    rows = [("acme.wd5.myworkdayjobs.com", "ext", "R1", 200, total, None, None, dt.datetime(2026, 6, day)) for day, total in ((1, 1), (3, 0), (2, 1))]
    answers = spark.createDataFrame(rows, "host string, tenant string, posting string, status_code int, total int, posted_on string, locations_text string, landed_at timestamp")
    (row,) = verify.with_workday_answer(jobs, answers, F.lit("2026-06-14").cast("timestamp")).collect()
    assert row.workday.is_live is False


def test_sinks_and_readers_meet(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    slugs = spark.createDataFrame([("b",), ("a",), ("a",)], "slug string")
    sinks.write_companies(slugs, at("companies"))
    assert {(r.ats, r.slug) for r in sources.read_companies(spark, at("companies"), "Lever").collect()} == {("Lever", "a"), ("Lever", "b")}
    dead = spark.createDataFrame([("Lever", "x"), ("Ashby", "y")], "platform string, slug string")
    sinks.write_dead_slugs(dead.limit(1), dead, at("dead"))
    assert [(r.platform, r.slug) for r in sources.read_dead_slugs(spark, at("dead"), "Ashby").collect()] == [("Ashby", "y")]
    salaries = spark.createDataFrame([("acme|boss|mid", (1, 2, 3, 5)), ("zed|x|mid", (2, 3, 4, 6))], "key string, salary struct<p25:bigint,median:bigint,p75:bigint,n:bigint>")
    sinks.write_salary_shards(salaries, at("shards"))
    assert {(r.key, r.salary.median) for r in sources.read_salary_shards(spark, at("shards")).collect()} == {("acme|boss|mid", 2), ("zed|x|mid", 3)}
    jobs = spark.createDataFrame([("j1", "Acme", None)], "job_id string, company string, first_seen date")
    sinks.write_jobs_db(jobs, at("db"), "2026-06-14T00:00:00Z")
    assert [(r.job_id, r.company) for r in sources.read_jobs_db(spark, at("db")).collect()] == [("j1", "Acme")]


def test_null_keys_are_dealt_out(spark):
    left = spark.range(1000).select(F.col("id"), F.lit(None).cast("string").alias("k"))
    right = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    joined = lookup_join(left, right, "k")
    assert joined.count() == 1000 and joined.filter("v IS NOT NULL").count() == 0
    keys = left.select(F.when(F.col("k").isNull(), F.xxhash64("id", "k")).alias("h")).distinct().count()
    assert keys == 1000


def test_alert_cycle_scans_each_table_once(spark, tmp_path):
    postings = sample.slim_postings(spark, SMALL)
    cycle = whole_jobs.alert_cycle(
        postings, sample.snapshots(spark, SMALL), seen.empty_state(spark), "2026-06-14 12:00:00",
        row_id=sample.ORDER, keep=sample.ORDER, verified_at=str(tmp_path / "run"))
    plan = cycle.new_jobs._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*?Location: InMemoryFileIndex\(\d+ paths?\)\[([^\],]*)", plan)
    assert scans and not any("lineitem" in s or "pages.parquet" in s for s in scans)


def test_jitter_hashes_utf16_units(column):
    def want(text):
        h = 0
        raw = text.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[k : k + 2], "big") + (1 << 31)) % (1 << 32) - (1 << 31)
        return h

    words = ["", "a", "30.26715,-97.74306", "é😀x", "😀" * 20]
    assert column(lambda F: display.string_hash(F.col("x")), words) == [want(w) for w in words]


def test_fixed_lists_stay_as_they_are():
    sizes = {"TARGET_PHRASES": 103, "EXCLUSION_PHRASES": 38, "COUNTRY_ALIASES": 162, "US_STATES": 105, "CITY_ALIASES": 32, "COUNTRY_CODES": 192}
    assert {name: len(getattr(fixed, name)) for name in sizes} == sizes

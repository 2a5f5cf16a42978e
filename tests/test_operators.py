import datetime as dt

from pyspark.sql import functions as F

from vacantia.functions import classify
from vacantia.operators import alerts, clean, enrich, facets, joins, merge, order, reports, seen, verify
from vacantia.plans import jobs as whole_jobs
from vacantia.plans import sample_tables as sample
from vacantia.plans.queries_places import EXPECTED
from vacantia.schemas import PAGE_SNAPSHOT, STATE_SEEN
from vacantia.sources import boards

D = dt.date
AS_OF = "2026-06-14 12:00:00"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_clean_takes_the_first_reason(spark):
    df = spark.createDataFrame(
        [("N/A", "u", "c"), (None, None, "c"), ("ok", "", "c"), ("ok", "u", None), ("ok", "u", "c"), (" Unknown ", "u", "")],
        "title string, url string, company string")
    assert rows(clean.clean_report(df), "reason", "n") == [("no_company", 1), ("no_title", 3), ("no_url", 1)]
    assert clean.clean(df).count() == 1


def test_geocode(spark):
    df = spark.createDataFrame([(e[0],) for e in EXPECTED] + [(None,)], "location string")
    where = {city: (lat, lng) for city, _, _, lat, lng in reversed(sample.GAZETTEER)}
    want = {e[0]: (e[1], where.get(e[5])) for e in EXPECTED} | {None: (False, None)}
    got = {r.location: (r.remote, (r.coords.lat, r.coords.lng) if r.coords else None)
           for r in enrich.geocode(df, sample.gazetteer(spark)).collect()}
    # a null location stays unmatched like an empty one
    assert got == want


def test_alert_filter(spark):
    cases = [
        ("Director of IT", "Remote - US", False), ("IT Manager", "United States", True), ("IT Manager", "Miami, FL", True),
        ("Internal Audit IT Manager", "Remote - USA", True), ("Pursuit Director", "Remote", False),
        ("Head of IT, Product Owner", "Remote", False), ("IT Manager", "China-Remote Location-Beijing", False),
        ("IT Manager", "Milwaukee, WI (Remote)", False), ("IT Manager", "Indianapolis, IN (Remote)", False),
        ("IT Manager", "Spring, Texas, United States of America", False), ("IT Manager", "", False), ("", "Remote", False),
    ]
    # phrases match between word boundaries, so "director of it" needs no trailing space
    cases[0] = ("Director of IT", "Remote - US", True)
    df = spark.createDataFrame([(t, loc, "u", w) for t, loc, w in cases], "title string, location string, application_url string, w boolean")
    kept = {(r.title, r.location) for r in alerts.filter_jobs(df).collect()}
    assert kept == {(t, loc) for t, loc, w in cases if w}
    bounded = df.filter(alerts.location_verdict(F.col("location"), word_bounded=True)).select("location").distinct()
    assert "Milwaukee, WI (Remote)" in [r.location for r in bounded.collect()]
    assert alerts.filter_jobs(df, allow_unspecified=True).filter("location = ''").count() == 1


def test_icims_listed_location(spark):
    cases = [
        ("", "acme", True, "Remote"), ("", "acme", False, "United States"), ("n/a", "UK acme", False, ""),
        ("US-FL-Miami", "a", False, "Miami, FL"), ("US-FL", "a", False, "Florida"), ("US-CA-Valencia", "a", False, ""),
        ("US-CA-Valencia", "a", True, "Remote"), ("LB-Beirut", "a", False, ""), ("Tampa", "a", None, "Tampa"),
    ]
    df = spark.createDataFrame(cases, "l string, c string, r boolean, want string")
    got = df.select("want", alerts.icims_listed_location(F.col("l"), F.col("c"), F.col("r")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


POST = "url string, ats string, company string, title string, scraped_at string, n int"


def posting(url, stamp, title, n):
    return (url, "Lever", "c", title, stamp, n)


def test_merge(spark):
    old = spark.createDataFrame([
        posting("A", "2026-05-14T13:00:00Z", "old A", 1), posting("B", "2026-05-14T11:59:00Z", "stale", 2),
        posting("C", None, "no stamp", 3), posting("D", "soon", "bad stamp", 4), posting("E", "2026-06-01T00:00:00Z", "first", 5),
        posting("E", "2026-06-01T00:00:00Z", "last", 6), posting("", "2026-06-01T00:00:00Z", "no key", 7)], POST)
    new = spark.createDataFrame([posting("A", "2026-06-14T00:00:00Z", "new A", 1)], POST)
    stamp = F.lit(AS_OF).cast("timestamp")
    out = merge.merge(old, new, stamp, ["n"])
    assert rows(out, "url", "title") == [("A", "new A"), ("C", "no stamp"), ("D", "bad stamp"), ("E", "last")]
    again = merge.merge(out.drop("posting_key"), new, stamp, ["n"])
    assert rows(again, "url", "title") == rows(out, "url", "title")
    assert merge.stale_count(old, stamp).first().stale == 1


def test_thirty_days_and_some_hours_are_kept(spark):
    df = spark.createDataFrame([("2026-05-14T13:00:00Z",), ("2026-05-14T12:00:00Z",), ("2026-05-14T11:00:00Z",)], "s string")
    got = [r.f for r in df.select(merge.is_fresh(F.col("s"), F.lit(AS_OF).cast("timestamp")).alias("f")).collect()]
    assert got == [True, False, False]


def seen_inputs(spark):
    state = spark.createDataFrame([
        ("a", D(2026, 6, 1), D(2026, 6, 13)), ("b", D(2026, 4, 1), D(2026, 5, 15)), ("c", D(2026, 4, 1), D(2026, 5, 14)),
        ("d", D(2026, 4, 1), None), ("e", D(2026, 1, 1), D(2026, 2, 1))], STATE_SEEN)
    jobs = spark.createDataFrame([("a", 1), ("e", 2), ("f", 3), ("f", 4)], "job_id string, n int")
    return jobs, state


def test_seen_cycle(spark):
    jobs, state = seen_inputs(spark)
    marked = seen.mark_new(jobs, state, ["n"])
    assert rows(marked, "n", "is_new") == [(1, False), (2, False), (3, True), (4, False)]
    after = seen.next_state(jobs, state, "2026-06-14")
    today = D(2026, 6, 14)
    assert rows(after, "job_id", "first_seen", "last_seen") == [
        ("a", D(2026, 6, 1), today), ("b", D(2026, 4, 1), D(2026, 5, 15)), ("e", D(2026, 1, 1), today), ("f", today, today)]
    assert rows(seen.attach_state(jobs, after), "n", "first_seen")[3] == (4, today)
    assert sorted(r.job_id for r in seen.prune(state, jobs, "2026-06-14").collect()) == ["a", "b", "e"]
    assert seen.refresh(jobs, state, "2026-06-14").count() == 6
    assert seen.mark_new(jobs, seen.empty_state(spark), ["n"]).filter("is_new").count() == 3


def test_percentiles(spark):
    data = [("c", "t", "mid", v) for v in (1, 2, 3, 10, 11, 12)] + [("c", "few", "mid", v) for v in (1, 2, 3, 4)]
    df = spark.createDataFrame(data, "company string, title string, skill_level string, amount bigint")
    got = enrich.salary_table(df).select("key", "salary.*").collect()
    # 2.25 / 6.5 / 10.75 rounded
    assert [tuple(r) for r in got] == [("c|t|mid", 2, 7, 11, 6)]


def test_salary_join_prefers_the_company(spark):
    sal = "key string, salary struct<p25:bigint,median:bigint,p75:bigint,n:bigint>"
    own = spark.createDataFrame([("acme|boss|mid", (1, 2, 3, 5))], sal)
    title = spark.createDataFrame([("boss|mid", (7, 8, 9, 5))], sal)
    df = spark.createDataFrame([(" Acme", "BOSS ", None), ("other", "Boss", "mid"), ("other", "x", "mid"), (None, None, None)],
                               "company string, title string, skill_level string")
    assert sorted((r.company or "", r.m) for r in enrich.with_salary(df, own, title).select("company", F.coalesce("salary.median", F.lit(0)).alias("m")).collect()) == [
        ("", 0), (" Acme", 2), ("other", 0), ("other", 8)]


def test_hot_key_join_keeps_every_row(spark):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    out = joins.lookup_join(left, right, "k")
    assert out.count() == 9000 and out.filter("k = 'hot' AND n = 3000").count() == 3000
    nulls = left.withColumn("k", F.expr("nullif(k, 'hot')"))
    assert joins.lookup_join(nulls, right, "k").count() == 9000


def test_first_per_group_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = joins.first_per_group(df, ["k"], ["id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sort_and_page(spark):
    df = spark.createDataFrame([("B",), ("1a",), ("a",), ("",)], "v string")
    assert [r.v for r in df.orderBy(*facets.sort_keys(F.col("v"), ascending=False)).collect()] == ["B", "a", "", "1a"]
    assert [r.v for r in facets.page(df, ["v"], number=9, size=3).collect()] == ["", "1a", "B"]
    assert [r.v for r in facets.page(df, ["v"], number=2, size=3).collect()] == ["a"]
    assert facets.page_count(101, 25) == 5


def test_facets_do_not_depend_on_order(spark):
    df = spark.createDataFrame(
        [("IT Manager", "acme", "Remote", "u1", "Lever", "senior", False, None, 100), ("Nurse", "talent", '{"name":"Tampa"}', "u2", "Ashby", "mid", True, "remote", None)],
        "title string, company string, location string, url string, ats string, skill_level string, is_recruiter boolean, workplaceType string, m int"
    ).withColumn("salary", F.struct(F.col("m").alias("median")))
    both = {"title": "manager", "salary_min": 50}
    one = facets.facet_query(facets.facet_query(df, title="manager"), salary_min=50)
    assert rows(one, "url") == rows(facets.facet_query(df, **both), "url") == [("u1",)]
    assert rows(facets.facet_query(df, hide_recruiters=False, location="tampa"), "url") == [("u2",)]
    assert rows(facets.facet_query(df, hide_recruiters=False, remote_only=True), "url") == [("u1",), ("u2",)]
    assert facets.facet_query(df, hide_recruiters=False).count() == 2
    statuses = spark.createDataFrame([("u1", "applied")], "key string, status string")
    assert facets.facet_query(df, statuses, hide_applied=True).count() == 0
    assert whole_jobs.explore(df, sort="title", hide_recruiters=False).count() == 2


def test_status_events(spark):
    events = spark.createDataFrame([
        ("a", "saved", 1), ("a", "saved", 2), ("b", "saved", 1), ("b", "applied", 2), ("c", "saved", 1), ("c", "applied", 2),
        ("c", "applied", 3), ("c", "applied", 4)], "key string, status string, event_id bigint").withColumn("ts", F.timestamp_seconds("event_id"))
    assert rows(facets.toggled_status(events), "key", "status") == [("b", "applied"), ("c", "applied")]
    now = facets.current_status(events)
    assert rows(now, "key", "status") == [("a", "saved"), ("b", "applied"), ("c", "applied")]
    marks = spark.createDataFrame([("a", "saved"), ("a", "ignored"), ("z", "saved"), ("b", "what")], "key string, status string")
    assert rows(facets.apply_batch(now, marks, AS_OF), "key", "status") == [("a", "ignored"), ("b", "applied"), ("c", "applied"), ("z", "saved")]


def test_url_health(spark):
    data = [("Lever", i, 500, None) for i in range(12)] + [("Ashby", i, 200 if i < 4 else 404, None) for i in range(10)]
    data += [("Workday", i, 405, 200 if i < 5 else 500) for i in range(10)]
    df = spark.createDataFrame([(a, f"u{i}", i, s, g) for a, i, s, g in data], "ats string, url string, n int, http_status int, get_status int")
    report = reports.url_health(df)
    assert {r.ats: (r.alive, r.total, r.status) for r in report.collect()} == {
        "Lever": (0, 12, "PATTERN_BROKEN"), "Ashby": (4, 10, "DEGRADED"), "Workday": (5, 10, "OK"),
        "Greenhouse": (0, 0, "NO_URLS"), "BambooHR": (0, 0, "NO_URLS"), "iCIMS": (0, 0, "NO_URLS")}
    assert rows(reports.health_failures(report), "ats") == [("BambooHR",), ("Greenhouse",), ("Lever",), ("iCIMS",)]


def test_heatmap_minimum(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 75 + [(3.0, 4.0)] * 74, "lat double, lng double").withColumn("coords", F.struct("lat", "lng"))
    cells = facets.heatmap(df).collect()
    assert [c.n for c in cells] == [75] and abs(cells[0].lat - 1) < 0.0101 and abs(cells[0].lng - 2) < 0.0101


def test_page_prefix(spark):
    pages = spark.createDataFrame([
        ("s", 0, 60, 20), ("s", 20, 60, 20), ("s", 40, 58, 20), ("t", 0, 30, 20), ("t", 20, 30, 10), ("t", 40, 30, 5),
        ("e", 0, 60, 20), ("e", 20, 60, 0), ("e", 40, 60, 20)], "slug string, offset int, total int, jobs int")
    assert rows(boards.consistent_pages(pages), "slug", "offset") == [("e", 0), ("s", 0), ("s", 20), ("t", 0), ("t", 20)]


def test_row_numbers_match_the_order(spark):
    df = spark.range(5000).select(F.hash("id").cast("string").alias("company"), F.col("id").cast("string").alias("title"), F.lit("u").alias("url"))
    numbered = order.with_chunks(df, order.canonical_order(), rows=700)
    got = [(r.row_number, r.chunk, r.company) for r in numbered.orderBy("row_number").collect()]
    assert [g[0] for g in got] == list(range(5000)) and [g[1] for g in got] == [i // 700 for i in range(5000)]
    assert [g[2] for g in got] == sorted(g[2] for g in got)


def snapshot(url, **values):
    base = {"url": url, "final_url": url, "http_status": 200, "title": "Boss", "html": "", "body_text": "", "fetch_error": None,
            "fetched_at": dt.datetime(2026, 6, 14)} | values
    return tuple(base[n.split()[0]] for n in PAGE_SNAPSHOT.split(", "))


def test_verify_reasons(spark):
    cases = {
        "https://careers-x.icims.com/jobs/1?notFound=1": ("iCIMS", {}, "icims_not_found"),
        "https://x.com/404": ("Lever", {"http_status": 404}, "http_status"),
        "https://x.com/err": ("Lever", {"final_url": "https://x.com/?error=true"}, "moved"),
        "https://jobs.lever.co/a": ("Lever", {"title": "Careers"}, "generic_title"),
        "https://x.com/f": ("Lever", {"body_text": "Position has been filled"}, "closed_phrase"),
        "https://x.com/a/b/c": ("Lever", {"final_url": "https://x.com"}, "sent_home"),
        "https://careers-x.icims.com/jobs/2": ("iCIMS", {}, "no_location"),
        "https://x.com/timeout": ("Lever", {"fetch_error": "timeout", "http_status": None}, None),
        "https://x.com/late": ("Lever", {"html": '<script type="application/ld+json">{"@type":"JobPosting","validThrough":"2026-01-01"}</script>'}, "expired"),
        "https://careers-x.icims.com/jobs/3": ("iCIMS", {"title": "Boss - Austin, TX - Acme"}, "wrong_location"),
        "https://careers-x.icims.com/jobs/4": ("iCIMS", {"title": "Boss - Remote - Acme"}, None),
    }
    pages = spark.createDataFrame([snapshot(u, **v) for u, (_, v, _) in cases.items()], PAGE_SNAPSHOT)
    jobs = spark.createDataFrame(
        [(u, p, None) for u, (p, _, _) in cases.items()] + [("", "Lever", None), ("https://x.com/unseen", "Lever", None)],
        "application_url string, platform_source string, date_posted date")
    got = {r.application_url: r.close_reason for r in verify.verify(jobs, pages, AS_OF).collect()}
    assert got == {u: w for u, (_, _, w) in cases.items()} | {"": "blank_url", "https://x.com/unseen": None}


def test_probe_summary(spark):
    df = spark.createDataFrame([("lever", "a", 200, 0), ("lever", "b", 200, 3), ("lever", "c", 404, 0)], "platform string, slug string, http_status int, job_count int")
    assert rows(reports.probe_summary(df), "valid", "dead") == [(1, 2)]
    assert rows(reports.dead_probes(df), "slug") == [("a",), ("c",)]
    assert [r.slug for r in reports.candidate_results(df).collect()] == ["b", "a", "c"]


def test_the_tier_is_not_worked_out_to_deal_rows_without_a_key(spark):
    rows = spark.createDataFrame([(1, "Senior Boss", "a", "u1"), (2, "Boss", "b", None), (3, "Boss", "c", "u3")], "id int, title string, company string, url string")
    rows = rows.withColumn("skill_level", classify.tier(F.col("title")))
    statuses = spark.createDataFrame([("u1", "applied"), ("u3", "saved")], "key string, status string")
    shown = facets.facet_query(rows, statuses, hide_recruiters=False, hide_applied=True).select("id")
    assert sorted(r["id"] for r in shown.collect()) == [2, 3]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    assert "regexp_extract_all" not in shown._jdf.queryExecution().explainString(mode)


def test_page_numbers_out_of_range(spark, monkeypatch):
    rows = spark.range(25).repartition(4)
    for early in (facets.EARLY_ROWS, 5):
        monkeypatch.setattr(facets, "EARLY_ROWS", early)
        got = {n: [r["id"] for r in facets.page(rows, ["id"], n, 10).collect()] for n in (-1, 0, 1, 2, 3, 4, 9)}
        first = list(range(10))
        assert got == {-1: first, 0: first, 1: first, 2: list(range(10, 20)), 3: list(range(20, 25)), 4: first, 9: first}
        assert facets.page(rows.filter("id < 20"), ["id"], 3, 10).first()["id"] == 0
        assert facets.page(rows.limit(0), ["id"], 3, 10).collect() == []

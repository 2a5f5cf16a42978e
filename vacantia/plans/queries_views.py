"""Queries of the two views: facets, search, sort, pages, statuses, display columns."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions import display
from vacantia.operators import alerts, facets, map_layout, order, order_index, reports, sketches, text_index
from vacantia.plans import oracle_parts as sql
from vacantia.plans import sample_tables as sample
from vacantia.plans.queries_postings import AS_OF, alert_rows, as_of
from vacantia.plans.registry import query
from vacantia.session import scratch_path
from vacantia.sinks.files import feed_items, jobs_db

P, SLIM, KEYS, ALERT = sql.P, sql.SLIM, sql.KEYS, sql.ALERT
ORD = sample.ORDER
c = F.col

ST = f"st AS (SELECT key, status, ts, event_id FROM ({sample.as_sql(sample.STATUS_EVENTS, 'events')}))"
LAST = ST + ", cur AS (SELECT key, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM st GROUP BY key)"
# postings carry the key of a user event, so that statuses meet them
USER = "'u' || CAST(l_orderkey % 400 AS STRING)"


def slim(spark, sf):
    return sample.slim_postings(spark, sf)


def statuses(spark, sf):
    return facets.current_status(sample.status_events(spark, sf))


@query("f09_hide_recruiters", SLIM + f" SELECT {KEYS} FROM s WHERE NOT is_recruiter")
def f09(spark, sf):
    return facets.facet_query(slim(spark, sf)).select(*ORD)


@query("f10_text_facets", SLIM + f""" SELECT {KEYS} FROM s WHERE regexp_matches(lower(coalesce(title, '')), '\\bit manager\\b')
    AND regexp_matches(lower(company), '\\bsupplier\\b') AND regexp_matches(lower(location), '\\bfl\\b')""")
def f10(spark, sf):
    return facets.facet_query(
        slim(spark, sf), hide_recruiters=False, title=" IT Manager ", company="supplier", location="FL").select(*ORD)


@query("f10_documents", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])of the($|[^a-z0-9_])')")
def f10_documents(spark, sf):
    return sample.table(spark, sf, "documents").filter(facets.facet_text(c("text"), "of the")).select("doc_id")


@query("f11_min_salary", SLIM + f" SELECT {KEYS}, median FROM s WHERE median <> 0 AND median >= 60000")
def f11(spark, sf):
    return facets.facet_query(slim(spark, sf), hide_recruiters=False, salary_min=60000).select(*ORD, "salary.median")


@query("f12_remote_only", SLIM + f""" SELECT {KEYS} FROM s WHERE contains(lower(location), 'remote') OR lower("workplaceType") = 'remote'""")
def f12(spark, sf):
    return facets.facet_query(slim(spark, sf), hide_recruiters=False, remote_only=True).select(*ORD)


@query("f13_platform_and_level", SLIM + f" SELECT {KEYS} FROM s WHERE lower(ats) = 'lever' AND skill_level = 'senior'")
def f13(spark, sf):
    return facets.facet_query(slim(spark, sf), hide_recruiters=False, ats="LEVER", skill_level="Senior").select(*ORD)


@query("f14_include_exclude", SLIM + f""" SELECT {KEYS} FROM s WHERE (contains(lower(coalesce(title, '')), 'engine') OR contains(lower(coalesce(title, '')), 'direct'))
    AND NOT (contains(lower(coalesce(title, '')), 'intern') OR contains(lower(coalesce(title, '')), 'lead s'))""")
def f14(spark, sf):
    return facets.facet_query(
        slim(spark, sf), hide_recruiters=False, include="Engine, direct,,", exclude="intern,lead s").select(*ORD)


@query("f14_part_names", "SELECT p_partkey FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'bolt')")
def f14_parts(spark, sf):
    return sample.table(spark, sf, "part").filter(facets.facet_any_term(c("p_name"), "red, bolt")).select("p_partkey")


@query("f15_status", "WITH " + LAST + ", " + SLIM[5:] + f" SELECT {KEYS} FROM s JOIN cur ON cur.key = {USER} WHERE cur.status = 'saved'")
def f15(spark, sf):
    rows = slim(spark, sf).withColumn("url", F.expr(USER))
    return facets.facet_query(rows, statuses(spark, sf), hide_recruiters=False, status="saved").select(*ORD)


@query("f15_hide_applied", "WITH " + LAST + ", " + SLIM[5:] + f" SELECT {KEYS} FROM s LEFT JOIN cur ON cur.key = {USER} WHERE coalesce(cur.status, '') NOT IN ('applied', 'ignored')")
def f15_hide(spark, sf):
    rows = slim(spark, sf).withColumn("url", F.expr(USER))
    return facets.facet_query(rows, statuses(spark, sf), hide_recruiters=False, hide_applied=True).select(*ORD)


@query("f16_facet_query", "WITH " + LAST + ", " + SLIM[5:] + f""" SELECT {KEYS}, title, company FROM s LEFT JOIN cur ON cur.key = {USER}
    WHERE NOT is_recruiter AND coalesce(cur.status, '') NOT IN ('applied', 'ignored') AND median >= 30000 AND skill_level = 'senior'
    AND regexp_matches(lower(title), '\\bmanager\\b') AND NOT contains(lower(title), 'audit')""")
def f16(spark, sf):
    rows = slim(spark, sf).withColumn("url", F.expr(USER))
    return facets.facet_query(
        rows, statuses(spark, sf), title="manager", exclude="audit", salary_min=30000, skill_level="senior",
        hide_applied=True).select(*ORD, "title", "company")


@query("f16_nothing_set", SLIM + " SELECT count(*) AS n FROM s")
def f16_nothing(spark, sf):
    return facets.facet_query(slim(spark, sf), hide_recruiters=False).agg(F.count("*").alias("n"))


@query("j06_status_lookup", "WITH " + LAST + ", " + P[5:] + f" SELECT {KEYS}, coalesce(cur.status, '') AS status FROM p LEFT JOIN cur ON cur.key = {USER}")
def j06(spark, sf):
    rows = sample.postings(spark, sf).withColumn("url", F.expr(USER))
    return facets.with_status(rows, statuses(spark, sf)).select(*ORD, "status")


# ---- statuses -------------------------------------------------------------------
@query("t08_last_status", "WITH " + LAST + " SELECT key, status FROM cur")
def t08(spark, sf):
    return statuses(spark, sf).select("key", "status")


@query("t08_toggled_status", "WITH " + ST + """, f AS (SELECT key, list_reduce(list_prepend('', list(status ORDER BY ts, event_id)),
    lambda a, b: CASE WHEN a = b THEN '' ELSE b END) AS status FROM st GROUP BY key) SELECT key, status FROM f WHERE status <> ''""")
def t08_toggle(spark, sf):
    return facets.toggled_status(sample.status_events(spark, sf))


# every event marks a job; only some of the keys have a status already
_MARK = {
    "key": "'u' || CAST(user_id * 2 AS STRING)",
    "status": "split_part('saved|applied|ignored', '|', CAST((user_id + (CASE event_type WHEN 'view' THEN 1 ELSE 0 END)) % 3 + 1 AS INT))",
}
_MARKS = f"SELECT DISTINCT key, status FROM ({sample.as_sql(_MARK, 'events')})"


@query("t09_batch_status", "WITH " + LAST + f""", m AS ({_MARKS}), b AS (SELECT key, max(CASE status WHEN 'saved' THEN 1 WHEN 'applied' THEN 2 ELSE 3 END) AS r FROM m GROUP BY key)
    SELECT coalesce(b.key, cur.key) AS key, CASE r WHEN 1 THEN 'saved' WHEN 2 THEN 'applied' WHEN 3 THEN 'ignored' ELSE cur.status END AS status
    FROM cur FULL JOIN b ON b.key = cur.key""")
def t09(spark, sf):
    marks = sample.table(spark, sf, "events").selectExpr(*sample.select_list(_MARK)).distinct()
    return facets.apply_batch(statuses(spark, sf), marks, AS_OF).select("key", "status")


# ---- sort and pages -------------------------------------------------------------
_NAME = "CASE l_orderkey % 3 WHEN 0 THEN CAST(l_partkey AS STRING) || ' Co' WHEN 1 THEN '' ELSE upper(company) END"


@query("o03_column_sort", P + f""", r AS (SELECT {KEYS}, {_NAME} AS name FROM p)
    SELECT {KEYS}, name, row_number() OVER (ORDER BY regexp_matches(lower(name), '^[0-9]'), lower(name) DESC, {KEYS}) AS place FROM r""")
def o03(spark, sf):
    rows = sample.postings(spark, sf).selectExpr(*ORD, f"{_NAME} AS name")
    return _placed(rows.orderBy(*facets.sort_keys(c("name"), ascending=False), *ORD))


def _placed(rows):
    """The place (from 1) of every row of a sorted table, in the order the rows came."""
    return order.number_rows(rows).withColumn("place", c("row_number") + 1).drop("row_number")


_SEEN_DAY = f"({sql.TODAY} - CAST(l_orderkey % 45 AS INT))"
_POSTED = f"(CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE DATE '{sample.AS_OF}' - CAST(l_partkey % 90 AS INT) END)"
_SALARY = "(CASE WHEN l_suppkey % 3 = 0 THEN '$1' WHEN l_suppkey % 3 = 1 THEN '' END)"
_VERIFIED = "(CASE l_partkey % 4 WHEN 0 THEN 'Remote, CA' WHEN 1 THEN 'Tampa, FL' WHEN 2 THEN '' END)"
_CHECKED = (f"(CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST('{sample.AS_OF} 06:00:00' AS TIMESTAMP) - "
            "CAST(l_linenumber % 5 AS INT) * INTERVAL '1' DAY END)")
BOARD = ALERT + f""", d AS (SELECT *, {_SEEN_DAY} AS first_seen, {_POSTED} AS date_posted, {_SALARY} AS salary_posted,
    {_VERIFIED} AS location_verified, {_CHECKED} AS liveness_checked_at FROM a)"""


def board(spark, sf):
    """Alert jobs with dates, salary and verified location."""
    return alert_rows(spark, sf).drop("date_posted").selectExpr(
        "*", f"{_SEEN_DAY} AS first_seen", f"{_POSTED} AS date_posted", f"{_SALARY} AS salary_posted",
        f"{_VERIFIED} AS location_verified", f"{_CHECKED} AS liveness_checked_at")


@query("o04_alert_sort", BOARD + f""" SELECT {KEYS}, row_number() OVER (ORDER BY coalesce(date_posted, first_seen) DESC NULLS LAST, {KEYS}) AS place FROM d""")
def o04(spark, sf):
    rows = board(spark, sf).select(*ORD, "date_posted", "first_seen")
    return _placed(rows.orderBy(*facets.alert_sort_keys("first_seen", ascending=False), *ORD)).select(*ORD, "place")


@query("o04_nulls_last", BOARD + f" SELECT {KEYS}, date_posted, row_number() OVER (ORDER BY date_posted ASC NULLS LAST, {KEYS}) AS place FROM d")
def o04_nulls(spark, sf):
    rows = board(spark, sf).select(*ORD, "date_posted")
    return _placed(rows.orderBy(*facets.alert_sort_keys("date_posted"), *ORD))


@query("o05_jobs_db_order", BOARD + " SELECT job_id, first_seen, row_number() OVER (ORDER BY first_seen DESC, lower(company) DESC, job_id) AS place FROM d")
def o05(spark, sf):
    rows = board(spark, sf).select("job_id", "first_seen", "company")
    return _placed(jobs_db(rows, AS_OF)[1]).select("job_id", "first_seen", "place")


@query("k07_jobs_db", BOARD + " SELECT '2026-06-14T12:00:00Z' AS last_updated, count(*) AS total FROM d")
def k07(spark, sf):
    return jobs_db(board(spark, sf), "2026-06-14T12:00:00Z")[0]


@query("o07_page", SLIM + f" SELECT {KEYS}, title FROM s WHERE title IS NOT NULL ORDER BY title, {KEYS} LIMIT 50 OFFSET 100")
def o07(spark, sf):
    rows = slim(spark, sf).filter("title IS NOT NULL").select(*ORD, "title")
    return facets.page(rows, ["title", *ORD], number=3, size=50)


@query("o07_page_out_of_range", SLIM + f" SELECT {KEYS}, title FROM s WHERE title IS NOT NULL ORDER BY title, {KEYS} LIMIT 25")
def o07_range(spark, sf):
    rows = slim(spark, sf).filter("title IS NOT NULL").select(*ORD, "title")
    return facets.page(rows, ["title", *ORD], number=10**9)


def _stored_titles(spark, sf):
    """The postings with a title, stored in the order of their titles; path, schema and order."""
    rows = slim(spark, sf).filter("title IS NOT NULL").select(*ORD, "title", "skill_level")
    keys, path = ["title", *ORD], scratch_path(spark, "order")
    order_index.write_order(rows, keys, path, rows=4000)
    return path, rows.schema, keys


@query("o07_deep_page", SLIM + f" SELECT {KEYS}, title, skill_level FROM s WHERE title IS NOT NULL ORDER BY title, {KEYS} LIMIT 50 OFFSET 42000")
def o07_deep(spark, sf):
    """Page 841 from a stored order."""
    path, schema, keys = _stored_titles(spark, sf)
    return order_index.page(spark, path, schema, keys, number=841, size=50)


@query("o07_filtered_page", SLIM + f" SELECT {KEYS}, title, skill_level FROM s WHERE title IS NOT NULL AND skill_level = 'senior' ORDER BY title, {KEYS} LIMIT 100 OFFSET 5000")
def o07_filtered(spark, sf):
    """Page 51 of the senior jobs from the same stored order."""
    path, schema, keys = _stored_titles(spark, sf)
    return order_index.page(spark, path, schema, keys, number=51, size=100, where=facets.facet_equal("skill_level", "senior"))


@query("o08_newest_matches", ALERT + f" SELECT company, job_id FROM a WHERE {sql.KEPT} ORDER BY company, job_id LIMIT 20")
def o08(spark, sf):
    return reports.newest_matches(alerts.filter_jobs(alert_rows(spark, sf))).select("company", "job_id")


@query("o08_remaining", ALERT + f" SELECT greatest(count(*) - 20, 0) AS more FROM a WHERE {sql.KEPT}")
def o08_more(spark, sf):
    return reports.remaining_matches(alerts.filter_jobs(alert_rows(spark, sf)))


# ---- counts and search of the alert view ----------------------------------------
@query("a03_board_stats", SLIM + " SELECT count(*) AS jobs, count(DISTINCT nullif(company, '')) AS companies FROM s")
def a03(spark, sf):
    return facets.board_stats(slim(spark, sf))


@query("a06_tab_counts", "WITH " + LAST + ", " + P[5:] + f""" SELECT count(*) AS all_jobs, count(*) FILTER (WHERE status = 'saved') AS saved,
    count(*) FILTER (WHERE status = 'applied') AS applied, count(*) FILTER (WHERE status = 'ignored') AS ignored FROM p LEFT JOIN cur ON cur.key = {USER}""")
def a06(spark, sf):
    return facets.tab_counts(sample.postings(spark, sf).selectExpr(f"{USER} AS job_id"), statuses(spark, sf))


@query("a07_alert_stats", BOARD + f""" SELECT count(*) FILTER (WHERE ats_lever) AS shown, count(*) AS total,
    count(*) FILTER (WHERE {sql.TODAY} - first_seen <= 7) AS added, count(*) FILTER (WHERE salary_posted <> '') AS with_salary
    FROM (SELECT *, platform_source = 'Lever' AS ats_lever FROM d)""")
def a07(spark, sf):
    return facets.alert_stats(board(spark, sf), c("platform_source") == "Lever", sample.AS_OF)


@query("f17_search", "WITH " + LAST + ", " + BOARD[5:] + f""" SELECT {KEYS}, coalesce(cur.status, '') AS status FROM d LEFT JOIN cur ON cur.key = {USER}
    WHERE platform_source = 'Lever' AND contains(lower(title || ' ' || company || ' ' || coalesce(nullif(location_verified, ''), location, '')), 'manager')
    AND coalesce(cur.status, '') NOT IN ('applied', 'ignored')""")
def f17(spark, sf):
    rows = board(spark, sf).withColumn("job_id", F.expr(USER))
    return facets.alert_search(
        rows, statuses(spark, sf), text="Manager", platform="Lever", hide_actioned=True).select(*ORD, "status")


@query("f17_search_tab", "WITH " + LAST + ", " + BOARD[5:] + f""" SELECT {KEYS}, cur.status FROM d JOIN cur ON cur.key = {USER}
    WHERE contains(lower(title || ' ' || company || ' ' || coalesce(nullif(location_verified, ''), location, '')), 'tampa') AND cur.status = 'applied'""")
def f17_tab(spark, sf):
    rows = board(spark, sf).withColumn("job_id", F.expr(USER))
    return facets.alert_search(rows, statuses(spark, sf), text="tampa", tab="applied", hide_actioned=True).select(*ORD, "status")


# ---- display columns ------------------------------------------------------------
@query("p10_display_location", BOARD + f""" SELECT {KEYS}, coalesce(nullif(location_verified, ''), CASE WHEN platform_source = 'iCIMS' AND location = 'United States'
    AND liveness_checked_at IS NOT NULL THEN NULL ELSE nullif(location, '') END) AS shown FROM d""")
def p10(spark, sf):
    shown = display.display_location(c("location_verified"), c("location"), c("platform_source"), c("liveness_checked_at"))
    return board(spark, sf).select(*ORD, shown.alias("shown"))


@query("p11_is_remote", BOARD + f""" SELECT {KEYS}, {sql.any_of("lower(coalesce(nullif(location_verified, ''), location))", ["remote", "anywhere", "work from home", "wfh"])} AS remote FROM d""")
def p11(spark, sf):
    return board(spark, sf).select(*ORD, display.is_remote_alert(c("location_verified"), c("location")).alias("remote"))


@query("p12_new_badge", BOARD + f""" SELECT {KEYS}, coalesce(CAST({sql.TODAY} - date_posted AS BIGINT), 999) AS days, coalesce({sql.TODAY} - date_posted, 999) <= 7 AS is_new FROM d""")
def p12(spark, sf):
    today = F.lit(sample.AS_OF).cast("date")
    return board(spark, sf).select(
        *ORD, display.days_since(c("date_posted"), today).cast("bigint").alias("days"), display.is_new(c("date_posted"), today).alias("is_new"))


@query("p13_shown_date", BOARD + f""" SELECT {KEYS}, CASE WHEN liveness_checked_at IS NOT NULL AND date_posted IS NOT NULL THEN date_posted ELSE first_seen END AS shown,
    CASE WHEN liveness_checked_at IS NOT NULL AND date_posted IS NOT NULL THEN 'Posted' ELSE 'First seen' END AS label FROM d""")
def p13(spark, sf):
    return board(spark, sf).select(
        *ORD, display.shown_date(c("liveness_checked_at"), c("date_posted"), c("first_seen")).alias("shown"),
        display.shown_date_label(c("liveness_checked_at"), c("date_posted")).alias("label"))


@query("p14_verified_label", BOARD + f""" SELECT {KEYS}, CASE WHEN liveness_checked_at IS NULL THEN '' WHEN {sql.TODAY} - CAST(liveness_checked_at AS DATE) = 0 THEN 'Today'
    WHEN {sql.TODAY} - CAST(liveness_checked_at AS DATE) = 1 THEN 'Yesterday' ELSE strftime(liveness_checked_at, '%b %-d') END AS label,
    {sql.TODAY} - CAST(liveness_checked_at AS DATE) > 2 AS is_old FROM d""")
def p14(spark, sf):
    return board(spark, sf).select(
        *ORD, display.verified_label(c("liveness_checked_at"), as_of()).alias("label"),
        display.verified_is_old(c("liveness_checked_at"), as_of()).alias("is_old"))


@query("p19_published_at", BOARD + f" SELECT {KEYS}, CAST(CAST(coalesce(date_posted, first_seen) AS TIMESTAMP) AS VARCHAR) AS published FROM d")
def p19(spark, sf):
    stamp = display.published_at(c("date_posted").cast("string"), c("first_seen").cast("string"), as_of())
    return board(spark, sf).select(*ORD, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("k08_feed_items", BOARD + f""", f AS (SELECT * FROM d WHERE {sql.KEPT})
    SELECT title || ' — ' || company AS title, application_url AS link, title || ' at ' || company || ' (' || CASE WHEN location = '' THEN 'Not specified' ELSE location END
    || ') via ' || platform_source || '. First seen: ' || strftime(first_seen, '%Y-%m-%d') || '.' AS description, job_id AS guid, platform_source AS category,
    strftime(CAST(coalesce(date_posted, first_seen) AS TIMESTAMP), '%a, %d %b %Y %H:%M:%S') || ' +0000' AS "pubDate" FROM f""")
def k08(spark, sf):
    return feed_items(alerts.filter_jobs(board(spark, sf)), AS_OF, "https://feeds.example.com/alerts")


@query("k08_empty_feed", f"""SELECT 'No new matches this run (2026-06-14 12:00 UTC)' AS title, 'https://feeds.example.com/alerts' AS link,
    'The alert system ran but found no new listings matching your filters.' AS description, 'no-new-202606141200' AS guid, CAST(NULL AS VARCHAR) AS category,
    'Sun, 14 Jun 2026 12:00:00 +0000' AS "pubDate" WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey < 0) = 0""")
def k08_empty(spark, sf):
    none = board(spark, sf).filter("company = 'no such company'")
    return feed_items(none, AS_OF, "https://feeds.example.com/alerts")


@query("o06_feed_order", BOARD + f""" SELECT job_id AS guid, row_number() OVER (ORDER BY coalesce(date_posted, first_seen) DESC, job_id) AS place
    FROM d WHERE {sql.KEPT}""")
def o06(spark, sf):
    return _placed(feed_items(alerts.filter_jobs(board(spark, sf)), AS_OF, "https://feeds.example.com/alerts")).select("guid", "place")


# ---- probes ---------------------------------------------------------------------
PR = f"WITH pr AS ({sample.as_sql(sample.PROBES, 'events')})"
_ATS = "(CASE user_id % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(fixed.ATS_NAMES[:5])) + " ELSE 'Lever' END)"
_DEAD_ATS = "CASE WHEN ats = 'Ashby' THEN 404 ELSE http_status END"


@query("a11_url_health", f"WITH pr AS ({sample.as_sql({**sample.PROBES, 'ats': _ATS}, 'events')})" + f""",
    r AS (SELECT * FROM (SELECT * REPLACE ({_DEAD_ATS} AS http_status) FROM pr) WHERE url <> ''),
    g AS (SELECT ats, count(*) AS total, count(*) FILTER (WHERE CASE WHEN http_status = 405 THEN get_status ELSE http_status END < 400) AS alive FROM r GROUP BY ats),
    n AS (SELECT unnest([{", ".join(sql.quoted(x) for x in fixed.ATS_NAMES)}]) AS ats),
    v AS (SELECT n.ats, coalesce(alive, 0) AS alive, coalesce(total, 0) AS total FROM n LEFT JOIN g ON g.ats = n.ats)
    SELECT ats, alive, total, CASE WHEN total = 0 THEN 'NO_URLS' WHEN alive = 0 THEN 'PATTERN_BROKEN' WHEN alive < total * 0.5 THEN 'DEGRADED' ELSE 'OK' END AS status,
    CASE WHEN total = 0 THEN 'Extraction returned nothing - parse path or all samples empty' WHEN alive > 0 THEN '' WHEN ats IN ('Ashby', 'BambooHR', 'Workday')
    THEN 'The built URL is likely stale (you construct this URL)' ELSE 'The provider API shape likely changed (URL is pass-through)' END AS note FROM v""")
def a11(spark, sf):
    rows = sample.table(spark, sf, "events").selectExpr(*sample.select_list({**sample.PROBES, "ats": _ATS}))
    return reports.url_health(rows.withColumn("http_status", F.expr(_DEAD_ATS)))


_OK = "(http_status = 200 AND job_count > 0)"


@query("a12_probe_summary", PR + f" SELECT platform, count(*) FILTER (WHERE {_OK}) AS valid, count(*) FILTER (WHERE NOT {_OK}) AS dead FROM pr GROUP BY platform")
def a12(spark, sf):
    return reports.probe_summary(sample.probes(spark, sf))


@query("a12_dead_probes", PR + f" SELECT platform, slug, http_status FROM pr WHERE NOT {_OK}")
def a12_dead(spark, sf):
    return reports.dead_probes(sample.probes(spark, sf))


@query("o09_candidates", PR + f" SELECT {_OK} AS ok, platform, slug, row_number() OVER (ORDER BY {_OK} DESC, platform, slug) AS place FROM pr")
def o09(spark, sf):
    return _placed(reports.candidate_results(sample.probes(spark, sf))).select("ok", "platform", "slug", "place")


@query("a14_watch_list_sizes", PR + " SELECT platform, count(DISTINCT slug) AS companies FROM pr GROUP BY platform")
def a14(spark, sf):
    return reports.watch_list_sizes(sample.probes(spark, sf).select("platform", "slug").distinct())


_LINE = ("(CASE event_id % 6 WHEN 0 THEN '# note' WHEN 1 THEN '   ' WHEN 2 THEN ' Greenhouse: s' || CAST(user_id AS STRING) || ' ' "
         "WHEN 3 THEN 'workday:c|wd1|x:' || CAST(event_id AS STRING) WHEN 4 THEN 'monster:x' ELSE 'plain line' END)")


@query("s22_candidates", f"""WITH l AS (SELECT event_id, user_id FROM events)
    SELECT CASE event_id % 6 WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'workday' WHEN 4 THEN 'monster' ELSE 'unknown' END AS platform,
    CASE event_id % 6 WHEN 2 THEN 's' || CAST(user_id AS VARCHAR) WHEN 3 THEN 'c|wd1|x:' || CAST(event_id AS VARCHAR) WHEN 4 THEN 'monster:x' ELSE 'plain line' END AS slug,
    event_id % 6 IN (2, 3) AS known FROM l WHERE event_id % 6 >= 2""")
def s22(spark, sf):
    from vacantia.sources.files import parse_candidates

    return parse_candidates(sample.table(spark, sf, "events").selectExpr(f"{_LINE} AS value"))


# ---- stored layouts -------------------------------------------------------------
_BOX = (26, -100.5, 31, -97.5)


@query("f19_stored_viewport", SLIM + f" SELECT {KEYS} FROM s WHERE lat BETWEEN {_BOX[0]} AND {_BOX[2]} AND lng BETWEEN {_BOX[1]} AND {_BOX[3]}")
def f19_stored(spark, sf):
    """A box of the map over postings stored along the curve."""
    rows, path = slim(spark, sf).select(*ORD, "coords"), scratch_path(spark, "map")
    map_layout.write_map(rows, path, ties=ORD, rows=4000)
    return map_layout.viewport(spark, path, rows.schema, *_BOX).select(*ORD)


@query("a08_stored_heatmap", SLIM + """ SELECT count(*) AS points, CAST(sum(n) AS BIGINT) AS jobs FROM (
    SELECT lat, lng, count(*) AS n FROM s WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 75)""")
def a08_stored(spark, sf):
    """The heatmap over the same layout, whole world."""
    rows, path = slim(spark, sf).select(*ORD, "coords"), scratch_path(spark, "map")
    map_layout.write_map(rows, path, ties=ORD, rows=4000)
    cells = facets.heatmap(map_layout.viewport(spark, path, rows.schema, -90, -180, 90, 180))
    return cells.agg(F.count("*").alias("points"), F.sum("n").alias("jobs"))


@query("f14_indexed_terms", SLIM + f" SELECT {KEYS} FROM s WHERE contains(lower(title), 'level 4')")
def f14_indexed(spark, sf):
    """Titles with a term, by the index of trigrams."""
    rows, path = slim(spark, sf).select(*ORD, "title"), scratch_path(spark, "titles")
    text_index.write_text_index(rows, ["title"], ["title", *ORD], path, rows=4000)
    return text_index.search(spark, path, rows.schema, "Level 4", facets.facet_any_term(c("title"), "Level 4")).select(*ORD)


@query("f10_indexed_documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'apache')")
def f10_indexed(spark, sf):
    """Documents with a word, by the index of trigrams."""
    rows, path = sample.table(spark, sf, "documents").select("doc_id", "text"), scratch_path(spark, "texts")
    text_index.write_text_index(rows, ["text"], ["doc_id"], path, rows=50)
    return text_index.search(spark, path, rows.schema, "Apache", facets.facet_any_term(c("text"), "Apache")).select("doc_id")


@query("a03_sketched_stats", SLIM + """, d AS (SELECT ats, count(*) AS jobs, count(DISTINCT nullif(company, '')) AS companies FROM s GROUP BY ats)
    SELECT ats, jobs, true AS within FROM d""")
def a03_sketched(spark, sf):
    """Companies per platform from sketches, against the exact count: within three standard errors."""
    rows = slim(spark, sf).select("ats", "company", "is_recruiter", "l_linenumber")
    chunks = sketches.sketched(rows, "ats", "l_linenumber")  # as if every line number had been a chunk
    exact = rows.groupBy("ats").agg(F.count_distinct(F.nullif(c("company"), F.lit(""))).alias("exact"))
    both = sketches.united(chunks, "ats").join(exact, "ats")
    return both.select("ats", "jobs", (F.abs(c("companies") - c("exact")) <= 0.05 * c("exact")).alias("within"))

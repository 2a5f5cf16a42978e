"""Queries of the source normalisers over landed payloads."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.operators import reports
from vacantia.plans import oracle_parts as sql
from vacantia.plans import sample_tables as sample
from vacantia.plans.registry import query
from vacantia.sources import boards, watch_list

c = F.col
R = "WITH r AS (SELECT *, " + ", ".join(sample.select_list(sample.RAW_COLUMNS)) + f" FROM ({sample.as_sql(sample.POSTINGS, 'lineitem')}))"
BASE = ["company", "company_slug", "title", "location", "url", "is_recruiter", "ats", "skill_level"]


def raw(spark, sf):
    return sample.raw_payloads(spark, sf)


def _common(title, slug="raw_slug", ats=None):
    return f"{slug} AS company, raw_slug AS company_slug, {sql.recruiter(slug)} AS is_recruiter, '{ats}' AS ats, {sql.tier(title)} AS skill_level"


@query("s03_greenhouse", R + f"""SELECT {_common('title', ats='Greenhouse')}, title, location, url, url AS absolute_url, 'Ops|Greenhouse' AS departments,
    CAST(job_no AS VARCHAR) AS id, scraped_at AS updated_at FROM r WHERE ats = 'Greenhouse' AND status_code = 200 UNION ALL
    SELECT raw_slug, raw_slug, false, 'Greenhouse', 'mid', 'Nurse', 'Not specified', '', '', '', CAST(job_no + 1 AS VARCHAR), NULL FROM r WHERE ats = 'Greenhouse' AND status_code = 200""")
def s03(spark, sf):
    return boards.normalise(raw(spark, sf), "Greenhouse").withColumn("departments", F.array_join("departments", "|"))


@query("s04_ashby", R + f"""SELECT {_common('title', ats='Ashby')}, coalesce(title, '') AS title, location,
    'https://jobs.ashbyhq.com/' || raw_slug || '/' || CAST(job_no AS VARCHAR) AS url FROM r WHERE ats = 'Ashby' AND status_code = 200""")
def s04(spark, sf):
    return boards.normalise(raw(spark, sf), "Ashby")


@query("s05_bamboohr", R + f"""SELECT {_common('title', ats='BambooHR')}, title, full_loc AS location,
    'https://' || raw_slug || '.bamboohr.com/careers/' || CAST(job_no AS VARCHAR) AS url FROM (SELECT *, coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(state, '')), ''), 'Not specified') AS full_loc FROM r)
    WHERE ats = 'BambooHR' AND status_code = 200 AND contains(content_type, 'application/json')""")
def s05(spark, sf):
    return boards.normalise(raw(spark, sf), "BambooHR")


@query("s06_lever", R + f"""SELECT {_common('title', ats='Lever')}, title, location, url FROM r WHERE ats = 'Lever' AND status_code = 200""")
def s06(spark, sf):
    return boards.normalise(raw(spark, sf), "Lever")


_PAGES = R + f""", w AS (SELECT *, CASE WHEN status_code = 200 AND job_no % 59 <> 0 THEN 1 ELSE 0 END AS n, CASE WHEN status_code = 200 THEN total ELSE 0 END AS seen_total
    FROM r WHERE ats = 'Workday' AND raw_slug <> 'bad|slug'),
    f AS (SELECT *, first_value(seen_total) OVER (PARTITION BY raw_slug ORDER BY job_no) AS first_total FROM w),
    g AS (SELECT *, min(CASE WHEN seen_total = first_total AND n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY raw_slug ORDER BY job_no) AS ok FROM f),
    good AS (SELECT * FROM g WHERE ok = 1 AND (job_no = 0 OR job_no < first_total))"""


@query("s08_page_prefix", _PAGES + " SELECT raw_slug AS slug, job_no AS page_offset FROM good")
def s08(spark, sf):
    pages = boards.consistent_pages(boards.workday_pages(raw(spark, sf)))
    return pages.select("slug", c("offset").cast("bigint").alias("page_offset"))


@query("w06_page_window", _PAGES + " SELECT raw_slug AS slug, count(*) AS pages, max(job_no) AS last_offset FROM good GROUP BY 1")
def w06(spark, sf):
    pages = boards.consistent_pages(boards.workday_pages(raw(spark, sf)))
    return pages.groupBy("slug").agg(F.count("*").alias("pages"), F.max(c("offset").cast("bigint")).alias("last_offset"))


@query("s07_workday", _PAGES + f""" SELECT {_common('title', slug="split_part(raw_slug, '|', 1)", ats='Workday')}, title, CASE WHEN location = '' THEN 'Not specified' ELSE location END AS location,
    'https://' || split_part(raw_slug, '|', 1) || '.' || split_part(raw_slug, '|', 2) || '.myworkdayjobs.com/ext/job/p' || CAST(job_no AS VARCHAR) AS url FROM good""")
def s07(spark, sf):
    return boards.normalise(raw(spark, sf), "Workday")


_ICIMS_TITLE = "(CASE l_partkey % 4 WHEN 0 THEN 'Senior It Manager' WHEN 1 THEN 'O''Neil Clerk' WHEN 2 THEN 'Nurse+Aide' ELSE '2Nd Shift Lead' END)"


@query("s09_icims", R + f"""SELECT {_common(_ICIMS_TITLE, ats='iCIMS')}, {_ICIMS_TITLE} AS title, 'Not specified' AS location,
    'https://careers-x.icims.com/jobs/' || CAST(job_no AS VARCHAR) || '/' || path_words || '/job' AS url, false AS remote FROM r WHERE ats = 'iCIMS' AND status_code = 200""")
def s09(spark, sf):
    return boards.normalise(raw(spark, sf), "iCIMS").drop("coords")


@query("e1_all_postings", R + """SELECT ats, source, count(*) AS n FROM (SELECT 'automated' AS source, ats, unnest(range(CASE WHEN ats = 'Greenhouse' THEN 2 ELSE 1 END)) AS i
    FROM r WHERE status_code = 200 AND ats <> 'Workday' AND (ats <> 'BambooHR' OR contains(content_type, 'application/json')) UNION ALL SELECT 'automated', 'Workday', 0 FROM (""" + _PAGES.replace("WITH r", "WITH r") + """ SELECT * FROM good)) GROUP BY 1, 2""")
def e1(spark, sf):
    return boards.all_postings(raw(spark, sf), "2026-06-14 12:00:00").groupBy("ats", "source").agg(F.count("*").alias("n"))


@query("a01_fetch_results", _PAGES + """, n AS (
        SELECT ats, raw_slug, CASE ats WHEN 'Greenhouse' THEN 2 ELSE 1 END AS jobs FROM r
        WHERE status_code = 200 AND ats <> 'Workday' AND (ats <> 'BambooHR' OR contains(content_type, 'application/json'))
        UNION ALL SELECT 'Workday', raw_slug, 1 FROM good),
    st AS (SELECT ats, raw_slug, max(CASE WHEN ats = 'BambooHR' AND status_code = 200 AND NOT contains(content_type, 'application/json') THEN 404 ELSE status_code END) AS status FROM r GROUP BY 1, 2),
    b AS (SELECT st.ats, st.raw_slug, status, coalesce((SELECT sum(jobs) FROM n WHERE n.ats = st.ats AND n.raw_slug = st.raw_slug), 0) AS jobs FROM st)
    SELECT ats, count(*) AS checked, count(*) FILTER (WHERE jobs > 0) AS active, count(*) FILTER (WHERE jobs = 0) AS failed,
    count(*) FILTER (WHERE jobs = 0 AND status IN (404, 410)) AS newly_dead, CAST(sum(jobs) AS BIGINT) AS jobs FROM b GROUP BY ats""")
def a01_fetch(spark, sf):
    return reports.fetch_report(boards.fetch_results(raw(spark, sf)))


# ---- watched boards -------------------------------------------------------------
def watched(spark, sf):
    slugs = raw(spark, sf).select(F.lower("ats").alias("platform"), "slug").distinct()
    return slugs.filter(c("platform").isin(fixed.WATCH_PLATFORMS)).withColumn("name", F.concat(F.lit("Name of "), c("slug")))


_NAMED = "'Name of ' || raw_slug AS company, raw_slug AS company_slug"


@query("s10_watched_greenhouse", R + f"""SELECT {sql.job_id("'greenhouse'", 'raw_slug', 'CAST(job_no AS VARCHAR)')} AS job_id, trim(coalesce(title, '')) AS title, {_NAMED}, trim(location) AS location, url AS application_url,
    TRY_CAST(substr(scraped_at, 1, 10) AS DATE) AS date_posted, 'Greenhouse' AS platform_source FROM r WHERE ats = 'Greenhouse' AND status_code = 200 UNION ALL
    SELECT {sql.job_id("'greenhouse'", 'raw_slug', 'CAST(job_no + 1 AS VARCHAR)')}, 'Nurse', {_NAMED}, '', '', NULL, 'Greenhouse' FROM r WHERE ats = 'Greenhouse' AND status_code = 200""")
def s10(spark, sf):
    return watch_list.greenhouse(raw(spark, sf), watched(spark, sf))


@query("s11_watched_lever", R + f"""SELECT {sql.job_id("'lever'", 'raw_slug', 'CAST(job_no AS VARCHAR)')} AS job_id, trim(coalesce(title, '')) AS title, {_NAMED}, trim(location) AS location, url AS application_url,
    CAST(make_timestamp(created_ms * 1000) AS DATE) AS date_posted, 'Lever' AS platform_source FROM r WHERE ats = 'Lever' AND status_code = 200""")
def s11(spark, sf):
    return watch_list.lever(raw(spark, sf), watched(spark, sf))


def searched(spark, sf):
    """Workday pages of the search terms with small offsets, so that many tie."""
    return raw(spark, sf).withColumn("offset", F.expr("offset % 150"))


_HITS = R + f""", h AS (SELECT *, list_position([{", ".join(sql.quoted(t) for t in fixed.WORKDAY_SEARCH_TERMS)}], term) AS t, job_no % 150 AS off, '/job/p' || CAST(job_no AS VARCHAR) AS path
    FROM r WHERE ats = 'Workday' AND status_code = 200 AND raw_slug <> 'bad|slug' AND job_no % 59 <> 0 AND term <> 'other')"""


@query("s12_watched_workday_totals", _HITS + """ SELECT raw_slug AS slug, count(DISTINCT path) AS hits FROM h GROUP BY raw_slug""")
def s12_totals(spark, sf):
    rows = watch_list.workday(searched(spark, sf), watched(spark, sf))
    return rows.groupBy(c("company_slug").alias("slug")).agg(F.count("*").alias("hits"))


@query("s12_watched_workday", _HITS + f""", u AS (SELECT *, row_number() OVER (PARTITION BY raw_slug, path ORDER BY t, off) AS rn FROM h)
    SELECT {sql.job_id("'workday'", 'raw_slug', 'path')} AS job_id, 'https://' || split_part(raw_slug, '|', 1) || '.' || split_part(raw_slug, '|', 2) || '.myworkdayjobs.com/ext' || path AS application_url
    FROM u WHERE rn = 1""")
def s12(spark, sf):
    rows = watch_list.workday(searched(spark, sf), watched(spark, sf))
    return rows.select("job_id", "application_url")

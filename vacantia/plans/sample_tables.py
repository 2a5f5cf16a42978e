"""Postings, sightings, pages and probes derived from the given test tables.

The test tables hold no postings, so each column below is an SQL expression over
``lineitem`` (or ``events``, ``orders``, ``pages``). The texts use only syntax that
Spark SQL and DuckDB share; the checks read the same texts on both engines.
"""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.classify import is_recruiter, tier

AS_OF = "2026-06-14"
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _q(text):
    return "'" + text.replace("'", "''") + "'"


def _case(number, values):
    """The value at a position; a short expression however long the list is."""
    return f"split_part({_q('|'.join(values))}, '|', CAST({number} + 1 AS INT))"


LEVELS = ["Senior ", "Junior ", "", "Principal ", "Associate ", "Lead ", "Graduate ", "", "Sr. ",
          "Entry-Level ", "", "Chief "]
ROLES = [
    "Software Engineer", "IT Manager", "Director of IT", "Infrastructure Operations Manager",
    "Data Scientist", "Accountant", "Paralegal", "Registered Nurse", "Head of IT, Product Owner",
    "Internal Audit IT Manager", "Pursuit Director", "Vice President, IT", "Service Delivery Director",
    "Resident Physician", "Dental Assistant", "Director of IT,x Systems", "IT Operations Manager",
    "Member of Technical Staff", "Engr 5", "Head of Technology", "Software Engineering Intern",
    "Manager, Infrastructure", "Director Intern Program", "Analyst",
]
SUFFIXES = ["", " I", " II", " 1 - 2", " III", " (Remote)", " Level 4", " 1"]
LOCATIONS = [
    "Remote", "Miami, FL", "Milwaukee, WI (Remote)", "China-Remote Location-Beijing", "Bozeman, MT", "US", "",
    "San Francisco, CA", "New York, NY", "Brooklyn, NY", "New York", "Hybrid - Austin TX",
    "Austin HQ, TX", "Saint Louis, MO", "Ft Worth, TX", "London", "Berlin, Germany",
    "Toronto, ON, Canada", "Little Rock, AR", "Bozeman, Montana", "Remote - US", "EST time zone",
    "3 Locations", "Not specified", "United States", "Jacksonville, FL", "Spring, Texas, United States of America",
    "Indianapolis, IN (Remote)", "US-FL-Miami", "US-CA-Valencia", "LB-Beirut", "SF Bay Area",
    "Hybrid in London", "St. Louis (HQ), MO", "Orlando, Florida", "Austin, Austin, TX", "Anywhere",
    "Toronto", "Nowhere Town, ZZ", "Work From Home",
]
# (city, admin, country, lat, lng), in gazetteer order
GAZETTEER = [
    ("San Francisco", "CA", "US", 37.77493, -122.41942), ("New York City", "NY", "US", 40.71427, -74.00597),
    ("London", "ENG", "GB", 51.50853, -0.12574), ("London", "ON", "CA", 42.98339, -81.23304),
    ("Berlin", "BE", "DE", 52.52437, 13.41053), ("Toronto", "ON", "CA", 43.70643, -79.39864),
    ("Austin", "TX", "US", 30.26715, -97.74306), ("Little Rock", "AR", "US", 34.74648, -92.28959),
    ("Bozeman", "MT", "US", 45.67965, -111.03856), ("Fort Worth", "TX", "US", 32.72541, -97.32085),
    ("St. Louis", "MO", "US", 38.62727, -90.19789), ("Miami", "FL", "US", 25.77427, -80.19366),
    ("Jacksonville", "FL", "US", 30.33218, -81.65565), ("Spring", "TX", "US", 30.07994, -95.41716),
    ("Orlando", "FL", "US", 28.53834, -81.37924), ("Beirut", None, "LB", 33.89332, 35.50157),
]

_LOC = "((l_orderkey * 3 + l_linenumber * 5 + l_partkey) % 40)"

POSTINGS = {
    **{name: name for name in ORDER},
    "ats": _case("l_suppkey % 6", fixed.ATS_NAMES),
    "company": (
        "(CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE (CASE l_suppkey % 10 WHEN 0 THEN 'talent-' WHEN 3 THEN "
        "'search ' WHEN 6 THEN 'uk-' ELSE '' END) || 'supplier-' || CAST(l_suppkey AS STRING) END)"
    ),
    "title": (
        "(CASE WHEN l_orderkey % 61 = 0 THEN 'N/A' WHEN l_orderkey % 67 = 0 THEN '  ' WHEN l_orderkey % 71 = 0 "
        "THEN NULL ELSE " + _case("l_partkey % 12", LEVELS) + " || " + _case("l_orderkey % 24", ROLES) + " || "
        + _case("l_linenumber % 8", SUFFIXES) + " END)"
    ),
    "location": _case(_LOC, LOCATIONS),
    "url": (
        "(CASE WHEN l_orderkey % 89 = 0 THEN '' WHEN l_suppkey % 6 = 4 THEN 'https://supplier-' || "
        "CAST(l_suppkey AS STRING) || '.wd1.myworkdayjobs.com/careers/jobs/' || CAST(l_orderkey % 5000 AS STRING) "
        "|| '-x' || CAST(l_linenumber AS STRING) WHEN l_suppkey % 6 = 5 THEN 'https://careers-supplier.icims.com/jobs/' "
        "|| CAST(l_orderkey % 5000 AS STRING) || '/job' ELSE 'https://jobs.example.com/p/' || "
        "CAST(l_orderkey % 5000 AS STRING) END)"
    ),
    "scraped_at": (
        f"(CASE WHEN l_orderkey % 41 = 0 THEN NULL WHEN l_orderkey % 43 = 0 THEN 'unreadable' ELSE "
        f"CAST(DATE '{AS_OF}' - CAST(l_orderkey % 60 AS INT) AS STRING) || 'T' || "
        f"lpad(CAST(l_partkey % 24 AS STRING), 2, '0') || ':30:00Z' END)"
    ),
    "workplaceType": "(CASE l_partkey % 7 WHEN 0 THEN 'Remote' WHEN 1 THEN 'onsite' ELSE NULL END)",
    "remote": "(l_partkey % 5 = 0)",
    "amount": "CAST(FLOOR(l_extendedprice) AS BIGINT)",
    "median": "(CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(FLOOR(l_extendedprice) AS BIGINT) END)",
    "lat": "(CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(25 + l_suppkey % 40 AS DOUBLE) + CAST(0.125 AS DOUBLE) END)",
    "lng": "(CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_suppkey % 7 - 100 AS DOUBLE) - CAST(0.5 AS DOUBLE) END)",
}

# one sighting of a job id per event
SIGHTINGS = {
    "job_id": "'j' || CAST(user_id * 7 + CAST(event_id % 31 AS BIGINT) AS STRING)",
    "day": "CAST(ts AS DATE)",
    "event_id": "event_id",
}
STATUS_EVENTS = {
    "key": "'u' || CAST(user_id AS STRING)",
    "status": "(CASE event_type WHEN 'view' THEN 'saved' WHEN 'click' THEN 'applied' WHEN 'purchase' THEN "
              "'ignored' WHEN 'signup' THEN 'saved' ELSE 'applied' END)",
    "ts": "ts",
    "event_id": "event_id",
}
PROBES = {
    "platform": _case("user_id % 3", fixed.WATCH_PLATFORMS),
    "slug": "'s' || CAST(user_id AS STRING)",
    "event_id": "event_id",
    "url": "(CASE WHEN event_id % 17 = 0 THEN '' ELSE 'https://x.example.com/' || CAST(event_id AS STRING) END)",
    "http_status": "(CASE WHEN event_type = 'error' THEN 404 WHEN event_type = 'signup' THEN 405 ELSE 200 END)",
    "get_status": "(CASE WHEN value > 20 THEN 200 ELSE 500 END)",
    "job_count": "CAST(FLOOR(value) AS INT) % 4",
    "ts": "ts",
}


def select_list(columns, names=None):
    return [f"{columns[n]} AS {n}" for n in (names or columns)]


def as_sql(columns, table, names=None, where=None):
    """The same derivation as a SELECT text for DuckDB."""
    return f"SELECT {', '.join(select_list(columns, names))} FROM {table}" + (f" WHERE {where}" if where else "")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*select_list(POSTINGS))


def slim_postings(spark, sf_dir):
    """Postings with tier, recruiter flag, salary and coordinates as the views read them."""
    return postings(spark, sf_dir).withColumns({
        "skill_level": tier(F.col("title")),
        "is_recruiter": is_recruiter(F.col("company")),
        "salary": F.when(F.col("median").isNotNull(), F.struct("median")),
        "coords": F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")),
    })


def sightings(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*select_list(SIGHTINGS))


def status_events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*select_list(STATUS_EVENTS))


def probes(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*select_list(PROBES))


def gazetteer(spark):
    rows = [(i, *row) for i, row in enumerate(GAZETTEER)]
    return spark.createDataFrame(rows, "pos int, city string, admin string, country string, lat double, lng double")


# ---- landing rows: one answered page per line item ------------------------------
_ID = "(l_orderkey * 10 + l_linenumber)"
RAW_COLUMNS = {
    "job_no": _ID,
    "raw_slug": (
        "(CASE WHEN l_suppkey % 6 <> 4 THEN 's' || CAST(l_suppkey AS STRING) WHEN l_suppkey % 20 = 4 THEN 'bad|slug' "
        "ELSE 'acme' || CAST(l_suppkey AS STRING) || '|wd' || CAST(l_suppkey % 5 + 1 AS STRING) || '|ext' END)"
    ),
    "status_code": "(CASE WHEN l_orderkey % 53 = 0 THEN 404 ELSE 200 END)",
    "content_type": "(CASE WHEN l_orderkey % 47 = 0 THEN 'text/html' ELSE 'application/json; charset=utf-8' END)",
    "total": "CAST(2000000000 - (CASE WHEN l_orderkey % 37 = 0 THEN 1 ELSE 0 END) AS INT)",
    "created_ms": "(CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE 1700000000000 + l_orderkey * 86400000 % 10000000000 END)",
    "city": "(CASE l_partkey % 4 WHEN 0 THEN 'Miami' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'A City With A Name That Is Well Over Fifty Characters Long' END)",
    "state": "(CASE l_orderkey % 3 WHEN 0 THEN 'FL' WHEN 1 THEN '' ELSE NULL END)",
    "path_words": "(CASE l_partkey % 4 WHEN 0 THEN 'senior-it-manager' WHEN 1 THEN 'o%27neil-clerk' WHEN 2 THEN 'nurse+aide' ELSE '2nd-shift-lead' END)",
    "term": _case("l_partkey % 5", fixed.WORKDAY_SEARCH_TERMS + ["other"]),
}


def raw_payloads(spark, sf_dir):
    """Landing table with bodies as the six platforms would send them."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        *select_list(POSTINGS, ["ats", "title", "location", "url", "scraped_at"]), *select_list(RAW_COLUMNS))
    job = {
        "Greenhouse": """named_struct('jobs', array(named_struct('id', job_no, 'title', title, 'absolute_url', url, 'updated_at',
            scraped_at, 'location', named_struct('name', location), 'departments', array(named_struct('name', 'Ops'),
            named_struct('name', ats))), named_struct('id', job_no + 1, 'title', 'Nurse', 'absolute_url', '', 'updated_at', NULL,
            'location', named_struct('name', NULL), 'departments', NULL)))""",
        "Ashby": """named_struct('data', named_struct('jobBoard', named_struct('jobPostings', array(named_struct('id', job_no,
            'title', title, 'locationName', location)))))""",
        "BambooHR": """named_struct('result', array(named_struct('id', job_no, 'jobOpeningName', title, 'location',
            named_struct('city', city, 'state', state))))""",
        "Lever": """array(named_struct('id', job_no, 'text', title, 'hostedUrl', url, 'createdAt', created_ms, 'categories',
            named_struct('location', location)))""",
        "Workday": """named_struct('total', total, 'jobPostings', CASE WHEN job_no % 59 = 0 THEN NULL ELSE array(named_struct('title', title,
            'externalPath', '/job/p' || CAST(job_no AS STRING), 'locationsText', location, 'postedOn', 'Posted Today')) END)""",
    }
    arms = " ".join(f"WHEN '{ats}' THEN to_json({text})" for ats, text in job.items())
    sitemap = """concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://careers-x.icims.com/jobs/',
        job_no, '/', path_words, '/job </loc></url><url><loc>https://careers-x.icims.com/jobs/intro</loc></url><url><loc>https://careers-x.icims.com/jobs/',
        job_no, '</loc></url></urlset>')"""
    return rows.selectExpr(
        "ats", "raw_slug AS slug", "0 AS page", "CAST(job_no AS INT) AS offset", "total", "status_code", "content_type",
        f"CASE ats {arms} ELSE {sitemap} END AS body", "term AS search_term")


# ---- page snapshots -------------------------------------------------------------
_N = "CAST(page_id AS STRING)"
_LD = {
    8: '{"@type":"JobPosting","validThrough":"2026-06-13T00:00"}',
    11: '{"@type":"JobPosting","datePosted":"2026-06-01","jobLocation":{"address":{"addressLocality":"Austin","addressRegion":"TX","addressCountry":"US"}}}',
    12: '{"@type":"JobPosting","jobLocationType":"Fully Remote","validThrough":"2026-06-14","baseSalary":{"value":{"minValue":90000}}}',
    13: '{"@type":"JobListing","dateCreated":"06/03/2026","jobLocation":[{"address":{"addressLocality":"Orlando","addressRegion":"FL"}}],"baseSalary":{"value":{"minValue":90000,"maxValue":"120000"}}}',
    21: '{"@type":"JobPosting","estimatedSalary":{"value":81000.5},"jobLocation":{"address":{"addressCountry":"USA"}}}',
    23: '[{"@type":"Organization"},{"@type":"JobPosting","datePosted":"2026-05-30","applicantLocationRequirements":{"addressRegion":"Florida"}}]',
    25: '{"@type":"JobPosting","jobLocation":{"address":{"addressLocality":"Berlin","addressCountry":"DE"}}}',
}
_BODY = {
    6: "Sorry! This position has been FILLED.",
    10: "Apply now\nLocation: Remote, US\nSalary range: $95k - $130k",
    20: "Earn $100,000 - $90,000 a year. Posted 3 days ago",
    21: "Posted on June 4, 2026",
    22: "Compensation up to $120,000. Posted: 06/04/2026. Raised $50,000,000",
}
_URLS = {
    0: "''", 1: "'https://careers-x.icims.com/jobs/1/job?notFound=1&p=' || " + _N,
    5: "'https://jobs.ashbyhq.com/acme/' || " + _N, 9: "'https://careers-x.icims.com/jobs/9/job?p=' || " + _N,
    10: "'https://careers-x.icims.com/jobs/10/job?p=' || " + _N,
    15: "'https://acme.wd5.myworkdayjobs.com/ext/job/Miami/Boss_R' || " + _N,
    16: "'https://acme.wd5.myworkdayjobs.com/ext/job/Miami/Boss_R' || " + _N,
    17: "'https://www.acme.com/careers/open?gh_jid=' || " + _N, 18: "'https://jobs.acme.com/careers/open?gh_jid=' || " + _N,
    19: "'https://unknown.org/careers/open?gh_jid=' || " + _N, 24: "'https://careers-x.icims.com/jobs/24/job?p=' || " + _N,
}


def _cases(values, default, render=_q):
    return "(CASE page_id % 26 " + " ".join(f"WHEN {k} THEN {render(v)}" for k, v in values.items()) + f" ELSE {default} END)"


PAGES = {
    "page_id": "page_id",
    "kind": "page_id % 26",
    "url": _cases(_URLS, "'https://x.example.com/jobs/list/open/' || " + _N, render=str),
    "final_url": _cases(
        {3: "'https://x.example.com/jobs?error=true'", 7: "'https://x.example.com'", 5: "'https://jobs.ashbyhq.com/acme/'"}, "NULL", render=str),
    "http_status": "(CASE WHEN page_id % 26 = 2 THEN 404 ELSE 200 END)",
    "title": _cases({4: " Careers ", 5: "Jobs", 24: "Boss - Tampa, FL - Acme"}, "'Boss at Acme'"),
    "platform_source": "(CASE WHEN page_id % 26 IN (1, 9, 10, 24) THEN 'iCIMS' ELSE 'Lever' END)",
    "fetch_error": "(CASE WHEN page_id % 26 = 14 THEN 'timeout' END)",
    "html": "html || " + _cases(
        {k: f'<script type="application/ld+json">{v}</script>' for k, v in _LD.items()}
        | {17: '<script src="https://boards.greenhouse.io/embed/job_board/js?for=acme17"></script>'}, "''"),
    "body_text": _cases(_BODY, "''") + " || ' ' || html",
}


def page_rows(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr(*select_list(PAGES))


def snapshots(spark, sf_dir):
    """Page snapshots, every one landed twice; the later landing counts."""
    rows = page_rows(spark, sf_dir).withColumn("fetched_at", F.lit(f"{AS_OF} 06:00:00").cast("timestamp"))
    earlier = rows.withColumns({"fetched_at": F.lit("2026-06-01").cast("timestamp"), "http_status": F.lit(500)})
    return rows.unionByName(earlier).filter("url <> ''")


def page_jobs(spark, sf_dir):
    """One alert job per page."""
    return page_rows(spark, sf_dir).selectExpr(
        "page_id", "kind", "'p' || CAST(page_id AS STRING) AS job_id", "'Boss' AS title", "'acme' AS company",
        "'United States' AS location", "url AS application_url", "platform_source", "CAST(NULL AS DATE) AS date_posted")


def board_answers(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr(
        "CASE page_id % 26 WHEN 17 THEN 'acme17' WHEN 18 THEN 'acme' ELSE 'nobody' END AS slug",
        "CAST(page_id AS STRING) AS posting_id", "CASE page_id % 26 WHEN 17 THEN 200 ELSE 404 END AS status_code",
        "'Remote' AS location", "'2026-05-05T10:00:00Z' AS updated_at")


def workday_searches(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr(
        "'acme.wd5.myworkdayjobs.com' AS host", "'ext' AS tenant", "'R' || CAST(page_id AS STRING) AS posting",
        "200 AS status_code", "CASE page_id % 26 WHEN 16 THEN 1 ELSE 0 END AS total", "'Posted 7 Days Ago' AS posted_on",
        "' Remote - US ' AS locations_text")

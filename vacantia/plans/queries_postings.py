"""Queries over the postings table: scalar columns, filters, merge, order, totals."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions import classify, display
from vacantia.functions.money import thousands
from vacantia.functions.text import first_non_empty, strip
from vacantia.operators import alerts, clean, companies, merge, order, reports
from vacantia.operators.joins import first_per_group, last_per_group
from vacantia.plans import oracle_parts as sql
from vacantia.plans import sample_tables as sample
from vacantia.plans.registry import query
from vacantia.schemas import SLIM_COLUMNS
from vacantia.sources.boards import with_run_metadata

KEYS, P, SLIM, ALERT = sql.KEYS, sql.P, sql.SLIM, sql.ALERT
ORD = sample.ORDER
AS_OF = f"{sample.AS_OF} 12:00:00"
c = F.col


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def alert_rows(spark, sf):
    return alerts.to_alert_jobs(sample.slim_postings(spark, sf), keep=ORD)


def sides(spark, sf):
    rows = sample.postings(spark, sf)
    return rows.filter("l_linenumber <= 4"), rows.filter("l_linenumber > 4")


# ---- scalar columns -------------------------------------------------------------
@query("p01_tier", P + f" SELECT {KEYS}, {sql.tier('title')} AS tier FROM p")
def p01(spark, sf):
    return sample.postings(spark, sf).select(*ORD, classify.tier(c("title")).alias("tier"))


@query("p02_recruiter", P + f" SELECT {KEYS}, {sql.recruiter('company')} AS is_recruiter FROM p")
def p02(spark, sf):
    return sample.postings(spark, sf).select(*ORD, classify.is_recruiter(c("company")).alias("is_recruiter"))


@query("p03_job_id", P + f" SELECT {KEYS}, {sql.job_id('ats', 'company', 'url')} AS job_id FROM p")
def p03(spark, sf):
    return sample.postings(spark, sf).select(*ORD, classify.job_id(c("ats"), c("company"), c("url")).alias("job_id"))


@query("p04_posting_key", P + f" SELECT {KEYS}, {sql.posting_key()} AS posting_key FROM p")
def p04(spark, sf):
    return sample.postings(spark, sf).select(
        *ORD, classify.posting_key(c("ats"), c("company"), c("url")).alias("posting_key"))


@query("p05_run_metadata", P + f" SELECT source, CAST(scraped_at AS VARCHAR) AS scraped_at, count(*) AS n FROM (SELECT 'automated' AS source, {sql.AS_OF} AS scraped_at FROM p) GROUP BY ALL")
def p05(spark, sf):
    rows = with_run_metadata(sample.postings(spark, sf), AS_OF)
    return rows.groupBy("source", c("scraped_at").cast("string").alias("scraped_at")).agg(F.count("*").alias("n"))


@query("p06_slim_projection", SLIM + f""" SELECT {KEYS}, title, company, location, url, ats, skill_level, is_recruiter,
    "workplaceType", scraped_at, remote, median, lat FROM s""")
def p06(spark, sf):
    return sample.slim_postings(spark, sf).select(*ORD, *SLIM_COLUMNS).select(
        *ORD, *[n for n in SLIM_COLUMNS if n not in ("coords", "salary")], "salary.median", "coords.lat")


@query("p07_trimmed_location", P + f" SELECT {KEYS}, trim(location) AS location FROM p")
def p07(spark, sf):
    return sample.postings(spark, sf).select(*ORD, strip(c("location")).alias("location"))


@query("p08_fallbacks", P + f""" SELECT {KEYS}, coalesce(nullif(url, ''), absolute_url) AS url,
    coalesce(nullif(company, ''), company_slug, 'Unknown') AS company, location
    FROM (SELECT {KEYS}, url, 'https://abs.example.com/' || CAST(l_orderkey AS VARCHAR) AS absolute_url, company,
          CASE WHEN l_suppkey % 2 = 0 THEN 'slug' END AS company_slug, coalesce(nullif(location, ''), 'Not specified') AS location FROM p)""")
def p08(spark, sf):
    rows = sample.postings(spark, sf).select(
        *ORD, "url", F.concat(F.lit("https://abs.example.com/"), c("l_orderkey")).alias("absolute_url"), "company",
        F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 'slug' END").alias("company_slug"), first_non_empty(c("location")).alias("location"))
    return clean.with_fallbacks(rows).select(*ORD, "url", "company", "location")


@query("p09_thousands", P + f" SELECT {KEYS}, CASE WHEN median <> 0 THEN '$' || CAST(CAST(round(median / 1000.0) AS BIGINT) AS VARCHAR) || 'k' END AS label FROM p")
def p09(spark, sf):
    return sample.postings(spark, sf).select(*ORD, thousands(c("median")).alias("label"))


@query("p16_company_display", P + r""" SELECT DISTINCT company, array_to_string(list_transform(string_split(replace(company, '-', ' '), ' '),
    lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS shown FROM p""")
def p16(spark, sf):
    return sample.postings(spark, sf).select("company").distinct().withColumn(
        "shown", F.coalesce(display.company_display(c("company")), F.lit("")))


_IDS = "CASE l_orderkey % 4 WHEN 0 THEN CAST(l_partkey AS STRING) WHEN 1 THEN 'deadbeef' || CAST(l_suppkey AS STRING) WHEN 2 THEN 'ABCDEF1' ELSE company END"


@query("p17_real_company", P + rf""" SELECT name, count(*) AS n FROM (SELECT {_IDS} AS name FROM p)
    WHERE name <> '' AND NOT regexp_matches(name, '^\d+$') AND NOT regexp_matches(name, '^[a-fA-F0-9]{{8,}}$') GROUP BY name""")
def p17(spark, sf):
    rows = sample.postings(spark, sf).selectExpr(f"{_IDS} AS name")
    return rows.filter(classify.is_real_company(c("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query("p18_jitter", P + """, k AS (SELECT DISTINCT url AS key FROM p WHERE url <> ''),
    h AS (SELECT key, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(unicode(x) AS BIGINT))),
          lambda a, b: ((a * 31 + b + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM k)
    SELECT key, h, round(((h & 65535) / 65535.0 - 0.5) * 0.02, 9) AS lat, round((((h >> 16) & 65535) / 65535.0 - 0.5) * 0.02, 9) AS lng FROM h""")
def p18(spark, sf):
    keys = sample.postings(spark, sf).filter("url <> ''").select(c("url").alias("key")).distinct()
    shift = display.jitter(c("key"))
    return keys.select(
        "key", display.string_hash(c("key")).alias("h"),
        F.round(shift["lat"], 9).alias("lat"), F.round(shift["lng"], 9).alias("lng"))


# ---- cleaning and the alert filter ----------------------------------------------
@query("f01_clean", P + f" SELECT {KEYS} FROM p WHERE {sql.clean_reason()} IS NULL")
def f01(spark, sf):
    return clean.clean(sample.postings(spark, sf)).select(*ORD)


@query("a13_clean_reasons", P + f" SELECT {sql.clean_reason()} AS reason, count(*) AS n FROM p WHERE {sql.clean_reason()} IS NOT NULL GROUP BY 1")
def a13(spark, sf):
    return clean.clean_report(sample.postings(spark, sf))


@query("a13_stale_count", P + f" SELECT count(*) AS stale FROM p WHERE {sql.posting_key()} IS NOT NULL AND NOT {sql.fresh('scraped_at')}")
def a13_stale(spark, sf):
    return merge.stale_count(sample.postings(spark, sf), as_of())


@query("f02_title_include", P + f" SELECT {KEYS}, title FROM p WHERE {sql.wanted('title')}")
def f02(spark, sf):
    return sample.postings(spark, sf).filter(alerts.title_wanted(c("title"))).select(*ORD, "title")


@query("f03_title_exclude", P + f" SELECT {KEYS}, title FROM p WHERE {sql.unwanted('title')}")
def f03(spark, sf):
    return sample.postings(spark, sf).filter(alerts.title_excluded(c("title"))).select(*ORD, "title")


@query("f04_location_verdict", P + f" SELECT {KEYS}, {sql.location_ok('location')} AS ok FROM p")
def f04(spark, sf):
    return sample.postings(spark, sf).select(*ORD, alerts.location_verdict(c("location")).alias("ok"))


@query("f05_alert_filter", ALERT + f" SELECT {KEYS}, job_id, title, location FROM a WHERE {sql.KEPT}")
def f05(spark, sf):
    return alerts.filter_jobs(alert_rows(spark, sf)).select(*ORD, "job_id", "title", "location")


@query("s13_alert_rows", ALERT + " SELECT *, CAST(NULL AS DATE) AS date_posted FROM a")
def s13(spark, sf):
    return alert_rows(spark, sf)


@query("g12_icims_location", P + f" SELECT {KEYS}, {sql.icims_location('location', 'company', 'remote')} AS shown FROM p WHERE ats = 'iCIMS'")
def g12(spark, sf):
    rows = sample.postings(spark, sf).filter("ats = 'iCIMS'")
    return rows.select(*ORD, alerts.icims_listed_location(c("location"), c("company"), c("remote")).alias("shown"))


@query("a15_raw_and_kept", ALERT + f" SELECT platform_source, count(*) AS raw, count(*) FILTER (WHERE {sql.KEPT}) AS kept FROM a GROUP BY 1")
def a15(spark, sf):
    return alerts.filter_report(alert_rows(spark, sf))


@query("a04_matches_by_platform", ALERT + f" SELECT platform_source, count(*) AS jobs FROM a WHERE {sql.KEPT} GROUP BY 1")
def a04(spark, sf):
    return reports.count_by_platform(alerts.filter_jobs(alert_rows(spark, sf)))


@query("w01_first_per_job_id", ALERT + f""" SELECT {KEYS}, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id
    ORDER BY {KEYS}) AS rn FROM a) WHERE rn = 1""")
def w01(spark, sf):
    return first_per_group(alert_rows(spark, sf), ["job_id"], ORD).select(*ORD, "job_id")


@query("w07_first_ten_per_platform", P + f""" SELECT ats, url, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY ats
    ORDER BY {KEYS}) AS rn FROM p WHERE url <> '') WHERE rn <= 10""")
def w07(spark, sf):
    rows = sample.postings(spark, sf).filter("url <> ''")
    return first_per_group(rows, ["ats"], ORD, n=fixed.SAMPLE_URLS).select("ats", "url", "l_orderkey", "l_linenumber")


# ---- merge ----------------------------------------------------------------------
@query("f07_fresh_rows", P + f" SELECT {KEYS} FROM p WHERE {sql.posting_key()} IS NOT NULL AND {sql.fresh('scraped_at')}")
def f07(spark, sf):
    rows = merge.with_posting_key(sample.postings(spark, sf))
    return rows.filter(merge.is_fresh(c("scraped_at"), as_of())).select(*ORD)


@query("w02_last_per_key", P + f""" SELECT {KEYS}, k FROM (SELECT {KEYS}, k, row_number() OVER (PARTITION BY k ORDER BY
    l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM (SELECT *, {sql.posting_key()} AS k FROM p)
    WHERE k IS NOT NULL) WHERE rn = 1""")
def w02(spark, sf):
    rows = merge.with_posting_key(sample.postings(spark, sf))
    return last_per_group(rows, ["posting_key"], ORD).select(*ORD, c("posting_key").alias("k"))


MERGED = P + f""", u AS (SELECT *, {sql.posting_key()} AS k, CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END AS side FROM p),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY side DESC, l_orderkey DESC, l_linenumber DESC,
    l_partkey DESC, l_suppkey DESC) AS rn FROM u WHERE k IS NOT NULL AND (side = 1 OR {sql.fresh('scraped_at')})) WHERE rn = 1)"""


def merged(spark, sf):
    existing, new = sides(spark, sf)
    return merge.merge(existing, new, as_of(), ORD)


@query("j08_merge", MERGED + f" SELECT {KEYS}, k, title, scraped_at FROM m")
def j08(spark, sf):
    return merged(spark, sf).select(*ORD, c("posting_key").alias("k"), "title", "scraped_at")


# ---- order and chunks -----------------------------------------------------------
CANONICAL = "lower(coalesce(company, '')), lower(coalesce(title, '')), coalesce(url, '')"


@query("o01_canonical_order", MERGED + f" SELECT {KEYS}, row_number() OVER (ORDER BY {CANONICAL}) - 1 AS row_number FROM m")
def o01(spark, sf):
    rows = merged(spark, sf).select(*ORD, "company", "title", "url")
    return order.with_row_numbers(rows, order.canonical_order()).select(*ORD, "row_number")


@query("o02_chunk_numbers", MERGED + f" SELECT {KEYS}, CAST(floor((row_number() OVER (ORDER BY {CANONICAL}) - 1) / 2500) AS BIGINT) AS chunk FROM m")
def o02(spark, sf):
    rows = merged(spark, sf).select(*ORD, "company", "title", "url")
    return order.with_chunks(rows, order.canonical_order(), rows=2500).select(*ORD, "chunk")


@query("k02_manifest", MERGED + f""", n AS (SELECT CAST(floor((row_number() OVER (ORDER BY {CANONICAL}) - 1) / 2500) AS BIGINT) AS chunk FROM m)
    SELECT chunk, count(*) AS jobs FROM n GROUP BY chunk""")
def k02(spark, sf):
    rows = merged(spark, sf).select("company", "title", "url")
    return order.with_chunks(rows, order.canonical_order(), rows=2500).groupBy("chunk").agg(F.count("*").alias("jobs"))


# ---- totals, companies, set operations ------------------------------------------
_FETCH = "CASE WHEN l_suppkey % 13 = 0 THEN 404 WHEN l_suppkey % 17 = 0 THEN 500 ELSE 200 END"
_JOBS = f"CASE WHEN ({_FETCH}) = 200 AND l_suppkey % 11 <> 0 THEN 1 ELSE 0 END"
FETCHES = P + f", f AS (SELECT ats, 's' || CAST(l_suppkey AS VARCHAR) AS slug, {_JOBS} AS jobs, {_FETCH} AS status_code FROM p)"


def fetches(spark, sf):
    return sample.postings(spark, sf).selectExpr(
        "ats", "'s' || l_suppkey AS slug", f"CAST({_JOBS} AS BIGINT) AS jobs", f"{_FETCH} AS status_code")


@query("a01_company_counts", FETCHES + " SELECT ats, slug, CAST(sum(jobs) AS BIGINT) AS jobs FROM f GROUP BY ats, slug HAVING sum(jobs) > 0")
def a01(spark, sf):
    return reports.company_job_counts(fetches(spark, sf))


@query("a01_fetch_report", FETCHES + """, g AS (SELECT ats, slug, sum(jobs) AS jobs, max(status_code) AS st FROM f GROUP BY 1, 2)
    SELECT ats, count(*) AS checked, count(*) FILTER (WHERE jobs > 0) AS active, count(*) FILTER (WHERE jobs = 0) AS failed,
    count(*) FILTER (WHERE jobs = 0 AND st IN (404, 410)) AS newly_dead, CAST(sum(jobs) AS BIGINT) AS jobs FROM g GROUP BY ats""")
def a01_report(spark, sf):
    return reports.fetch_report(fetches(spark, sf))


@query("a02_run_totals", """WITH c AS (SELECT DISTINCT s_suppkey AS slug FROM supplier UNION SELECT c_custkey FROM customer), """ + SLIM[5:] + """
    SELECT (SELECT count(DISTINCT slug) FROM c) AS total_companies, count(DISTINCT company) AS active_companies,
    count(*) AS total_jobs, count(*) FILTER (WHERE is_recruiter) AS recruiter_jobs FROM s""")
def a02(spark, sf):
    suppliers = sample.table(spark, sf, "supplier").select(c("s_suppkey").alias("slug"))
    companies = suppliers.union(sample.table(spark, sf, "customer").select("c_custkey")).distinct()
    return reports.run_totals(companies, sample.slim_postings(spark, sf).withColumn("company_slug", c("company")))


@query("a09_daily_trend", SLIM + f""", d AS (SELECT {sql.TODAY} - CAST(l_orderkey % 60 AS INT) AS date, lower(ats) AS ats, skill_level, is_recruiter, company FROM s),
    t AS (SELECT date, count(*) AS total_jobs, count(DISTINCT company) AS active_companies, count(*) FILTER (WHERE is_recruiter) AS recruiter_jobs FROM d GROUP BY date),
    m AS (SELECT date, 'platform' AS dim, ats AS name, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT date, 'tier', skill_level, count(*) FROM d GROUP BY ALL)
    SELECT t.date, total_jobs, active_companies, recruiter_jobs, dim, name, n FROM t JOIN m ON t.date = m.date""")
def a09(spark, sf):
    rows = sample.slim_postings(spark, sf).withColumns({
        "date": F.date_sub(F.lit(sample.AS_OF).cast("date"), (c("l_orderkey") % 60).cast("int")), "company_slug": c("company")})
    days = reports.daily_trend(rows)
    keep = ["date", "total_jobs", "active_companies", "recruiter_jobs"]
    by = lambda name, dim: days.select(*keep, F.lit(dim).alias("dim"), F.explode(name).alias("name", "n"))
    return by("by_platform", "platform").unionByName(by("by_tier", "tier"))


@query("u01_union_of_platforms", P + " SELECT ats, count(*) AS n FROM p GROUP BY ats")
def u01(spark, sf):
    rows = sample.postings(spark, sf)
    parts = [rows.filter(c("ats") == name).select("ats", "title") for name in fixed.ATS_NAMES]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union.groupBy("ats").agg(F.count("*").alias("n"))


@query("u02_company_union", "SELECT s_name AS slug FROM supplier UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier")
def u02(spark, sf):
    suppliers = sample.table(spark, sf, "supplier").select(c("s_name").alias("slug"))
    customers = sample.table(spark, sf, "customer").select(c("c_name").alias("slug"))
    return companies.company_union(suppliers, customers, suppliers)


_DEAD = "SELECT DISTINCT ats, slug FROM f WHERE status_code IN (404, 410)"


@query("u03_live_companies", FETCHES + f" SELECT DISTINCT ats, slug FROM f EXCEPT {_DEAD}")
def u03(spark, sf):
    rows = fetches(spark, sf)
    return companies.live_companies(rows, reports.newly_dead(rows))


@query("f06_skip_dead", FETCHES + f" SELECT ats, slug, count(*) AS n FROM f WHERE (ats, slug) NOT IN ({_DEAD}) GROUP BY 1, 2")
def f06(spark, sf):
    rows = fetches(spark, sf)
    return companies.skip_dead(rows, reports.newly_dead(rows)).groupBy("ats", "slug").agg(F.count("*").alias("n"))


@query("u04_dead_union", FETCHES + f" {_DEAD} UNION SELECT DISTINCT ats, slug FROM f WHERE status_code = 500")
def u04(spark, sf):
    rows = fetches(spark, sf)
    old = rows.filter("status_code = 500").select("ats", "slug")
    return companies.dead_union(old, reports.newly_dead(rows))


@query("k04_all_companies", P + " SELECT DISTINCT company FROM p WHERE company <> ''")
def k04(spark, sf):
    return sample.postings(spark, sf).filter("company <> ''").select("company").distinct().orderBy("company")


@query("k05_active_companies", FETCHES + " SELECT slug, CAST(sum(jobs) AS BIGINT) AS jobs FROM f GROUP BY slug HAVING sum(jobs) > 0")
def k05(spark, sf):
    return reports.company_job_counts(fetches(spark, sf)).groupBy("slug").agg(F.sum("jobs").alias("jobs")).orderBy("slug")

"""Queries of an alert run: seen state, page verification, text extraction."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions import dates, pages
from vacantia.functions.money import salary_text
from vacantia.operators import reports, seen, verify
from vacantia.plans import oracle_parts as sql
from vacantia.plans import sample_tables as sample
from vacantia.plans.queries_postings import AS_OF, as_of
from vacantia.plans.registry import query

KEYS, P = sql.KEYS, sql.P
ORD = sample.ORDER
c = F.col

# ---- seen state: everything before the day is state, the rest is the current run -----
DAY = "2024-01-28"
SG = f"""WITH sg AS ({sample.as_sql(sample.SIGHTINGS, 'events')}), old AS (SELECT job_id, min(day) AS first_seen, max(day) AS last_seen FROM sg
    WHERE day < DATE '{DAY}' GROUP BY job_id), cur AS (SELECT * FROM sg WHERE day >= DATE '{DAY}')"""
NEXT = f"""coalesce(old.first_seen, DATE '{DAY}') AS first_seen, CASE WHEN i.job_id IS NOT NULL THEN DATE '{DAY}' ELSE old.last_seen END AS last_seen"""
STATE = SG + f""", nxt AS (SELECT coalesce(old.job_id, i.job_id) AS job_id, {NEXT} FROM old FULL JOIN (SELECT DISTINCT job_id FROM cur) i ON i.job_id = old.job_id
    WHERE i.job_id IS NOT NULL OR old.last_seen >= DATE '{DAY}' - 10)"""


def run_inputs(spark, sf):
    rows = sample.sightings(spark, sf)
    old = rows.filter(f"day < DATE '{DAY}'").groupBy("job_id").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    return rows.filter(f"day >= DATE '{DAY}'"), old


@query("j04_new_or_seen", SG + """ SELECT event_id, cur.job_id, old.job_id IS NULL AND row_number() OVER (PARTITION BY cur.job_id ORDER BY event_id) = 1 AS is_new
    FROM cur LEFT JOIN old ON old.job_id = cur.job_id""")
def j04(spark, sf):
    jobs, old = run_inputs(spark, sf)
    return seen.mark_new(jobs, old, ["event_id"]).select("event_id", "job_id", "is_new")


@query("j07_pruned_state", STATE + " SELECT * FROM nxt")
def j07(spark, sf):
    jobs, old = run_inputs(spark, sf)
    return seen.next_state(jobs, old, DAY, days=10)


@query("j07_prune_only", SG + f" SELECT * FROM old WHERE job_id IN (SELECT job_id FROM cur) OR last_seen >= DATE '{DAY}' - 10")
def j07_prune(spark, sf):
    jobs, old = run_inputs(spark, sf)
    return seen.prune(old, jobs, DAY, days=10)


@query("j05_attach_state", STATE + " SELECT event_id, cur.job_id, nxt.first_seen, nxt.last_seen FROM cur LEFT JOIN nxt ON nxt.job_id = cur.job_id")
def j05(spark, sf):
    jobs, old = run_inputs(spark, sf)
    rows = seen.attach_state(jobs, seen.next_state(jobs, old, DAY, days=10))
    return rows.select("event_id", "job_id", "first_seen", "last_seen")


@query("t03_reset", SG + """ SELECT count(*) FILTER (WHERE is_new) AS new, count(*) FILTER (WHERE NOT is_new) AS existing FROM
    (SELECT row_number() OVER (PARTITION BY job_id ORDER BY event_id) = 1 AS is_new FROM cur)""")
def t03(spark, sf):
    jobs, _ = run_inputs(spark, sf)
    marked = seen.mark_new(jobs, seen.empty_state(spark), ["event_id"])
    return marked.agg(F.count_if("is_new").alias("new"), F.count_if(~c("is_new")).alias("existing"))


# ---- page verification ----------------------------------------------------------
PG = f"WITH pg AS ({sample.as_sql(sample.PAGES, 'pages')})"
# expected per kind of page, read off the rules: reason, salary, date, location
_N = "NULL"
EXPECTED = {
    0: ("blank_url", None, None, None), 1: ("icims_not_found", None, None, None), 2: ("http_status", None, None, None),
    3: ("moved", None, None, None), 4: ("generic_title", None, None, None), 5: (None, None, None, None),
    6: ("closed_phrase", None, None, None), 7: ("sent_home", None, None, None), 8: ("expired", None, None, None),
    9: ("no_location", None, None, None), 10: (None, "$95,000 – $130,000", None, "Remote, US"),
    11: ("wrong_location", None, None, None), 12: (None, "$90,000+", None, "Remote"),
    13: (None, "$90,000 – $120,000", "2026-06-03", "Orlando, FL"), 14: (None, None, None, None),
    15: ("workday_gone", None, None, None), 16: (None, None, "2026-06-07", "Remote - US"),
    17: (None, None, "2026-05-05", "Remote"), 18: ("embed_gone", None, None, None), 19: (None, None, None, None),
    20: (None, "$90,000 – $100,000", "2026-06-11", None), 21: (None, "$81,000", "2026-06-04", "United States"),
    22: (None, "$120,000", "2026-06-04", None), 23: (None, None, "2026-05-30", "Florida"),
    24: (None, None, None, "Tampa, FL"), 25: ("wrong_location", None, None, None),
}


def _v(x):
    return _N if x is None else sql.quoted(x)


_ROWS = ", ".join(f"({k}, {_v(r)}, {_v(s)}, {_v(d)}, {_v(loc)})" for k, (r, s, d, loc) in EXPECTED.items())
VERDICT = PG + f", e AS (SELECT * FROM (VALUES {_ROWS}) AS e(kind, reason, salary, day, place))"


def verified(spark, sf):
    return verify.verify(
        sample.page_jobs(spark, sf), sample.snapshots(spark, sf), AS_OF,
        sample.board_answers(spark, sf), sample.workday_searches(spark, sf))


@query("x01_verify", VERDICT + """ SELECT page_id, reason IS NULL AS is_live, reason AS close_reason, salary AS salary_posted, CAST(day AS DATE) AS date_posted,
    place AS location_verified FROM pg JOIN e ON e.kind = pg.kind""")
def x01(spark, sf):
    return verified(spark, sf).select(
        "page_id", "is_live", "close_reason", "salary_posted", "date_posted", "location_verified")


@query("f08_live_only", VERDICT + " SELECT page_id FROM pg JOIN e ON e.kind = pg.kind WHERE reason IS NULL")
def f08(spark, sf):
    return verify.live_only(verified(spark, sf)).select("page_id")


@query("a05_verification_counts", VERDICT + """ SELECT count(*) FILTER (WHERE reason IS NULL) AS live, count(*) FILTER (WHERE reason IS NOT NULL) AS closed,
    count(*) FILTER (WHERE reason IS NULL AND salary IS NOT NULL) AS with_salary FROM pg JOIN e ON e.kind = pg.kind""")
def a05(spark, sf):
    return reports.verification_counts(verified(spark, sf))


# jobs and pages on the much larger tables: a page per order number
_BODY = "(CASE o_orderkey % 5 WHEN 0 THEN 'posting has expired' WHEN 1 THEN 'Salary $120,000' ELSE 'open ' || o_orderpriority END)"


# a landed page per order for every form of url that the postings have
_LANDED_URLS = [
    "'https://jobs.example.com/p/' || CAST(o_orderkey % 5000 AS STRING)",
    "'https://careers-supplier.icims.com/jobs/' || CAST(o_orderkey % 5000 AS STRING) || '/job'",
    "'https://supplier-' || CAST(4 + 6 * (o_orderkey % 4) AS STRING) || '.wd1.myworkdayjobs.com/careers/jobs/' || CAST(o_orderkey % 5000 AS STRING) || '-x' || CAST(o_orderkey % 7 + 1 AS STRING)",
]


@query("j09_page_join", P + ", o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM (" + " UNION ALL ".join(
    f"SELECT {url.replace('AS STRING', 'AS VARCHAR')} AS url, o_orderkey, o_orderdate FROM orders" for url in _LANDED_URLS) + """)) WHERE rn = 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o.o_orderkey IS NULL OR (o.o_orderkey % 5 <> 0 AND ats <> 'iCIMS') AS is_live,
    CASE WHEN o.o_orderkey % 5 = 0 THEN 'closed_phrase' WHEN o.o_orderkey IS NOT NULL AND ats = 'iCIMS' THEN 'no_location' END AS close_reason,
    CASE WHEN o.o_orderkey % 5 = 1 AND ats <> 'iCIMS' THEN '$120,000' END AS salary_posted FROM p LEFT JOIN o ON o.url = p.url WHERE p.url <> ''""")
def j09(spark, sf):
    """Jobs of all platforms against the page last landed at their url."""
    snapshots = sample.table(spark, sf, "orders").selectExpr(
        f"explode(array({', '.join(_LANDED_URLS)})) AS url", "CAST(NULL AS STRING) AS final_url",
        "200 AS http_status", "'Boss' AS title", "'' AS html", f"{_BODY} AS body_text", "CAST(NULL AS STRING) AS fetch_error",
        "o_orderdate AS fetched_at", "o_orderkey")
    jobs = sample.postings(spark, sf).filter("url <> ''").selectExpr(
        *ORD, "url AS application_url", "ats AS platform_source", "CAST(NULL AS DATE) AS date_posted")
    landed = verify.latest_snapshots(snapshots, ["fetched_at", "o_orderkey"]).drop("o_orderkey")
    return verify.verify(jobs, landed, AS_OF).select(*ORD, "is_live", "close_reason", "salary_posted")


@query("j10_embed_verdicts", PG + """ SELECT url, kind = 17 AS is_live, CASE kind WHEN 17 THEN 'Remote' END AS location FROM pg WHERE kind IN (17, 18)""")
def j10(spark, sf):
    landed = verify.latest_snapshots(sample.snapshots(spark, sf))
    rows = verify.embed_verdicts(landed, sample.board_answers(spark, sf))
    return rows.select("url", "embed.is_live", "embed.location")


@query("j11_workday_answers", PG + """ SELECT page_id, kind = 16 AS is_live, CASE kind WHEN 16 THEN DATE '2026-06-07' END AS day, CASE kind WHEN 16 THEN 'Remote - US' END AS location
    FROM pg WHERE kind IN (15, 16)""")
def j11(spark, sf):
    rows = verify.with_workday_answer(sample.page_jobs(spark, sf), sample.workday_searches(spark, sf), as_of())
    return rows.filter("workday IS NOT NULL").select(
        "page_id", "workday.is_live", c("workday.date").cast("date").alias("day"), "workday.location")


_WD = "(CASE l_partkey % 4 WHEN 0 THEN 'https://acme.wd5.myworkdayjobs.com/ext/job/Miami-FL/Boss-Man_R-' || CAST(l_orderkey AS STRING) || '?src=x' WHEN 1 THEN 'HTTPS://Acme.wd12.myworkdayjobs.com/en/job/a/b/c_' || CAST(l_orderkey AS STRING) ELSE url END)"


@query("j11_workday_url", P + f""", w AS (SELECT {KEYS}, {_WD} AS u FROM p) SELECT {KEYS}, CASE l_partkey % 4 WHEN 0 THEN 'acme.wd5.myworkdayjobs.com' ELSE 'Acme.wd12.myworkdayjobs.com' END AS host,
    CASE l_partkey % 4 WHEN 0 THEN 'ext' ELSE 'en' END AS tenant, CASE l_partkey % 4 WHEN 0 THEN 'R-' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS posting FROM w WHERE l_partkey % 4 < 2""")
def j11_url(spark, sf):
    rows = sample.postings(spark, sf).withColumn("w", verify.workday_parts(F.expr(_WD)))
    return rows.filter("w IS NOT NULL").select(*ORD, "w.host", "w.tenant", "w.posting")


@query("f18_location_excluded", P + f""", f AS (SELECT {KEYS}, CASE l_partkey % 9 WHEN 0 THEN 'Remote, CA' WHEN 1 THEN 'Austin, TX' WHEN 2 THEN 'Jacksonville, FL' WHEN 3 THEN 'Leeds'
    WHEN 4 THEN 'United States' WHEN 5 THEN NULL WHEN 6 THEN 'Boston, massachusetts' WHEN 7 THEN 'Reston, VA or FL' ELSE location END AS place FROM p)
    SELECT {KEYS}, CASE WHEN coalesce(place, '') = '' OR regexp_matches(place, '\\b(remote|work from home|wfh|anywhere|virtual)\\b', 'i') THEN false
    WHEN {sql.bounded('place', fixed.FOREIGN_PAGE_WORDS)} THEN true
    ELSE regexp_matches(place, ',\\s*({"|".join(fixed.STATE_CODES_NOT_FL + fixed.STATE_NAMES_NOT_FL)})\\b', 'i') AND NOT regexp_matches(place, '\\b(fl|florida|jacksonville)\\b', 'i') END AS excluded FROM f""")
def f18(spark, sf):
    place = F.expr("""CASE l_partkey % 9 WHEN 0 THEN 'Remote, CA' WHEN 1 THEN 'Austin, TX' WHEN 2 THEN 'Jacksonville, FL' WHEN 3 THEN 'Leeds'
        WHEN 4 THEN 'United States' WHEN 5 THEN NULL WHEN 6 THEN 'Boston, massachusetts' WHEN 7 THEN 'Reston, VA or FL' ELSE location END""")
    rows = sample.postings(spark, sf).select(*ORD, place.alias("place"))
    return rows.select(*ORD, pages.location_excluded(c("place")).alias("excluded"))


# ---- single page rules ----------------------------------------------------------
@query("x02_closed_phrases", f"SELECT doc_id FROM documents WHERE {sql.any_of('lower(text)', ['of the'] + fixed.CLOSED_PHRASES)}")
def x02(spark, sf):
    rows = sample.table(spark, sf, "documents")
    return rows.filter(pages.mentions_closed(c("text"), ["of the"] + fixed.CLOSED_PHRASES)).select("doc_id")


@query("x02_older_phrases", PG + f" SELECT page_id FROM pg WHERE {sql.any_of('lower(body_text)', fixed.CLOSED_PHRASES_OLDER)}")
def x02_older(spark, sf):
    rows = sample.page_rows(spark, sf)
    return rows.filter(pages.mentions_closed(c("body_text"), fixed.CLOSED_PHRASES_OLDER)).select("page_id")


@query("x03_generic_titles", PG + f" SELECT page_id, lower(trim(title)) IN {sql.in_list(fixed.GENERIC_TITLES)} AS generic, {sql.any_of('lower(url)', fixed.LATE_TITLE_HOSTS)} AS late FROM pg")
def x03(spark, sf):
    return sample.page_rows(spark, sf).select(
        "page_id", pages.is_generic_title(c("title")).alias("generic"), pages.sets_title_late(c("url")).alias("late"))


@query("x04_redirect_depth", PG + """, d AS (SELECT page_id, url, coalesce(final_url, url) AS f, len(list_filter(string_split(url, '/'), lambda x: x <> '' AND NOT contains(x, 'http'))) AS a,
    len(list_filter(string_split(coalesce(final_url, url), '/'), lambda x: x <> '' AND NOT contains(x, 'http'))) AS b FROM pg)
    SELECT page_id, CAST(a AS BIGINT) AS depth, url <> f AND a - b >= 2 AND b <= 2 AS home FROM d""")
def x04(spark, sf):
    rows = sample.page_rows(spark, sf).withColumn("final_url", F.coalesce("final_url", "url"))
    return rows.select(
        "page_id", pages.url_depth(c("url")).cast("bigint").alias("depth"),
        pages.fell_back_to_home(c("url"), c("final_url")).alias("home"))


@query("x05_x06_json_ld", PG + """ SELECT page_id, kind = 8 AS expired, CASE kind WHEN 11 THEN '2026-06-01' WHEN 13 THEN NULL WHEN 23 THEN '2026-05-30' END AS day,
    CASE kind WHEN 11 THEN 'Austin, TX' WHEN 12 THEN 'Remote' WHEN 13 THEN 'Orlando, FL' WHEN 21 THEN 'United States' WHEN 23 THEN 'Florida' WHEN 25 THEN 'Berlin, DE' END AS place,
    CASE kind WHEN 12 THEN '$90,000+' WHEN 13 THEN '$90,000 – $120,000' WHEN 21 THEN '$81,000' END AS pay FROM pg WHERE kind IN (8, 11, 12, 13, 21, 23, 25)""".replace("WHEN 13 THEN NULL", "WHEN 13 THEN '2026-06-03'"))
def x05(spark, sf):
    rows = sample.page_rows(spark, sf).select("page_id", pages.json_ld(c("html")).alias("ld")).filter("ld IS NOT NULL")
    return rows.select(
        "page_id", pages.json_ld_expired(c("ld"), as_of()).alias("expired"), pages.json_ld_date(c("ld")).alias("day"),
        pages.json_ld_location(c("ld")).alias("place"), pages.json_ld_salary(c("ld")).alias("pay"))


_A = "CAST(FLOOR(l_extendedprice) AS BIGINT)"


def _comma(n):
    return f"(CASE WHEN {n} < 1000 THEN CAST({n} AS STRING) ELSE CAST(CAST(FLOOR({n} / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST({n} % 1000 AS STRING), 3, '0') END)"


_B = f"({_A} + 7000)"
_PAY = (f"(CASE l_partkey % 9 WHEN 0 THEN 'Base. Salary range: $' || CAST(l_orderkey % 400 AS STRING) || 'k - $' || CAST(l_orderkey % 300 AS STRING) || 'k' "
        f"WHEN 1 THEN 'Pay $' || {_comma(_B)} || ' - $' || {_comma(_A)} || ' per year' WHEN 2 THEN 'Compensation $' || {_comma(_A)} "
        f"WHEN 3 THEN 'Wage $30 - $40 an hour' WHEN 4 THEN 'Salary $5,000' WHEN 5 THEN 'Raised $50,000,000' WHEN 6 THEN 'we pay $' || {_comma(_A)} || ' / yr or $' || {_comma(_A)} || '/yr' "
        f"WHEN 7 THEN 'Pay range: $5,000 then $' || {_comma(_A)} ELSE repeat('filler words ', 40) || 'starting salary' || repeat(' x', 250) || ' $99,000' END)")


def _money(n):
    return f"'$' || format('{{:,}}', {n})"


def _yearly(n):
    return f"(CASE WHEN {n} < 1000 THEN {n} * 1000 ELSE {n} END)"


def _between(lo, hi):
    lo, hi = _yearly(lo), _yearly(hi)
    return f"CASE WHEN {lo} >= 25000 AND {lo} <= 2000000 AND greatest({lo}, {hi}) <= 2000000 THEN {_money(f'least({lo}, {hi})')} || ' – ' || {_money(f'greatest({lo}, {hi})')} END"


_K1, _K2 = "(l_orderkey % 400) * 1000", "(l_orderkey % 300) * 1000"
_ONE = f"CASE WHEN {_yearly(_A)} >= 25000 THEN {_money(_yearly(_A))} END"
PAY_EXPECTED = (
    f"(CASE l_partkey % 9 WHEN 0 THEN {_between(_K1, _K2)} WHEN 1 THEN coalesce({_between(_B, _A)}, {_ONE}) WHEN 2 THEN {_ONE} WHEN 3 THEN '$30,000 – $40,000' "
    f"WHEN 6 THEN {_ONE} WHEN 7 THEN {_ONE} END)")


@query("x07_salary_text", f"SELECT {KEYS}, {PAY_EXPECTED} AS pay FROM lineitem")
def x07(spark, sf):
    rows = sample.table(spark, sf, "lineitem")
    return rows.selectExpr(*ORD, f"{_PAY} AS text").select(*ORD, salary_text(c("text")).alias("pay"))


_OLD_PAY = f"(CASE l_partkey % 4 WHEN 0 THEN 'Hourly rate $' || {_comma(_A)} WHEN 1 THEN 'starting pay $' || {_comma(_A)} WHEN 2 THEN 'wage: $' || {_comma(_A)} || ' - $' || {_comma(_B)} ELSE '$90,000 a year' END)"


@query("x08_salary_labels_only", f"""SELECT {KEYS}, CASE l_partkey % 4 WHEN 0 THEN {_ONE} WHEN 2 THEN {_between(_A, _B)} END AS pay FROM lineitem""")
def x08(spark, sf):
    rows = sample.table(spark, sf, "lineitem")
    pay = salary_text(c("text"), passes=("label",), labels=fixed.SALARY_LABELS_OLDER)
    return rows.selectExpr(*ORD, f"{_OLD_PAY} AS text").select(*ORD, pay.alias("pay"))


_D = "DATE '2026-06-14' - CAST(l_orderkey % 500 AS INT)"
_DATE_TEXT = (f"(CASE l_partkey % 7 WHEN 0 THEN 'Posted ' || CAST(l_orderkey % 500 AS STRING) || ' days ago' WHEN 1 THEN 'posted on June 4, 2026' WHEN 2 THEN 'Posted: 6/4/2026' "
              f"WHEN 3 THEN 'date posted - ' || CAST({_D} AS STRING) WHEN 4 THEN 'POSTED Sep 09 2025 and more' WHEN 5 THEN 'posted Sept. 9, 2025' ELSE 'nothing here' END)")
_DATE_WANT = f"(CASE l_partkey % 7 WHEN 0 THEN CASE WHEN l_orderkey % 500 <= 365 THEN CAST({_D} AS VARCHAR) END WHEN 1 THEN '2026-06-04' WHEN 2 THEN '2026-06-04' WHEN 3 THEN CAST({_D} AS VARCHAR) WHEN 4 THEN '2025-09-09' END)"


@query("x09_date_text", f"SELECT {KEYS}, {_DATE_WANT} AS day FROM lineitem")
def x09(spark, sf):
    rows = sample.table(spark, sf, "lineitem").selectExpr(*ORD, f"{_DATE_TEXT} AS text")
    return rows.select(*ORD, dates.date_in_text(c("text"), as_of()).alias("day"))


_HTML = (f"(CASE l_linenumber % 4 WHEN 0 THEN '{{\"postedOn\" : \"06/0' || CAST(l_suppkey % 9 + 1 AS STRING) || '/2026\"}} <time datetime=\"2025-01-01T\">' "
         f"WHEN 1 THEN '<time class=\"x\" datetime=\"' || CAST({_D} AS STRING) || 'T10:00\">' WHEN 2 THEN '\"postedOn\":\"Posted Today\" ' || {_DATE_TEXT} ELSE {_DATE_TEXT} END)")


@query("x10_date_html", f"SELECT {KEYS}, CASE l_linenumber % 4 WHEN 0 THEN '2026-06-0' || CAST(l_suppkey % 9 + 1 AS VARCHAR) WHEN 1 THEN CAST({_D} AS VARCHAR) ELSE {_DATE_WANT} END AS day FROM lineitem")
def x10(spark, sf):
    rows = sample.table(spark, sf, "lineitem").selectExpr(*ORD, f"{_HTML} AS html")
    return rows.select(*ORD, dates.date_in_html(c("html"), as_of()).alias("day"))


_RAW_DATE = ("(CASE l_partkey % 10 WHEN 0 THEN '2026-06-04' WHEN 1 THEN '13/45/2026' WHEN 2 THEN 'June 4, 2026' WHEN 3 THEN 'jun 4 2026.' WHEN 4 THEN '4 June 2026' "
             "WHEN 5 THEN '4 Jun 2026' WHEN 6 THEN 'June 4,2026' WHEN 7 THEN 'Juno 4, 2026' WHEN 8 THEN '' ELSE 'Feb 30, 2026' END)")


@query("x11_iso_date", f"SELECT {KEYS}, CASE WHEN l_partkey % 10 IN (0, 2, 3, 4, 5, 6) THEN '2026-06-04' WHEN l_partkey % 10 = 1 THEN '2026-13-45' END AS day FROM lineitem")
def x11(spark, sf):
    rows = sample.table(spark, sf, "lineitem").selectExpr(*ORD, f"{_RAW_DATE} AS raw")
    return rows.select(*ORD, dates.iso_date(c("raw")).alias("day"))


_ICIMS = {
    "title": "(CASE l_partkey % 8 WHEN 0 THEN 'IT Boss - Remote - Acme' WHEN 1 THEN 'Boss – Fort Myers, FL | Acme' WHEN 2 THEN 'Boss - USA' ELSE 'Boss' END)",
    "body": "(CASE l_partkey % 8 WHEN 3 THEN 'Job Location:\nChantilly, VA, US\nmore' WHEN 4 THEN 'Location: apply filter\nWorks in Tampa, FL today' WHEN 5 THEN 'x' WHEN 6 THEN 'A job, Nationwide' ELSE 'none' END)",
    "html": "(CASE l_partkey % 8 WHEN 5 THEN '<div class=\"a jobLocation b\"> <b>Miami</b> FL </div>' ELSE '<p>' END)",
}


@query("x12_icims_location", f"SELECT {KEYS}, CASE l_partkey % 8 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Fort Myers, FL' WHEN 2 THEN 'USA' WHEN 3 THEN 'Chantilly, VA, US' WHEN 4 THEN 'Tampa, FL' WHEN 5 THEN 'Miami FL' WHEN 6 THEN 'Nationwide' END AS place FROM lineitem")
def x12(spark, sf):
    rows = sample.table(spark, sf, "lineitem").selectExpr(*ORD, *[f"{v} AS {k}" for k, v in _ICIMS.items()])
    return rows.select(*ORD, pages.icims_location(c("title"), c("body"), c("html")).alias("place"))


_CODES = ("(CASE l_partkey % 8 WHEN 0 THEN 'at US-FL-Miami' WHEN 1 THEN 'US-TN-Memphis US-FL-x' WHEN 2 THEN 'LB-Beirut' WHEN 3 THEN 'zz-Top then de-by-Munich' WHEN 4 THEN 'US-wide LB-Beirut' "
          "WHEN 5 THEN 'Remote: Yes' WHEN 6 THEN 'remote</p> yes' ELSE 'Work From Home' END)")


@query("x13_icims_code", f"SELECT {KEYS}, CASE l_partkey % 8 WHEN 0 THEN 'Florida' WHEN 1 THEN 'US-ONSITE' WHEN 2 THEN 'INTL:LB' WHEN 3 THEN 'INTL:DE' WHEN 5 THEN 'Remote' WHEN 7 THEN 'Remote' END AS code FROM lineitem")
def x13(spark, sf):
    rows = sample.table(spark, sf, "lineitem").selectExpr(*ORD, f"{_CODES} AS html")
    return rows.select(*ORD, pages.icims_code(c("html")).alias("code"))


@query("x14_icims_rule", VERDICT + " SELECT page_id, reason AS close_reason, place AS location_verified FROM pg JOIN e ON e.kind = pg.kind WHERE platform_source = 'iCIMS'")
def x14(spark, sf):
    return verified(spark, sf).filter("platform_source = 'iCIMS'").select("page_id", "close_reason", "location_verified")


@query("x15_fallbacks", VERDICT + " SELECT page_id, salary AS salary_posted, CAST(day AS DATE) AS date_posted FROM pg JOIN e ON e.kind = pg.kind WHERE reason IS NULL")
def x15(spark, sf):
    return verify.live_only(verified(spark, sf)).select("page_id", "salary_posted", "date_posted")

"""Queries that write files with the sinks, or run a stream, and read the result back."""

import math
import uuid

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.operators import alerts, facets, reports, seen
from vacantia.plans import jobs
from vacantia.plans import oracle_parts as sql
from vacantia.plans import sample_tables as sample
from vacantia.plans.queries_places import EXPECTED_SQL, TABLES, salary_tables
from vacantia.plans.queries_postings import AS_OF, FETCHES, MERGED, fetches, merged
from vacantia.plans.queries_runs import DAY, STATE, run_inputs
from vacantia.plans.queries_sources import _ICIMS_TITLE, _PAGES
from vacantia.plans.queries_views import ST
from vacantia.plans.registry import ORACLES, query
from vacantia.session import checkpoint_dir
from vacantia.sinks import files as sinks
from vacantia.sources import files as sources
from vacantia.streaming import buckets, cycles, keyed, tables

KEYS, P, SLIM = sql.KEYS, sql.P, sql.SLIM
ORD = sample.ORDER
c = F.col


def folder(spark, name):
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a landed file, about.
FILE_ROWS = 500_000


def land(parts, path, files=4):
    """Write the parts one after another, the same number of files each, as landing folder.

    There are more than ``files`` where the largest part would have over FILE_ROWS rows a file and
    the smallest still has rows for each, as an empty partition leaves no file.
    """
    counts = [part.count() for part in parts]
    more = math.ceil(max(counts) / FILE_ROWS)
    if min(counts) >= 1000 * more:
        files = max(files, more)
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)
    return files


# ---- chunks and manifest --------------------------------------------------------
def chunk_folder(spark, sf):
    path = folder(spark, "chunks")
    rows = merged(spark, sf).withColumns({
        "skill_level": F.lit("mid"), "is_recruiter": F.lit(False),
        "coords": F.when(c("lat").isNotNull(), F.struct("lat", "lng")), "salary": F.lit(None).cast("struct<p25:bigint,median:bigint,p75:bigint,n:bigint>")})
    sinks.write_chunks(rows, path, AS_OF, rows=2500)
    return path


@query("k01_s01_chunk_files", MERGED + " SELECT title, company, location, url, ats, \"workplaceType\", scraped_at, remote, lat FROM m")
def k01(spark, sf):
    rows = sources.read_chunks(spark, chunk_folder(spark, sf))
    return rows.select("title", "company", "location", "url", "ats", "workplaceType", "scraped_at", "remote", "coords.lat")


@query("s02_manifest", MERGED + " SELECT CAST(ceil(count(*) / 2500.0) AS BIGINT) AS chunks, count(*) AS announced, count(*) AS found FROM m")
def s02(spark, sf):
    path = chunk_folder(spark, sf)
    check = sources.manifest_check(sources.read_manifest(spark, path), sources.read_chunks(spark, path))
    names = sources.read_chunk_names(spark, path).agg(F.count("*").alias("chunks"))
    both = names.unionByName(check, allowMissingColumns=True)
    return both.agg(*[F.max(n).alias(n) for n in ("chunks", "announced", "found")])


@query("k03_metadata", "WITH c AS (SELECT DISTINCT s_suppkey AS slug FROM supplier), " + SLIM[5:] + f"""
    SELECT (SELECT count(*) FROM c) AS total_companies, count(DISTINCT company) AS active_companies, count(*) AS total_jobs,
    count(*) FILTER (WHERE is_recruiter) AS recruiter_jobs, '{AS_OF}' AS last_updated, 'automated' AS source_type, {sql.quoted(fixed.SOURCE_LABELS)} AS platforms FROM s""")
def k03(spark, sf):
    companies = sample.table(spark, sf, "supplier").select(c("s_suppkey").alias("slug"))
    totals = reports.run_totals(companies, sample.slim_postings(spark, sf).withColumn("company_slug", c("company")))
    return sinks.metadata(totals, AS_OF)


@query("k03_merged_total", MERGED + """, t AS (SELECT count(*) AS n FROM m)
    SELECT (SELECT n FROM t) AS total_jobs, count(DISTINCT company) AS active_companies FROM p""")
def k03_merged(spark, sf):
    companies = sample.table(spark, sf, "supplier").select(c("s_suppkey").alias("slug"))
    rows = sample.postings(spark, sf).withColumns({"company_slug": c("company"), "is_recruiter": F.lit(False)})
    meta = sinks.metadata(reports.run_totals(companies, rows), AS_OF)
    return sinks.with_merged_total(meta, merged(spark, sf)).select("total_jobs", "active_companies")


@query("k06_all_jobs", P + f" SELECT {KEYS}, ats, title FROM p")
def k06(spark, sf):
    path = folder(spark, "all_jobs")
    sinks.write_all_jobs(sample.postings(spark, sf), path)
    return spark.read.parquet(path).select(*ORD, "ats", "title")


@query("k09_s19_seen_state", STATE + " SELECT * FROM nxt")
def k09(spark, sf):
    path = folder(spark, "seen")
    current, old = run_inputs(spark, sf)
    sinks.write_seen(seen.next_state(current, old, DAY, days=10), tables.version_path(path, 3))
    return tables.read_latest(spark, path, "job_id string, first_seen date, last_seen date")


@query("k10_s20_dead_slugs", FETCHES + " SELECT DISTINCT ats AS platform, slug FROM f WHERE status_code IN (404, 410) OR status_code = 500")
def k10(spark, sf):
    path = folder(spark, "dead")
    rows = fetches(spark, sf)
    old = rows.filter("status_code = 500").select(c("ats").alias("platform"), "slug")
    sinks.write_dead_slugs(old, reports.newly_dead(rows).select(c("ats").alias("platform"), "slug"), path)
    platforms = [sources.read_dead_slugs(spark, path, name) for name in fixed.ATS_NAMES]
    out = platforms[0]
    for rows in platforms[1:]:
        out = out.union(rows)
    return out


@query("k11_s17_salary_shards", TABLES + " SELECT key, p25, median, p75, n FROM own")
def k11_files(spark, sf):
    path = folder(spark, "shards")
    sinks.write_salary_shards(salary_tables(spark, sf)[0], path)
    return sources.read_salary_shards(spark, path).select("key", "salary.*")


@query("k04_s14_company_file", P + " SELECT DISTINCT 'Lever' AS ats, company AS slug FROM p WHERE company <> ''")
def k04_files(spark, sf):
    path = folder(spark, "companies")
    sinks.write_companies(sample.postings(spark, sf).filter("company <> ''").select(c("company").alias("slug")), path)
    return sources.read_companies(spark, path, "Lever")


@query("k05_active_file", FETCHES + " SELECT slug, CAST(sum(jobs) AS BIGINT) AS jobs FROM f GROUP BY slug HAVING sum(jobs) > 0")
def k05_files(spark, sf):
    path = folder(spark, "active")
    sinks.write_active_companies(reports.company_job_counts(fetches(spark, sf)), path)
    return sources.read_active_companies(spark, path)


@query("s16_gazetteer_file", "SELECT CAST(s_suppkey AS VARCHAR) || ' town' AS city, 'A' || CAST(s_nationkey AS VARCHAR) AS admin, 'US' AS country, CAST(s_acctbal AS DOUBLE) AS lat FROM supplier")
def s16(spark, sf):
    path = folder(spark, "gazetteer")
    rows = sample.table(spark, sf, "supplier").selectExpr(
        "array('lat', 'city', 'admin', 'country', 'lng') AS schema",
        "array(CAST(CAST(s_acctbal AS DOUBLE) AS STRING), s_suppkey || ' town', 'A' || s_nationkey, 'US', '1.5') AS row")
    rows.groupBy("schema").agg(F.collect_list("row").alias("data")).coalesce(1).write.json(path)
    return sources.read_gazetteer(spark, path).select("city", "admin", "country", "lat")


@query("s18_trend_file", "SELECT CAST(ts AS DATE) AS date, count(*) AS total_jobs, count(DISTINCT user_id) AS active_companies FROM events GROUP BY 1")
def s18(spark, sf):
    path = folder(spark, "daily")
    days = sample.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(
        F.count("*").alias("total_jobs"), F.count_distinct("user_id").alias("active_companies"))
    record = F.to_json(F.struct("date", "total_jobs", "active_companies"), {"pretty": "true"})
    days.select(record.alias("value")).coalesce(1).write.text(path)
    return sources.read_trends(spark, path).select("date", "total_jobs", "active_companies")


@query("s21_status_file", "WITH " + ST + """, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn FROM st)
    SELECT key, status FROM l WHERE rn = 1 AND status IS NOT NULL""")
def s21(spark, sf):
    path = folder(spark, "marks")
    now = facets.current_status(sample.status_events(spark, sf))
    entry = F.to_json(F.create_map(c("key"), F.struct("status", c("ts").cast("string").alias("date"))))
    now.select(entry.alias("value")).write.text(path)
    lines = spark.read.text(path)  # one document a line: each becomes a file of its own reading
    return sources.parse_statuses(lines).select("key", "status")


@query("k12_trend_days", P + f""" SELECT {sql.TODAY} - CAST(l_orderkey % 60 AS INT) AS date, count(*) AS total_jobs, count(DISTINCT company) AS active_companies FROM p GROUP BY 1""")
def k12(spark, sf):
    path = folder(spark, "trend")
    rows = sample.postings(spark, sf).withColumns({
        "date": F.date_sub(F.lit(sample.AS_OF).cast("date"), (c("l_orderkey") % 60).cast("int")),
        "company_slug": c("company"), "skill_level": F.lit("mid"), "is_recruiter": F.lit(False)})
    days = reports.daily_trend(rows)
    sinks.append_trend(days, path)
    # writing the even days again replaces them
    sinks.append_trend(days.filter("dayofmonth(date) % 2 = 0"), path)
    return spark.read.parquet(path).select("date", "total_jobs", "active_companies")


@query("k07_s23_jobs_db", P + " SELECT title, company, location, ats AS platform_source FROM p WHERE company <> '' AND title IS NOT NULL")
def k07_files(spark, sf):
    path = folder(spark, "jobs_db")
    rows = sample.postings(spark, sf).filter("company <> '' AND title IS NOT NULL").select(
        "title", "company", "location", c("ats").alias("platform_source"), F.lit(None).cast("date").alias("first_seen"), c("url").alias("job_id"))
    sinks.write_jobs_db(rows, path, AS_OF)
    return sources.read_jobs_db(spark, path).select("title", "company", "location", "platform_source")


# ---- whole jobs -----------------------------------------------------------------
_LANDED = _PAGES.replace("WITH r", ", r", 1) + f""", nr AS (
    SELECT ats, title, location AS place, url, 's' AS company FROM r WHERE ats IN ('Greenhouse', 'Lever') AND status_code = 200 UNION ALL
    SELECT ats, coalesce(title, ''), NULL, 'x', 's' FROM r WHERE ats = 'Ashby' AND status_code = 200 UNION ALL
    SELECT ats, title, CASE WHEN city = 'Miami' THEN 'Miami, FL' END, 'x', 's' FROM r WHERE ats = 'BambooHR' AND status_code = 200 AND contains(content_type, 'application/json') UNION ALL
    SELECT ats, title, location, 'x', 's' FROM good UNION ALL SELECT ats, {_ICIMS_TITLE}, NULL, 'x', 's' FROM r WHERE ats = 'iCIMS' AND status_code = 200)
    SELECT ats, skill_level, count(*) AS jobs, count(hit) AS with_coords, count(tit.median) AS with_salary
    FROM (SELECT *, {sql.tier('title')} AS skill_level FROM nr WHERE {sql.clean_reason('nr')} IS NULL) n
    LEFT JOIN {EXPECTED_SQL} ON e.location = n.place LEFT JOIN tit ON tit.key = lower(trim(n.title)) || '|' || n.skill_level GROUP BY 1, 2"""


@query("e1_aggregate", TABLES + _LANDED)
def e1(spark, sf):
    own, title = salary_tables(spark, sf)
    rows = jobs.aggregate(sample.raw_payloads(spark, sf), sample.gazetteer(spark), own, title, AS_OF)
    return rows.groupBy("ats", "skill_level").agg(
        F.count("*").alias("jobs"), F.count("coords").alias("with_coords"), F.count("salary").alias("with_salary"))


@query("e4_explore_page", SLIM + f""" SELECT {KEYS}, company FROM s WHERE NOT is_recruiter AND url <> '' AND company <> '' AND skill_level = 'senior'
    ORDER BY lower(company) DESC, url, {KEYS} LIMIT 50 OFFSET 50""")
def e4(spark, sf):
    rows = sample.slim_postings(spark, sf).filter("url <> '' AND company <> ''").select(*ORD, "company", "url", "skill_level", "is_recruiter", "title", "location")
    return jobs.explore(
        rows, sort="company", ascending=False, page_number=2, page_size=50, ties=["url", *ORD], skill_level="senior").select(*ORD, "company")


@query("e2_file_chain", sql.ALERT.replace("FROM s WHERE", "FROM m2 WHERE").replace(", a AS (", f""", n2 AS (
        SELECT *, l_linenumber > 4 AS side FROM s), u2 AS (SELECT *, {sql.posting_key("n2")} AS k FROM n2),
        m2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY side DESC, coalesce(scraped_at, '') DESC, coalesce(title, '') DESC, url DESC, location DESC) AS rn
        FROM u2 WHERE k IS NOT NULL AND (side OR {sql.fresh('scraped_at')})) WHERE rn = 1), a AS (""", 1) + f"""
    SELECT platform_source, count(*) AS kept, count(DISTINCT application_url) AS urls FROM a WHERE {sql.KEPT} GROUP BY 1""")
def e2(spark, sf):
    """Published chunks are read, merged with a scrape, written again, read and filtered."""
    rows = sample.slim_postings(spark, sf).withColumn("salary", F.lit(None).cast("struct<p25:bigint,median:bigint,p75:bigint,n:bigint>"))
    first, second = folder(spark, "published"), folder(spark, "published")
    sinks.write_chunks(rows.filter("l_linenumber <= 4"), first, AS_OF, rows=2500)
    merged_rows = jobs.merge_scrape(sources.read_chunks(spark, first), rows.filter("l_linenumber > 4"), F.lit(AS_OF).cast("timestamp"))
    sinks.write_chunks(merged_rows, second, AS_OF, rows=2500)
    kept = alerts.filter_jobs(alerts.to_alert_jobs(sources.read_chunks(spark, second)))
    return kept.groupBy("platform_source").agg(F.count("*").alias("kept"), F.count_distinct("application_url").alias("urls"))


@query("t01_t07_alert_cycle", sql.ALERT + f""", k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {KEYS}) AS rn FROM a WHERE {sql.KEPT})
    SELECT platform_source, count(*) AS open_jobs, count(*) FILTER (WHERE rn = 1) AS new_jobs FROM k GROUP BY 1""")
def t01(spark, sf):
    cycle = jobs.alert_cycle(
        sample.slim_postings(spark, sf), sample.snapshots(spark, sf), seen.empty_state(spark), AS_OF, row_id=ORD, keep=ORD)
    new = cycle.new_jobs.groupBy("platform_source").agg(F.count("*").alias("new_jobs"))
    return cycle.open_jobs.groupBy("platform_source").agg(F.count("*").alias("open_jobs")).join(new, "platform_source")


@query("t01_alert_stream", sql.ALERT + f""", k AS (SELECT *, l_linenumber % 3 AS batch, row_number() OVER (PARTITION BY job_id ORDER BY l_linenumber % 3, {KEYS}) AS rn FROM a WHERE {sql.KEPT})
    SELECT batch, count(*) AS open_jobs, count(*) FILTER (WHERE rn = 1) AS new_jobs FROM k GROUP BY 1""")
def t01_stream(spark, sf):
    rows = sample.slim_postings(spark, sf)
    landing, out = folder(spark, "postings"), folder(spark, "alerts")
    per_batch = land([rows.filter(c("l_linenumber") % 3 == b) for b in range(3)], landing)
    cycles.alert_stream(
        cycles.files(spark, landing, rows.schema, per_batch), sample.snapshots(spark, sf), out, folder(spark, "progress"),
        lambda epoch: AS_OF, row_id=ORD, keep=ORD).awaitTermination()
    def per(kind, name):
        return spark.read.parquet(f"{out}/{kind}").groupBy(c("version").alias("batch")).agg(F.count("*").alias(name))

    return per("open", "open_jobs").join(per("new", "new_jobs"), "batch")


# ---- streams --------------------------------------------------------------------
def _state_chain(batches, days):
    """Seen state after each of the batches, as a chain of SQL steps."""
    text = f"WITH sg AS (SELECT *, CAST(floor((day(day) - 1) / 7) AS INT) AS week FROM ({sample.as_sql(sample.SIGHTINGS, 'events')})), s0 AS (SELECT NULL::VARCHAR AS job_id, NULL::DATE AS first_seen, NULL::DATE AS last_seen WHERE false)"
    for i in range(batches):
        today = f"(SELECT max(day) FROM sg WHERE week = {i})"
        text += f""", s{i + 1} AS (SELECT coalesce(o.job_id, n.job_id) AS job_id, coalesce(o.first_seen, {today}) AS first_seen,
            CASE WHEN n.job_id IS NOT NULL THEN {today} ELSE o.last_seen END AS last_seen FROM s{i} o FULL JOIN (SELECT DISTINCT job_id FROM sg WHERE week = {i}) n
            ON n.job_id = o.job_id WHERE n.job_id IS NOT NULL OR o.last_seen >= {today} - {days})"""
    return text + f" SELECT * FROM s{batches}"


@query("t02_seen_stream", _state_chain(5, 8))
def t02(spark, sf):
    rows = sample.sightings(spark, sf).withColumn("week", F.floor((F.dayofmonth("day") - 1) / 7).cast("int"))
    landing, state = folder(spark, "sightings"), folder(spark, "seen")
    per_batch = land([rows.filter(c("week") == w) for w in range(5)], landing)
    stream = cycles.files(spark, landing, rows.schema, per_batch)
    cycles.seen_stream(stream, state, folder(spark, "progress"), days=8).awaitTermination()
    return tables.read_latest(spark, state, "job_id string, first_seen date, last_seen date")


@query("t02_empty_batch", _state_chain(5, 8))
def t02_empty(spark, sf):
    """A week without sightings lands as files without rows: the state goes on as it was."""
    rows = sample.sightings(spark, sf).withColumn("week", F.floor((F.dayofmonth("day") - 1) / 7).cast("int"))
    landing, state = folder(spark, "sightings"), folder(spark, "seen")
    per_batch = land([rows.filter(c("week") == w) for w in (0, 1, 99, 2, 3, 99, 4, 99)], landing, 1)
    stream = cycles.files(spark, landing, rows.schema, per_batch)
    cycles.seen_stream(stream, state, folder(spark, "progress"), days=8).awaitTermination()
    return tables.read_latest(spark, state, "job_id string, first_seen date, last_seen date")


def runs(spark, sf):
    """Sightings as weekly runs, each row with the day of its run."""
    rows = sample.sightings(spark, sf).withColumn("week", F.floor((F.dayofmonth("day") - 1) / 7).cast("int"))
    days = rows.groupBy("week").agg(F.max("day").alias("day"))
    return rows.drop("day").join(F.broadcast(days.filter("week < 5")), "week")


@query("t02_keyed_stream", _state_chain(5, 8))
def t02_keyed(spark, sf):
    """The weekly runs through keyed state with timers, read from the state itself."""
    rows = runs(spark, sf)
    landing, checkpoint = folder(spark, "sightings"), folder(spark, "progress")
    per_batch = land([rows.filter(c("week") == w) for w in range(5)], landing)
    keyed.keyed_seen_stream(cycles.files(spark, landing, rows.schema, per_batch), folder(spark, "seen"), checkpoint, days=8).awaitTermination()
    return keyed.read_state(spark, checkpoint, "seen")


@query("t02_seen_changes", _state_chain(5, 8).rsplit(" SELECT", 1)[0] + ", ".join(["", *[f"""
    d{i} AS (SELECT job_id, {i} AS run, CASE WHEN o.job_id IS NULL THEN 'new' ELSE 'seen' END AS change FROM (SELECT DISTINCT job_id FROM sg WHERE week = {i}) n LEFT JOIN s{i} o USING (job_id)
        UNION ALL SELECT job_id, {i}, 'gone' FROM s{i} WHERE job_id NOT IN (SELECT job_id FROM s{i + 1}))""" for i in range(5)]])
    + " SELECT change, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(5)) + ") GROUP BY change")
def t02_changes(spark, sf):
    """New, seen again and gone over all weekly runs, from the log of changes."""
    rows = runs(spark, sf)
    landing, log = folder(spark, "sightings"), folder(spark, "seen")
    per_batch = land([rows.filter(c("week") == w) for w in range(5)], landing)
    keyed.keyed_seen_stream(cycles.files(spark, landing, rows.schema, per_batch), log, folder(spark, "progress"), days=8).awaitTermination()
    return spark.read.parquet(log).groupBy("change").agg(F.count("*").alias("n"))


@query("t04_merge_stream", P + f""", u AS (SELECT *, {sql.posting_key()} AS k, CAST(floor(l_linenumber / 3) AS INT) AS batch FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY batch DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM u WHERE k IS NOT NULL)
    SELECT {KEYS}, k FROM r WHERE rn = 1 AND (batch = 2 OR {sql.fresh('scraped_at')})""")
def t04(spark, sf):
    rows = sample.postings(spark, sf)
    landing, state = folder(spark, "scrapes"), folder(spark, "merged")
    per_batch = land([rows.filter(F.floor(c("l_linenumber") / 3) == b) for b in range(3)], landing)
    stream = cycles.files(spark, landing, rows.schema, per_batch)
    cycles.merge_stream(stream, state, folder(spark, "progress"), lambda epoch: AS_OF, ORD, n_buckets=16).awaitTermination()
    return cycles.merged_table(spark, state, rows.schema).select(*ORD, c("posting_key").alias("k"))


@query("t05_progressive_stats", P + " SELECT count(*) AS jobs, count(DISTINCT company) AS companies FROM p")
def t05(spark, sf):
    rows = sample.postings(spark, sf).select("company", "l_linenumber")
    landing, state = folder(spark, "grow"), folder(spark, "counts")
    per_batch = land([rows.filter(c("l_linenumber") % 3 == b) for b in range(3)], landing)
    cycles.progressive_stream(cycles.files(spark, landing, rows.schema, per_batch), state, folder(spark, "progress")).awaitTermination()
    return cycles.board_progress(spark, state, tables.latest_version(spark, state))


@query("t06_dead_slug_stream", FETCHES + " SELECT DISTINCT ats AS platform, slug FROM f WHERE status_code = 404")
def t06(spark, sf):
    rows = fetches(spark, sf).filter("status_code = 404").select(c("ats").alias("platform"), "slug").distinct()
    landing, state = folder(spark, "dead"), folder(spark, "cache")
    per_batch = land([rows.filter("hash(slug) % 2 = 0"), rows.filter("hash(slug) % 2 <> 0"), rows], landing)
    cycles.dead_slug_stream(cycles.files(spark, landing, rows.schema, per_batch), state, folder(spark, "progress"), n_buckets=16).awaitTermination()
    return buckets.read_state(spark, state, cycles.DEAD)


@query("t08_status_stream", "WITH " + ST + """, f AS (SELECT key, list_reduce(list_prepend('', list(status ORDER BY ts, event_id)),
    lambda a, b: CASE WHEN a = b THEN '' ELSE b END) AS status FROM st GROUP BY key) SELECT key, status FROM f WHERE status <> ''""")
def t08(spark, sf):
    rows = sample.status_events(spark, sf)
    landing, state = folder(spark, "status"), folder(spark, "current")
    per_batch = land([rows.filter(f"floor((dayofmonth(ts) - 1) / 10) = {b}") for b in range(3)], landing)
    cycles.status_stream(cycles.files(spark, landing, rows.schema, per_batch), state, folder(spark, "progress"), toggle=True).awaitTermination()
    return tables.read_latest(spark, state, cycles.STATUS).select("key", "status")


@query("t08_keyed_status", ORACLES["t08_status_stream"])
def t08_keyed(spark, sf):
    """Toggled statuses through keyed state."""
    rows = sample.status_events(spark, sf)
    landing, checkpoint = folder(spark, "status"), folder(spark, "progress")
    per_batch = land([rows.filter(f"floor((dayofmonth(ts) - 1) / 10) = {b}") for b in range(3)], landing)
    keyed.keyed_status_stream(
        cycles.files(spark, landing, rows.schema, per_batch), folder(spark, "current"), checkpoint, toggle=True).awaitTermination()
    return keyed.read_state(spark, checkpoint, "status").select("key", "status")

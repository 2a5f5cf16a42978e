"""The watched companies and their boards in the alert schema."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.classify import job_id
from vacantia.functions.text import first_non_empty, strip
from vacantia.operators.joins import first_per_group
from vacantia.sources.boards import WORKDAY_BODY

#: The last millisecond of the year 9999; later stamps are not dates.
LAST_MILLISECOND = 253_402_300_799_999
WATCHED = "platform string, slug string, name string, tags array<string>"


def read_watch_list(spark, path):
    """Watch-list YAML as ``platform, slug, name, tags``: a small hand-kept config file.

    Entries that are no mapping or have no slug are skipped.
    """
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    content = yaml.safe_load(text) or {}
    rows = [
        (platform, str(e["slug"]), str(e.get("name", e["slug"])), [str(t) for t in e.get("tags") or []])
        for platform in fixed.WATCH_PLATFORMS
        for e in content.get(platform) or []
        if isinstance(e, dict) and e.get("slug")
    ]
    return spark.createDataFrame(rows, WATCHED)


def _answered(raw, watched, ats):
    """Landed pages of the watched boards, with the name to show."""
    names = watched.filter(F.col("platform") == ats.lower()).select("slug", "name")
    return raw.filter((F.col("ats") == ats) & (F.col("status_code") == 200)).join(names, "slug")


def _alert_rows(jobs, ats, raw_id, title, location, url, date):
    return jobs.select(
        job_id(F.lit(ats), F.col("slug"), raw_id).alias("job_id"),
        strip(F.coalesce(title, F.lit(""))).alias("title"),
        F.coalesce("name", "slug").alias("company"), F.col("slug").alias("company_slug"),
        strip(F.coalesce(location, F.lit(""))).alias("location"),
        F.coalesce(url, F.lit("")).alias("application_url"),
        date.alias("date_posted"), F.lit(ats).alias("platform_source"),
    )


def greenhouse(raw, watched):
    body = "jobs array<struct<id:string,title:string,absolute_url:string,updated_at:string,location:struct<name:string>>>"
    jobs = _answered(raw, watched, "Greenhouse").select("slug", "name", F.explode(F.from_json("body", body)["jobs"]).alias("job"))
    job = F.col("job")
    return _alert_rows(
        jobs, "Greenhouse", F.coalesce(first_non_empty(job["id"], job["absolute_url"]), F.lit("")), job["title"],
        job["location"]["name"], job["absolute_url"], F.try_to_date(F.substring(job["updated_at"], 1, 10), "yyyy-MM-dd"),
    )


def lever(raw, watched):
    body = "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,categories:struct<location:string>>>"
    answered = _answered(raw, watched, "Lever").filter(F.startswith(F.ltrim("body"), F.lit("[")))
    jobs = answered.select("slug", "name", F.explode(F.from_json("body", body)).alias("job"))
    job = F.col("job")
    known = (job["createdAt"] != 0) & job["createdAt"].between(-LAST_MILLISECOND, LAST_MILLISECOND)
    created = F.when(known, F.to_date(F.timestamp_millis(F.when(known, job["createdAt"]))))
    return _alert_rows(
        jobs, "Lever", F.coalesce(first_non_empty(job["id"], job["hostedUrl"]), F.lit("")), job["text"],
        job["categories"]["location"], job["hostedUrl"], created,
    )


def workday(raw, watched, terms=None):
    """All landed hits of the search terms, each path of a board once.

    ``raw`` carries the ``search_term`` of every landed page.
    """
    terms = terms or fixed.WORKDAY_SEARCH_TERMS
    rank = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("search_term"))
    pages = (
        _answered(raw, watched, "Workday")
        .filter((F.size(F.split("slug", r"\|")) == 3) & F.col("search_term").isin(terms))
    )
    hits = pages.select(
        "slug", "name", rank.alias("_term"), "offset",
        F.posexplode(F.from_json("body", WORKDAY_BODY)["jobPostings"]).alias("_at", "job"),
    ).withColumn("path", F.coalesce("job.externalPath", F.lit("")))
    once = first_per_group(hits.filter("path <> ''"), ["slug", "path"], ["_term", "offset", "_at"])
    company, number, site = [F.get(F.split("slug", r"\|"), F.lit(i)) for i in range(3)]
    url = F.concat(
        F.lit("https://"), company, F.lit(".wd"), F.regexp_replace(number, "^[wd]+", ""),
        F.lit(".myworkdayjobs.com/"), site, F.col("path"),
    )
    return _alert_rows(
        once, "Workday", F.col("path"), F.col("job.title"), F.col("job.locationsText"), url, F.lit(None).cast("date")
    )

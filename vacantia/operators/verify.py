"""Verification of alert jobs against landed pages, boards and search results."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions import pages
from vacantia.functions.dates import date_in_text, days_ago
from vacantia.functions.money import salary_text
from vacantia.functions.text import first_non_empty, has_any, non_empty, strip
from vacantia.operators.joins import last_per_group, lookup_join


def latest_snapshots(snapshots, order=("fetched_at",)):
    """One snapshot per url, the last one fetched."""
    return last_per_group(snapshots, ["url"], list(order))


def latest_answers(answers, keys):
    """One landed answer per key: the last by ``landed_at``, then a success before a failure.

    Tables without ``landed_at`` have one landing; what ties is settled by all columns.
    """
    at = ["landed_at"] if "landed_at" in answers.columns else []
    rest = sorted(n for n in answers.columns if n not in (*keys, *at, "status_code"))
    return last_per_group(answers, list(keys), [*at, -F.col("status_code"), *rest])


def embed_verdicts(snapshots, board):
    """Answer of the board for pages that embed one posting (``gh_jid=`` in the url).

    ``board`` holds landed answers: ``slug, posting_id, status_code, location, updated_at``.
    The slug comes from the embed script, else from a posting link in the page, else from
    the domain; the first slug with a 200 or 404 answer decides.
    """
    posting = F.regexp_extract("url", r"gh_jid=(\d+)", 1)
    html = F.coalesce("html", F.lit(""))
    linked = F.regexp_extract(
        F.regexp_substr(
            html, F.concat(F.lit(r"(?i)boards\.greenhouse\.io/[a-z0-9][a-z0-9\-_]{2,}/jobs/"), F.col("posting_id"))
        ),
        r"(?i)greenhouse\.io/([^/]+)/", 1,
    )
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    domain = F.substring_index(F.regexp_replace(host, r"^(?:jobs\.|www\.|careers\.)", ""), ".", 1)
    embedded = snapshots.withColumn("posting_id", posting).filter("posting_id <> ''")
    slugs = F.array(non_empty(F.regexp_extract(html, fixed.EMBED_SLUG, 1)), non_empty(linked), non_empty(domain))
    tries = embedded.select("url", "posting_id", F.posexplode(slugs).alias("_try", "slug")).filter("slug IS NOT NULL")
    answers = latest_answers(board, ["slug", "posting_id"]).filter(F.col("status_code").isin(200, 404)).select(
        "slug", "posting_id",
        F.struct(
            (F.col("status_code") == 200).alias("is_live"),
            F.when(F.col("status_code") == 200, first_non_empty(F.col("location"))).alias("location"),
            F.when(F.col("status_code") == 200, first_non_empty(F.substring("updated_at", 1, 10))).alias("date"),
        ).alias("embed"),
    )
    return (
        lookup_join(tries, answers, ["slug", "posting_id"], "inner")
        .groupBy("url").agg(F.min_by("embed", "_try").alias("embed"))
    )


def workday_parts(url):
    """struct(company, host, tenant, posting) of a Workday posting url, else null."""
    def part(i):
        return F.regexp_extract(url, fixed.WORKDAY_URL, i)

    return F.when(
        url.rlike(fixed.WORKDAY_URL),
        F.struct(
            part(1).alias("company"), F.concat(part(1), part(2)).alias("host"),
            part(3).alias("tenant"), part(4).alias("posting"),
        ),
    )


def with_workday_answer(jobs, searches, as_of):
    """Add ``workday`` struct(is_live, location, date) from landed one-hit searches.

    ``searches`` holds ``host, tenant, posting, status_code, total, posted_on, locations_text``.
    """
    posted = strip(F.col("posted_on"))
    date = F.coalesce(
        days_ago(posted, as_of), F.when(posted.rlike(r"^\d{4}-\d{2}-\d{2}$"), posted)
    )
    live = F.coalesce(F.col("total"), F.lit(0)) != 0
    answers = latest_answers(searches, ["host", "tenant", "posting"]).filter("status_code = 200").select(
        "host", "tenant", "posting",
        F.struct(
            live.alias("is_live"),
            F.when(live, first_non_empty(strip(F.col("locations_text")))).alias("location"),
            F.when(live, date).alias("date"),
        ).alias("workday"),
    )
    parts = workday_parts(strip(F.col("application_url")))
    keyed = jobs.withColumn("_wd", parts).withColumns(
        {n: F.col("_wd")[n] for n in ("host", "tenant", "posting")}
    )
    return lookup_join(keyed, answers, ["host", "tenant", "posting"]).drop("_wd", "host", "tenant", "posting")


def page_facts(snapshots, as_of):
    """Everything a page says, once per url: texts, dates, salary, location, closed signs."""
    c = F.col
    html, body = F.coalesce("html", F.lit("")), F.coalesce("body_text", F.lit(""))
    title, final = F.coalesce("title", F.lit("")), F.coalesce("final_url", "url")
    facts = snapshots.select(
        "url", final.alias("final_url"), "http_status", title.alias("page_title"), "fetch_error",
        body.alias("_body"), html.alias("_html"), pages.json_ld(html).alias("_ld"),
    )
    low_final = F.lower("final_url")
    return facts.select(
        "url", "http_status", "fetch_error",
        F.lit(True).alias("has_page"),
        (F.contains(low_final, F.lit("error=true")) | F.contains(low_final, F.lit("notfound=1"))
         | (F.contains(low_final, F.lit("icims.com")) & F.contains(low_final, F.lit("/jobs/search")))).alias("moved"),
        (pages.is_generic_title(c("page_title")) & ~pages.sets_title_late(c("final_url"))).alias("generic"),
        pages.mentions_closed(c("_body")).alias("closed_phrase"),
        pages.fell_back_to_home(c("url"), c("final_url")).alias("sent_home"),
        pages.json_ld_expired(c("_ld"), as_of).alias("expired"),
        pages.json_ld_location(c("_ld")).alias("ld_location"),
        F.coalesce(pages.json_ld_salary(c("_ld")), salary_text(c("_body"))).alias("page_salary"),
        F.coalesce(pages.json_ld_date(c("_ld")), date_in_text(c("_body"), as_of)).alias("page_date"),
        pages.icims_location(c("page_title"), c("_body"), c("_html")).alias("icims_location"),
    )


def close_reason():
    """Why a job counts as closed, first sign first; null while it counts as open."""
    c = F.col
    url = F.lower(strip(F.coalesce("application_url", F.lit(""))))
    icims_url = F.contains(url, F.lit("icims.com"))
    is_icims = c("platform_source") == "iCIMS"
    loaded = c("has_page") & c("fetch_error").isNull()
    found = c("location_found")
    return (
        F.when(url == "", "blank_url")
        .when(c("workday").isNotNull(), F.when(~c("workday.is_live"), "workday_gone"))
        .when(icims_url & has_any(url, ["notfound=1", "/jobs/search"]), "icims_not_found")
        .when(~F.coalesce(loaded, F.lit(False)), F.when(~c("embed.is_live"), "embed_gone"))
        .when(c("http_status") >= 400, "http_status")
        .when(c("moved"), "moved")
        .when(c("generic"), "generic_title")
        .when(c("embed").isNotNull(), F.when(~c("embed.is_live"), "embed_gone"))
        .when(c("closed_phrase"), "closed_phrase")
        .when(c("sent_home"), "sent_home")
        .when(c("expired"), "expired")
        .when(is_icims & found.isNull(), "no_location")
        .when(pages.location_excluded(found), "wrong_location")
    )


def verify(jobs, snapshots, as_of, board=None, searches=None):
    """Alert jobs with ``is_live, close_reason, salary_posted, date_posted, location_verified``.

    Landed answers of a board or a search outrank the page; a page that failed to load
    leaves its job open with nothing verified.
    """
    spark = jobs.sparkSession
    as_of = F.lit(as_of).cast("timestamp")
    if board is None:
        board = spark.createDataFrame(
            [], "slug string, posting_id string, status_code int, location string, updated_at string")
    if searches is None:
        searches = spark.createDataFrame(
            [], "host string, tenant string, posting string, status_code int, total int, "
                "posted_on string, locations_text string")
    # only pages some job points to are read closely
    wanted = jobs.select(strip(F.col("application_url")).alias("url")).filter("url <> ''").distinct()
    landed = latest_snapshots(snapshots.join(wanted, "url", "left_semi"))
    facts = page_facts(landed, as_of).join(embed_verdicts(landed, board), "url", "left")
    rows = with_workday_answer(jobs.drop("date_posted"), searches, as_of)
    rows = lookup_join(
        rows.withColumn("_url", strip(F.col("application_url"))), facts.withColumnRenamed("url", "_url"), "_url"
    ).drop("_url")
    c = F.col
    rows = rows.withColumn(
        "location_found",
        F.when(c("platform_source") == "iCIMS", F.coalesce("ld_location", "icims_location")).otherwise(c("ld_location")),
    ).withColumn("close_reason", close_reason())
    is_live = c("close_reason").isNull()
    answered = F.coalesce("workday", F.when(F.coalesce(c("http_status") < 400, F.lit(True)), c("embed")))
    from_page = is_live & answered.isNull() & F.coalesce(c("has_page") & c("fetch_error").isNull(), F.lit(False))
    return rows.select(
        *[n for n in jobs.columns if n != "date_posted"],
        is_live.alias("is_live"), "close_reason",
        F.when(from_page, c("page_salary")).alias("salary_posted"),
        F.try_to_date(
            F.when(is_live, F.coalesce(answered["date"], F.when(from_page, c("page_date")))), "yyyy-MM-dd"
        ).alias("date_posted"),
        F.when(is_live, F.coalesce(answered["location"], F.when(from_page, c("location_found")))).alias("location_verified"),
        as_of.alias("liveness_checked_at"),
    )


def live_only(verified):
    return verified.filter(F.coalesce("is_live", F.lit(True)))

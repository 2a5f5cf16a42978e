"""The alert filter: titles, locations, and the alert form of a posting."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.classify import company_slug, job_id
from vacantia.functions.text import alternation, has_any, has_phrase, strip
from vacantia.schemas import ALERT_COLUMNS


def title_wanted(title, phrases=None):
    return has_phrase(title, phrases or fixed.TARGET_PHRASES)


def title_excluded(title, phrases=None):
    return has_phrase(title, phrases or fixed.EXCLUSION_PHRASES)


def location_verdict(location, allow_unspecified=False, word_bounded=False):
    """True where a listed location is wanted: foreign first, then the allow lists."""
    text = F.lower(strip(F.coalesce(location, F.lit(""))))
    foreign = has_phrase(text, fixed.EXCLUDED_COUNTRIES) if word_bounded else has_any(text, fixed.EXCLUDED_COUNTRIES)
    allowed = (
        alternation(fixed.ALLOWED_LOCATIONS) + r"|,\s*fl\b|\A" + alternation(fixed.ALLOWED_BARE_LOCATIONS) + r"\z"
    )
    # blank locations match no allowed pattern, so they need no test of their own
    verdict = text.rlike("(?U)" + allowed) & ~foreign
    return verdict | text.isin(fixed.BLANK_LOCATIONS) if allow_unspecified else verdict


def keep_condition(phrases=None, exclusions=None, allow_unspecified=False):
    """Wanted title, then no exclusion, then location; the most selective test comes first.

    A blank title holds no wanted phrase, so it needs no test.
    """
    return (
        title_wanted(F.col("title"), phrases)
        & ~title_excluded(F.col("title"), exclusions)
        & _filled("application_url")
        & location_verdict(F.col("location"), allow_unspecified)
    )


def _filled(name):
    return F.coalesce(F.col(name).rlike(r"(?U)\S"), F.lit(False))


def filter_jobs(jobs, **options):
    return jobs.filter(keep_condition(**options))


def filter_report(jobs, **options):
    """Raw and kept rows per platform in one pass."""
    return jobs.groupBy("platform_source").agg(
        F.count("*").alias("raw"),
        F.count_if(F.coalesce(keep_condition(**options), F.lit(False))).alias("kept"),
    )


def icims_listed_location(location, company, remote):
    """Rewrite of the coded or missing locations of iCIMS rows ('' means excluded)."""
    text = strip(location)
    remote = F.coalesce(remote, F.lit(False))
    parts = F.split(text, "-")
    city = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    state = F.upper(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    foreign_board = company_slug(company).rlike("^(?:" + "|".join(fixed.ICIMS_INTL_PREFIXES) + ")")
    return (
        F.when(
            F.lower(text).isin(fixed.BLANK_LOCATIONS),
            F.when(foreign_board, F.lit("")).when(remote, F.lit("Remote")).otherwise(F.lit("United States")),
        )
        .when(
            text.rlike(r"^[A-Za-z]{2}-"),
            F.when(F.upper(F.left(text, F.lit(2))) != "US", F.lit(""))
            .when(remote, F.lit("Remote"))
            .when(state != "FL", F.lit(""))
            .when(city != "", F.concat(city, F.lit(", FL")))
            .otherwise(F.lit("Florida")),
        )
        .otherwise(location)
    )


def to_alert_jobs(postings, keep=()):
    """Slim postings to alert rows; rows without url, title or company are dropped."""
    empty = F.lit("")
    filled = _filled("url") & _filled("title") & _filled("company")
    rows = postings.filter(filled).select(
        *keep,
        strip(F.col("title")).alias("title"),
        strip(F.col("company")).alias("company"),
        strip(F.col("url")).alias("application_url"),
        F.coalesce("ats", F.lit("Unknown")).alias("platform_source"),
        strip(F.coalesce("location", empty)).alias("location"),
        "remote",
        F.coalesce("skill_level", empty).alias("skill_level"),
        F.coalesce("is_recruiter", F.lit(False)).alias("is_recruiter"),
    )
    icims = F.col("platform_source") == "iCIMS"
    return rows.withColumns({
        "location": F.when(
            icims, icims_listed_location(F.col("location"), F.col("company"), F.col("remote"))
        ).otherwise(F.col("location")),
        "company_slug": company_slug(F.col("company")),
        "date_posted": F.lit(None).cast("date"),
        "job_id": job_id(F.col("platform_source"), F.col("company"), F.col("application_url")),
    }).select(*keep, *ALERT_COLUMNS)

"""Aggregate reports of the scrape, the alert run, the trend and the probes."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed


def company_job_counts(fetches):
    """Jobs per active company from ``ats, slug, jobs, status_code`` fetch results."""
    return (
        fetches.groupBy("ats", "slug").agg(F.sum("jobs").alias("jobs")).filter(F.col("jobs") > 0)
    )


def fetch_report(fetches):
    """Per platform: checked, active, failed or empty, newly dead, jobs."""
    slugs = fetches.groupBy("ats", "slug").agg(
        F.sum("jobs").alias("jobs"), F.max("status_code").alias("status_code")
    )
    dead = (F.col("jobs") == 0) & F.coalesce(F.col("status_code").isin(404, 410), F.lit(False))
    return slugs.groupBy("ats").agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("jobs") > 0).alias("active"),
        F.count_if(F.col("jobs") == 0).alias("failed"),
        F.count_if(dead).alias("newly_dead"),
        F.sum("jobs").alias("jobs"),
    )


def newly_dead(fetches):
    slugs = fetches.groupBy("ats", "slug").agg(
        F.sum("jobs").alias("jobs"), F.max("status_code").alias("status_code")
    )
    return slugs.filter((F.col("jobs") == 0) & F.col("status_code").isin(404, 410)).select("ats", "slug")


def run_totals(companies, postings):
    """Published totals: all companies, active companies, jobs, recruiter jobs."""
    active = postings.agg(
        F.count_distinct("company_slug").alias("active_companies"),
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("is_recruiter")).alias("recruiter_jobs"),
    )
    known = companies.agg(F.count_distinct("slug").alias("total_companies"))
    return _side_by_side(known, active)


def _side_by_side(left, right):
    """Two one-row results as one row."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def count_by_platform(jobs, name="platform_source"):
    return jobs.groupBy(F.coalesce(name, F.lit("Unknown")).alias(name)).agg(F.count("*").alias("jobs")).orderBy(name)


def verification_counts(verified):
    live = F.coalesce("is_live", F.lit(True))
    return verified.agg(
        F.count_if(live).alias("live"),
        F.count_if(~live).alias("closed"),
        F.count_if(live & F.coalesce(F.col("salary_posted") != "", F.lit(False))).alias("with_salary"),
    )


def daily_trend(postings):
    """One row per ``date``: totals plus job counts by platform and by tier.

    The postings are read once, reduced to a row per day, platform, tier and company; the
    totals and both maps come from one roll-up of those rows.
    """
    cells = postings.groupBy("date", F.lower("ats").alias("ats"), "skill_level", "company_slug").agg(
        F.count("*").alias("n"), F.count_if(F.col("is_recruiter")).alias("recruiters")
    )
    sums = cells.groupingSets(
        [["date"], ["date", "ats"], ["date", "skill_level"]], "date", "ats", "skill_level"
    ).agg(
        F.sum("n").alias("n"), F.sum("recruiters").alias("recruiters"),
        F.count_distinct("company_slug").alias("companies"), F.grouping_id().alias("level"),
    )
    total, by_ats, by_tier = (F.col("level") == k for k in (0b011, 0b001, 0b010))

    def as_map(level, name):
        entries = F.collect_list(F.when(level & F.col(name).isNotNull(), F.struct(F.col(name).alias("key"), F.col("n").alias("value"))))
        return F.map_from_entries(F.sort_array(entries))

    return sums.groupBy("date").agg(
        F.max(F.when(total, F.col("n"))).alias("total_jobs"),
        F.max(F.when(total, F.col("companies"))).alias("active_companies"),
        F.max(F.when(total, F.col("recruiters"))).alias("recruiter_jobs"),
        as_map(by_ats, "ats").alias("by_platform"), as_map(by_tier, "skill_level").alias("by_tier"),
    )


def url_health(probes):
    """Verdict per platform from all probed urls (HEAD, GET after a 405)."""
    probed = probes.filter("url <> ''")
    final = F.when(F.col("http_status") == 405, F.col("get_status")).otherwise(F.col("http_status"))
    found = probed.groupBy("ats").agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(final < 400, F.lit(False))).alias("alive")
    )
    names = probes.sparkSession.createDataFrame([(n,) for n in fixed.ATS_NAMES], "ats string")
    report = names.join(found, "ats", "left").select(
        "ats", F.coalesce("alive", F.lit(0)).alias("alive"), F.coalesce("total", F.lit(0)).alias("total")
    )
    status = (
        F.when(F.col("total") == 0, "NO_URLS").when(F.col("alive") == 0, "PATTERN_BROKEN")
        .when(F.col("alive") < F.col("total") * 0.5, "DEGRADED").otherwise("OK")
    )
    note = (
        F.when(F.col("status") == "NO_URLS", "Extraction returned nothing - parse path or all samples empty")
        .when(
            F.col("status") == "PATTERN_BROKEN",
            F.when(F.col("ats").isin(fixed.BUILT_URL_ATS), "The built URL is likely stale (you construct this URL)")
            .otherwise("The provider API shape likely changed (URL is pass-through)"),
        ).otherwise("")
    )
    return report.withColumn("status", status).withColumn("note", note)


def health_failures(report):
    return report.filter(F.col("status").isin("PATTERN_BROKEN", "NO_URLS")).select("ats")


def is_valid_probe():
    return (F.col("http_status") == 200) & (F.coalesce("job_count", F.lit(0)) > 0)


def probe_summary(probes):
    ok = F.coalesce(is_valid_probe(), F.lit(False))
    return probes.groupBy("platform").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("dead"))


def dead_probes(probes):
    return probes.filter(~F.coalesce(is_valid_probe(), F.lit(False))).select("platform", "slug", "http_status")


def candidate_results(probes):
    """Probed candidates, valid ones first, then by platform and slug."""
    ok = F.coalesce(is_valid_probe(), F.lit(False))
    return probes.withColumn("ok", ok).orderBy(F.col("ok").desc(), "platform", "slug")


def watch_list_sizes(watch_list):
    return watch_list.groupBy("platform").agg(F.count("*").alias("companies"))


def newest_matches(new_jobs, limit=fixed.TOP_NEW):
    """First ``limit`` new jobs by company for the run summary."""
    return new_jobs.orderBy("company", "job_id").limit(limit)


def remaining_matches(new_jobs, limit=fixed.TOP_NEW):
    return new_jobs.agg(F.greatest(F.count("*") - limit, F.lit(0)).cast("bigint").alias("more"))

"""The two interactive views: faceted filter, search, sort, page, map."""

import math

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.classify import CLASSES, is_real_company
from vacantia.functions.display import coordinate_key, jitter
from vacantia.functions.text import first_non_empty, quote
from vacantia.operators.joins import first_per_group, last_per_group, lookup_join

_WORD = "[A-Za-z0-9_]"


def _text(col):
    return F.lower(F.coalesce(col, F.lit("")))


def _bounded(term):
    """Literal between ASCII word boundaries, whatever its first and last character."""
    def edge(ch, inside, outside):
        return inside if ch.isascii() and (ch.isalnum() or ch == "_") else outside

    before = edge(term[0], f"(?<!{_WORD})", f"(?<={_WORD})")
    after = edge(term[-1], f"(?!{_WORD})", f"(?={_WORD})")
    return before + quote(term) + after


def listed_location(df, name="location"):
    """Location text, also where the field holds an object with a name."""
    return F.coalesce(F.get_json_object(name, "$.name"), F.col(name))


def company_of(df):
    names = [n for n in ("company", "company_slug") if n in df.columns]
    return first_non_empty(*[F.col(n) for n in names])


def facet_text(column, term):
    return _text(column).rlike("(?i)" + _bounded(term.lower().strip()))


def facet_salary(minimum):
    return F.coalesce(F.col("salary.median") >= minimum, F.lit(False))


def facet_remote(location):
    return F.contains(_text(location), F.lit("remote")) | (_text(F.col("workplaceType")) == "remote")


def facet_equal(name, value):
    return _text(F.col(name)) == value.lower()


def _terms(text):
    return [t.strip() for t in text.lower().split(",") if t.strip()]


def facet_any_term(column, text):
    """True where any of the comma-separated terms is a substring."""
    found = F.lit(False)
    for term in _terms(text):
        found = found | F.contains(_text(column), F.lit(term))
    return found


def with_status(df, statuses, on="url"):
    """Left join of the one status per key; '' where there is none."""
    known = statuses.select(F.col("key").alias(on), F.col("status"))
    return lookup_join(df, known, on, implied=CLASSES).withColumn("status", F.coalesce("status", F.lit("")))


def facet_query(
    df, statuses=None, *, hide_recruiters=True, remote_only=False, hide_applied=False, title="",
    company="", location="", salary_min=0, status="", ats="", skill_level="", exclude="", include="",
):
    """Conjunction of the facets that are set; facets left alone add no predicate.

    The tier is asked last, as it may have to be worked out from the title.
    """
    rows = df
    if hide_recruiters:
        rows = rows.filter(~F.coalesce(F.col("is_recruiter"), F.lit(False)))
    if ats:
        rows = rows.filter(facet_equal("ats", ats))
    if salary_min > 0:
        rows = rows.filter(facet_salary(salary_min))
    if remote_only:
        rows = rows.filter(facet_remote(listed_location(df)))
    if _terms(exclude):
        rows = rows.filter(~facet_any_term(F.col("title"), exclude))
    if _terms(include):
        rows = rows.filter(facet_any_term(F.col("title"), include))
    for term, column in ((title, F.col("title")), (company, company_of(df)), (location, listed_location(df))):
        if term.strip():
            rows = rows.filter(facet_text(column, term))
    if skill_level:
        rows = rows.filter(facet_equal("skill_level", skill_level))
    if status or hide_applied:
        rows = with_status(rows, statuses)
        if hide_applied:
            rows = rows.filter(~F.col("status").isin("applied", "ignored"))
        if status:
            rows = rows.filter(F.col("status") == status)
        rows = rows.drop("status")
    return rows


def alert_search(jobs, statuses, *, text="", platform="", tab="", hide_actioned=False):
    """Free-text and platform filter of the alert view with its status tabs.

    Hiding applied and ignored rows works on the All tab only.
    """
    rows = jobs
    if platform:
        rows = rows.filter(F.col("platform_source") == platform)
    if text.strip():
        place = F.coalesce(first_non_empty(F.col("location_verified"), F.col("location")), F.lit(""))
        hay = F.lower(F.concat_ws(" ", "title", "company", place))
        rows = rows.filter(F.contains(hay, F.lit(text.lower().strip())))
    rows = with_status(rows, statuses, on="job_id")
    if tab:
        return rows.filter(F.col("status") == tab)
    return rows.filter(~F.col("status").isin("applied", "ignored")) if hide_actioned else rows


def sort_keys(column, ascending=True):
    """Values that start with a digit always last, then by lower-case value."""
    value = _text(column)
    return [value.rlike(r"^\d").asc(), value.asc() if ascending else value.desc()]


def alert_sort_keys(name, ascending=True):
    """Date columns keep nulls last both ways; other columns sort as lower-case text."""
    if name in ("first_seen", "last_seen", "date_posted", "liveness_checked_at"):
        value = F.coalesce("date_posted", "first_seen") if name == "first_seen" else F.col(name)
        return [value.asc_nulls_last() if ascending else value.desc_nulls_last()]
    value = _text(F.col(name).cast("string"))
    return [value.asc() if ascending else value.desc()]


def page_count(rows, size):
    return math.ceil(rows / size)


#: Rows that a task may look for to tell whether a page exists.
EARLY_ROWS = 10_000


def page(df, order, number=1, size=fixed.PAGE_SIZES[0]):
    """One page of the ordered table; a page number out of range falls back to 1.

    Whether an early page exists is known once the rows before it and one more are found.
    """
    before = max(number - 1, 0) * size
    if before:
        rows = df.limit(before + 1) if before <= EARLY_ROWS else df
        if rows.count() <= before:
            before = 0
    return df.orderBy(*order).offset(before).limit(size)


def board_stats(df):
    company = first_non_empty(*[F.col(n) for n in ("company_slug", "company") if n in df.columns])
    return df.agg(F.count("*").alias("jobs"), F.count_distinct(company).alias("companies"))


def in_viewport(south, west, north, east):
    return F.col("coords").isNotNull() & F.col("coords.lat").between(south, north) & F.col("coords.lng").between(west, east)


def map_markers(df, box, order, seed=0):
    """One posting per company initial in the viewport, priced ones first."""
    visible = df.filter(in_viewport(*box) & is_real_company(F.col("company")))
    initial = F.lower(F.left("company", F.lit(1)))
    firsts = first_per_group(visible.withColumn("initial", initial), ["initial"], order)
    priced = F.coalesce(F.col("salary.median") != 0, F.lit(False))
    return firsts.orderBy(priced.desc(), F.xxhash64("url", F.lit(seed)))


def heatmap(df, minimum=fixed.HEATMAP_MIN):
    """Busy coordinates as jittered points with their row count."""
    cells = (
        df.filter("coords IS NOT NULL").groupBy(F.col("coords.lat").alias("lat"), F.col("coords.lng").alias("lng"))
        .agg(F.count("*").alias("n")).filter(F.col("n") >= minimum)
        .withColumn("_shift", jitter(coordinate_key(F.col("lat"), F.col("lng"))))
    )
    return cells.select(
        (F.col("lat") + F.col("_shift.lat")).alias("lat"), (F.col("lng") + F.col("_shift.lng")).alias("lng"), "n"
    )


def tab_counts(jobs, statuses):
    """Rows on the All, Saved, Applied and Ignored tabs; other statuses count nowhere."""
    marked = with_status(jobs.select("job_id"), statuses, on="job_id")
    return marked.agg(
        F.count("*").alias("all_jobs"),
        *[F.count_if(F.col("status") == s).alias(s) for s in fixed.STATUSES],
    )


def alert_stats(jobs, shown, as_of):
    """Shown and total rows, rows added this week, rows with a posted salary."""
    fresh = F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.col("first_seen")) <= fixed.NEW_BADGE_DAYS, F.lit(False))
    tagged = jobs.select("first_seen", "salary_posted", F.coalesce(shown, F.lit(False)).alias("_shown"))
    return tagged.agg(
        F.count_if("_shown").alias("shown"),
        F.count("*").alias("total"),
        F.count_if(fresh).alias("added"),
        F.count_if(F.coalesce(F.col("salary_posted") != "", F.lit(False))).alias("with_salary"),
    )


def current_status(events):
    """Last event per key; a ``null`` status means the entry was deleted."""
    return (
        last_per_group(events, ["key"], ["ts", "event_id"]).filter("status IS NOT NULL").select("key", "status", "ts")
    )


def toggled_status(events):
    """Status per key when setting the active status again clears it.

    Whatever came before, a run of equal events ends set after an odd and cleared after
    an even number of them. So only the length of each key's last run matters: count its
    events after the last event that carried a different status.
    """
    order = F.struct("ts", "event_id")
    latest = events.groupBy("key", "status").agg(F.max(order).alias("at"))
    top = first_per_group(latest, ["key"], [F.col("at").desc()], n=2)
    ends = top.groupBy("key").agg(F.max_by("status", "at").alias("last"), F.min("at").alias("before"), F.count("*").alias("_n"))
    ends = ends.select("key", "last", F.when(F.col("_n") == 2, F.col("before")).alias("before"))
    in_run = lookup_join(events.withColumn("at", order), ends, "key", "inner").filter(
        F.col("status").eqNullSafe(F.col("last")) & (F.col("before").isNull() | (F.col("at") > F.col("before")))
    )
    runs = in_run.groupBy("key").agg(F.first("last").alias("status"), F.count("*").alias("_n"))
    return runs.filter("status IS NOT NULL AND _n % 2 = 1").select("key", "status")


def apply_batch(statuses, marks, ts):
    """Statuses after a batch of marks: saved, then applied, then ignored; later overwrites."""
    rank = F.array_position(F.array(*[F.lit(s) for s in fixed.STATUSES]), F.col("status"))
    new = marks.filter(F.col("status").isin(fixed.STATUSES)).select(
        "key", "status", F.lit(ts).cast("timestamp").alias("ts"), rank.cast("int").alias("_rank")
    )
    old = statuses.select("key", "status", "ts", F.lit(0).alias("_rank"))
    return last_per_group(old.unionByName(new), ["key"], ["_rank"]).drop("_rank")

"""Dates written in texts."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.text import strip


def iso_date(raw):
    """ISO text of an ISO, m/d/y or month-name date; null otherwise."""
    text = F.rtrim(strip(raw), F.lit("."))
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    named = F.coalesce(*[F.date_format(F.try_to_date(text, f), "yyyy-MM-dd") for f in fixed.DATE_FORMATS])
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
        .when(
            text.rlike(slashed),
            F.concat_ws(
                "-",
                F.regexp_extract(text, slashed, 3),
                F.lpad(F.regexp_extract(text, slashed, 1), 2, "0"),
                F.lpad(F.regexp_extract(text, slashed, 2), 2, "0"),
            ),
        )
        .when(text.rlike(r"(?i)^(?:[a-z]+ \d{1,2}, ?\d{4}|[a-z]+ \d{1,2} \d{4}|\d{1,2} [a-z]+ \d{4})$"), named)
    )


def days_ago(text, as_of):
    days = F.regexp_extract(text, fixed.DAYS_AGO, 1).try_cast("int")
    return F.when(days <= 365, F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd"))


def posted_label(text):
    return iso_date(F.regexp_extract(text, fixed.POSTED, 1))


def date_in_text(text, as_of):
    return F.coalesce(days_ago(text, as_of), posted_label(text))


def date_in_html(html, as_of):
    """Older cascade: embedded JSON, time tag, days ago, posted label."""
    tag = F.regexp_extract(html, fixed.TIME_TAG, 1)
    return F.coalesce(
        iso_date(F.regexp_extract(html, fixed.POSTED_ON_JSON, 1)),
        F.when(tag != "", tag),
        days_ago(html, as_of),
        posted_label(html),
    )


def utc_timestamp(text):
    """ISO timestamp with Z or offset; null when unreadable."""
    return F.try_to_timestamp(text)

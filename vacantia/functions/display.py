"""Columns of the two views: badges, labels, display values."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.text import first_non_empty, has_any, word_capitals


def is_remote_alert(verified, listed):
    place = F.lower(F.coalesce(first_non_empty(verified, listed), F.lit("")))
    return has_any(place, ["remote", "anywhere", "work from home", "wfh"])


def display_location(verified, listed, platform, checked_at):
    """Verified location, else the listed one unless it is an unverified default."""
    unverified_default = (platform == "iCIMS") & (listed == "United States") & checked_at.isNotNull()
    return F.coalesce(
        first_non_empty(verified), F.when(~F.coalesce(unverified_default, F.lit(False)), first_non_empty(listed))
    )


def days_since(day, as_of):
    return F.coalesce(F.datediff(as_of, day), F.lit(999))


def is_new(first_seen, as_of):
    return days_since(first_seen, as_of) <= fixed.NEW_BADGE_DAYS


def shown_date(checked_at, date_posted, first_seen):
    return F.when(checked_at.isNotNull() & date_posted.isNotNull(), date_posted).otherwise(first_seen)


def shown_date_label(checked_at, date_posted):
    return F.when(checked_at.isNotNull() & date_posted.isNotNull(), F.lit("Posted")).otherwise(F.lit("First seen"))


def verified_label(checked_at, as_of):
    """Today / Yesterday / ``Jun 4`` by whole days since the check."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(checked_at)) / F.lit(86400))
    return (
        F.when(checked_at.isNull(), F.lit(""))
        .when(days == 0, F.lit("Today"))
        .when(days == 1, F.lit("Yesterday"))
        .otherwise(F.date_format(checked_at, "MMM d"))
    )


def verified_is_old(checked_at, as_of):
    return F.datediff(as_of, F.to_date(checked_at)) > 2


def company_display(company):
    return word_capitals(F.replace(company, F.lit("-"), F.lit(" ")))


def published_at(date_posted, first_seen, as_of):
    return F.coalesce(
        F.try_to_timestamp(date_posted), F.try_to_timestamp(first_seen), as_of.cast("timestamp")
    )


def rfc822(ts):
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def _plain(number):
    """Shortest decimal text without exponent or trailing zeros."""
    return F.regexp_replace(number.cast("decimal(24,12)").cast("string"), r"\.?0+$", "")


def coordinate_key(lat, lng):
    return F.concat(_plain(lat), F.lit(","), _plain(lng))


def string_hash(text):
    """Signed 32-bit hash ``h = 31 h + c`` over the UTF-16 units."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    count = (F.length(units) / 4).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        places,
        F.lit(0).cast("bigint"),
        lambda h, i: F.pmod(
            h * 31 + F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint") + F.lit(1 << 31), F.lit(1 << 32)
        ) - F.lit(1 << 31),
    )


def jitter(text):
    """Stable (lat, lng) offsets within a hundredth of a degree."""
    h = string_hash(text)

    def offset(bits):
        return (bits.bitwiseAND(F.lit(65535)) / F.lit(65535.0) - 0.5) * 0.02

    return F.struct(offset(h).alias("lat"), offset(F.shiftright(h, 16)).alias("lng"))

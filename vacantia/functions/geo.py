"""Free-text location parsing as column expressions.

Every step is a plain Spark expression; the parser is meant to run on the distinct
location strings (see ``operators.enrich.geocode``), not on every posting.
"""

import sys
import unicodedata

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.text import alternation, has_any, is_one_of, lookup, non_empty, squeeze, strip


def _accent_table():
    """(from, to) for ``translate``: accented letters to their base, loose marks dropped.

    Derived from the Unicode decompositions instead of being written down.
    """
    accented, bases, dropped = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch) == "Mn":
            dropped.append(ch)
            continue
        parts = unicodedata.normalize("NFD", ch)
        if parts == ch:
            continue
        kept = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(kept) == 1:
            accented.append(ch)
            bases.append(kept[0])
    return "".join(accented + dropped), "".join(bases)


_ACCENTS = _accent_table()


def strip_accents(col):
    return F.when(
        col.rlike(r"[^\x00-\x7F]"), F.translate(col, _ACCENTS[0], _ACCENTS[1])
    ).otherwise(col)


def normalize(col):
    """Lower case without accents and punctuation; saint, directions, ft/mt/pt unified."""
    text = strip_accents(F.coalesce(col, F.lit("")))
    text = squeeze(F.lower(F.translate(text, ".'`", "")))
    text = F.replace(F.regexp_replace(text, "^saint ", "st "), F.lit(" saint "), F.lit(" st "))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for short, full in fixed.WORD_EXPANSIONS:
        text = F.replace(text, F.lit(f" {short} "), F.lit(f" {full} "))
    return strip(text)


def is_garbage(normalized):
    return is_one_of(fixed.GARBAGE_LOCATIONS, normalized)


def mentions_remote(normalized):
    return has_any(normalized, fixed.REMOTE_WORDS)


def mentions_time_zone(normalized):
    return has_any(normalized, fixed.TIME_ZONE_WORDS)


def is_remote(location):
    text = normalize(location)
    return ~is_garbage(text) & mentions_remote(text)


def strip_work_arrangement(normalized):
    prefixes = "|".join(p.replace("-", r"\-") for p in fixed.WORK_PREFIXES)
    return F.regexp_replace(normalized, f"^(?:{prefixes})", "")


def strip_parentheses(normalized):
    text = strip(F.regexp_replace(normalized, r"\s*\([^)]*\)\s*", " "))
    return F.btrim(text, F.lit(" ,-—"))


def tokens_of(cleaned):
    """Comma tokens without trailing junk words and without empty ones."""
    junk = r"(?:(?:^|\s+)" + alternation(fixed.JUNK_WORDS) + r")+$"
    parts = F.transform(F.split(cleaned, ","), lambda t: F.regexp_replace(squeeze(t), junk, ""))
    return F.filter(parts, lambda t: t != "")


def drop_repeats(tokens):
    """Remove tokens equal to the one before them."""
    return F.filter(tokens, lambda t, i: (i == 0) | (t != F.get(tokens, i - 1)))


def split_city_state(tokens):
    """``[austin tx]`` becomes ``[austin, tx]``; anything else stays."""
    words = F.split(F.get(tokens, F.lit(0)), " ")
    last = F.element_at(words, -1)
    splits = (F.size(tokens) == 1) & (F.size(words) >= 2) & is_one_of(fixed.US_STATES, last)
    city = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.when(splits, F.array(city, last)).otherwise(tokens)


def last_match(tokens, mapping):
    """Position of the right-most token found in ``mapping``; null for single tokens."""
    spots = F.transform(tokens, lambda t, i: F.when(is_one_of(mapping, t), i))
    return F.when(F.size(tokens) > 1, F.array_max(F.filter(spots, lambda i: i.isNotNull())))


def without(tokens, position):
    return F.when(position.isNull(), tokens).otherwise(F.filter(tokens, lambda t, i: i != position))


def city_alias(city):
    return F.coalesce(lookup(fixed.CITY_ALIASES, city), city)


def parse_locations(df, location="location"):
    """Add ``geo_remote, geo_city, geo_admin, geo_country`` parsed from ``location``.

    The steps are separate projections so that no step's expression is repeated.
    """
    c = F.col
    step = df.withColumn("_n", normalize(c(location)))
    step = step.withColumn("_garbage", is_garbage(c("_n"))).withColumn(
        "geo_remote", ~c("_garbage") & (mentions_remote(c("_n")) | mentions_time_zone(c("_n")))
    )
    step = step.withColumn(
        "_t",
        F.when(
            ~c("_garbage") & ~c("geo_remote"),
            drop_repeats(tokens_of(strip_parentheses(strip_work_arrangement(c("_n"))))),
        ).otherwise(F.array().cast("array<string>")),
    )
    step = step.withColumn("_alias", lookup(fixed.CITY_ALIASES, F.array_join(c("_t"), " ")))
    step = step.withColumn("_t", split_city_state(c("_t")))
    step = step.withColumn(
        "_bare",
        F.when(F.size("_t") == 1, lookup(fixed.COUNTRY_ALIASES, F.get(c("_t"), F.lit(0)))),
    )
    step = step.withColumn("_at", last_match(c("_t"), fixed.COUNTRY_ALIASES))
    step = step.withColumn("_country", lookup(fixed.COUNTRY_ALIASES, F.get(c("_t"), c("_at"))))
    step = step.withColumn("_t", without(c("_t"), c("_at")))
    step = step.withColumn(
        "_at",
        F.when(
            c("_country").isNull() | (c("_country") == "US"), last_match(c("_t"), fixed.US_STATES)
        ),
    )
    step = step.withColumn("_state", lookup(fixed.US_STATES, F.get(c("_t"), c("_at"))))
    step = step.withColumn("_t", without(c("_t"), c("_at")))
    size = F.size("_t")
    takes_admin = c("_state").isNull() & (size >= 2)
    city = F.when(
        takes_admin, F.array_join(F.slice(c("_t"), F.lit(1), F.greatest(size - 1, F.lit(0))), " ")
    ).otherwise(F.get(c("_t"), F.lit(0)))
    admin = F.when(takes_admin, F.element_at(c("_t"), -1)).otherwise(c("_state"))
    country = F.when(c("_state").isNotNull(), F.coalesce(c("_country"), F.lit("US"))).otherwise(c("_country"))
    step = step.withColumns({"geo_city": city, "geo_admin": admin, "geo_country": country})
    by_alias, by_country = c("_alias").isNotNull(), c("_bare").isNotNull()
    step = step.withColumns({
        "geo_city": F.when(by_alias, c("_alias")).when(~by_country, city_alias(non_empty(c("geo_city")))),
        "geo_admin": F.when(~by_alias & ~by_country, c("geo_admin")),
        "geo_country": F.when(by_alias, F.lit(None).cast("string"))
        .when(by_country, c("_bare")).otherwise(c("geo_country")),
    })
    return step.drop("_n", "_garbage", "_t", "_alias", "_bare", "_at", "_country", "_state")


def lookup_city(city, admin):
    """New York boroughs count as the city when the state is given."""
    return F.when(
        city.isin(fixed.NYC_BOROUGHS) & (admin == "ny"), F.lit("new york city")
    ).otherwise(city)


def famous_country(city):
    return lookup(fixed.FAMOUS_CITIES, city)

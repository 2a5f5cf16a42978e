"""SQL texts for DuckDB that state the expected results independently of Spark."""

from vacantia import fixed_values as fixed
from vacantia.plans import sample_tables as sample

KEYS = ", ".join(sample.ORDER)
AS_OF = f"TIMESTAMP '{sample.AS_OF} 12:00:00'"
TODAY = f"DATE '{sample.AS_OF}'"
P = f"WITH p AS ({sample.as_sql(sample.POSTINGS, 'lineitem')})"


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def in_list(values):
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def escape(text):
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)


def any_of(text, values):
    return "(" + " OR ".join(f"contains({text}, {quoted(v)})" for v in values) + ")"


def bounded(text, values):
    pattern = r"\b(?:" + "|".join(escape(v) for v in values) + r")\b"
    return f"regexp_matches({text}, {quoted(pattern)}, 'i')"


def tier(title):
    # RE2 has no look-ahead: this is the same test for "I" and "1"
    patterns = [
        (p.replace(r"\b(?!\s*-|\d)", r"\b(?:\s*[^\s-]|\s*$)"), w) for p, w in fixed.TIER_WEIGHTS
    ]
    score = " + ".join(
        f"CASE WHEN regexp_matches(lower(coalesce({title}, '')), {quoted(p)}) THEN {w} ELSE 0 END" for p, w in patterns
    )
    return f"(CASE WHEN {score} <= -50 THEN 'intern' WHEN {score} <= -5 THEN 'entry' WHEN {score} >= 15 THEN 'senior' ELSE 'mid' END)"


def recruiter(slug):
    return any_of(f"lower({slug})", fixed.RECRUITER_TERMS)


def job_id(platform, company, raw):
    return f"substr(sha1(lower({platform}) || ':' || {company} || ':' || {raw}), 1, 16)"


def posting_key(p="p"):
    number = f"regexp_extract({p}.url, '/jobs/(\\d+)', 1)"
    return (
        f"(CASE WHEN {p}.ats = 'Workday' AND {number} <> '' THEN 'workday:' || {p}.company || ':' || {number} "
        f"ELSE nullif({p}.url, '') END)"
    )


def age_days(stamp):
    return f"CAST(floor((epoch({AS_OF}) - epoch(TRY_CAST(replace(replace({stamp}, 'T', ' '), 'Z', '') AS TIMESTAMP))) / 86400) AS BIGINT)"


def fresh(stamp):
    return f"coalesce({age_days(stamp)} <= 30, true)"


def clean_reason(p="p"):
    return (
        f"(CASE WHEN lower(trim(coalesce({p}.title, ''))) IN ('', 'not specified', 'n/a', 'unknown') THEN 'no_title' "
        f"WHEN coalesce({p}.url, '') = '' THEN 'no_url' WHEN coalesce({p}.company, '') = '' THEN 'no_company' END)"
    )


def location_ok(location):
    text = f"lower(trim(coalesce({location}, '')))"
    return (
        f"(CASE WHEN {text} IN {in_list(fixed.BLANK_LOCATIONS)} THEN false WHEN {any_of(text, fixed.EXCLUDED_COUNTRIES)} "
        f"THEN false ELSE {any_of(text, fixed.ALLOWED_LOCATIONS)} OR regexp_matches({text}, ',\\s*fl\\b') OR "
        f"{text} IN {in_list(fixed.ALLOWED_BARE_LOCATIONS)} END)"
    )


def wanted(title):
    return bounded(title, fixed.TARGET_PHRASES)


def unwanted(title):
    return bounded(title, fixed.EXCLUSION_PHRASES)


def icims_location(loc, company, remote):
    slug = f"replace(lower({company}), ' ', '-')"
    starts = " OR ".join(f"starts_with({slug}, {quoted(x)})" for x in fixed.ICIMS_INTL_PREFIXES)
    part = lambda i: f"coalesce(split_part({loc}, '-', {i}), '')"
    return (
        f"(CASE WHEN lower({loc}) IN {in_list(fixed.BLANK_LOCATIONS)} THEN CASE WHEN {starts} THEN '' WHEN {remote} "
        f"THEN 'Remote' ELSE 'United States' END WHEN regexp_matches({loc}, '^[A-Za-z]{{2}}-') THEN CASE WHEN "
        f"upper(left({loc}, 2)) <> 'US' THEN '' WHEN {remote} THEN 'Remote' WHEN upper({part(2)}) <> 'FL' THEN '' "
        f"WHEN {part(3)} <> '' THEN {part(3)} || ', FL' ELSE 'Florida' END ELSE {loc} END)"
    )


# slim postings: tier and recruiter flag added
SLIM = P + f", s AS (SELECT *, {tier('title')} AS skill_level, {recruiter('company')} AS is_recruiter FROM p)"

# alert rows
ALERT = SLIM + f""", a AS (
    SELECT {KEYS}, trim(title) AS title, trim(company) AS company, trim(url) AS application_url,
           ats AS platform_source, skill_level, is_recruiter,
           CASE WHEN ats = 'iCIMS' THEN {icims_location("location", "company", "remote")} ELSE location END AS location,
           replace(lower(trim(company)), ' ', '-') AS company_slug,
           {job_id('ats', 'trim(company)', 'trim(url)')} AS job_id
    FROM s WHERE trim(coalesce(url, '')) <> '' AND trim(coalesce(title, '')) <> '' AND trim(company) <> '')"""
KEPT = f"(NOT {unwanted('title')} AND {wanted('title')} AND {location_ok('location')})"

"""Queries over locations, the gazetteer and salaries."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions import geo
from vacantia.functions.money import parse_salary
from vacantia.functions.text import lookup
from vacantia.operators import enrich, facets
from vacantia.plans import oracle_parts as sql
from vacantia.plans import sample_tables as sample
from vacantia.plans.registry import query
from vacantia.session import scratch_path

P, SLIM, KEYS = sql.P, sql.SLIM, sql.KEYS
ORD = sample.ORDER
c = F.col


def _normal(text):
    """Location normalisation as SQL."""
    text = f"replace(replace(replace(strip_accents({text}), '.', ''), '''', ''), '`', '')"
    text = f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))"
    text = f"replace(CASE WHEN starts_with({text}, 'saint ') THEN 'st ' || substr({text}, 7) ELSE {text} END, ' saint ', ' st ')"
    text = f"' ' || {text} || ' '"
    for short, full in fixed.WORD_EXPANSIONS:
        text = f"replace({text}, ' {short} ', ' {full} ')"
    return f"trim({text})"


N = P + f", n AS (SELECT *, {_normal('location')} AS norm FROM p)"
_REMOTE = f"({sql.any_of('norm', fixed.REMOTE_WORDS)} OR {sql.any_of('norm', fixed.TIME_ZONE_WORDS)})"
_GARBAGE = f"norm IN {sql.in_list(fixed.GARBAGE_LOCATIONS)}"


def norms(spark, sf):
    return sample.postings(spark, sf).withColumn("norm", geo.normalize(c("location")))


@query("g01_normalize", f"SELECT doc_id, md5({_normal('text')}) AS digest FROM documents")
def g01(spark, sf):
    return sample.table(spark, sf, "documents").select("doc_id", F.md5(geo.normalize(c("text"))).alias("digest"))


@query("g02_garbage", N + f" SELECT {KEYS} FROM n WHERE {_GARBAGE}")
def g02(spark, sf):
    return norms(spark, sf).filter(geo.is_garbage(c("norm"))).select(*ORD)


@query("g03_remote_words", N + f" SELECT {KEYS}, {sql.any_of('norm', fixed.REMOTE_WORDS)} AS word, {sql.any_of('norm', fixed.TIME_ZONE_WORDS)} AS zone FROM n")
def g03(spark, sf):
    return norms(spark, sf).select(
        *ORD, geo.mentions_remote(c("norm")).alias("word"), geo.mentions_time_zone(c("norm")).alias("zone"))


@query("g15_is_remote", N + f" SELECT {KEYS}, (NOT {_GARBAGE} AND {sql.any_of('norm', fixed.REMOTE_WORDS)}) AS remote FROM n")
def g15(spark, sf):
    return sample.postings(spark, sf).select(*ORD, geo.is_remote(c("location")).alias("remote"))


_CUT = "regexp_replace(norm, '^(?:" + "|".join(p.replace("-", "\\-") for p in fixed.WORK_PREFIXES) + ")', '')"
_BARE = f"trim(trim(regexp_replace({_CUT}, '\\s*\\([^)]*\\)\\s*', ' ', 'g')), ' ,-—')"


@query("g04_work_prefix", N + f" SELECT {KEYS}, {_CUT} AS rest FROM n")
def g04(spark, sf):
    return norms(spark, sf).select(*ORD, geo.strip_work_arrangement(c("norm")).alias("rest"))


@query("g05_parentheses", N + f" SELECT {KEYS}, {_BARE} AS bare FROM n")
def g05(spark, sf):
    return norms(spark, sf).select(*ORD, geo.strip_parentheses(geo.strip_work_arrangement(c("norm"))).alias("bare"))


_JUNK = "(?:(?:^|\\s+)(?:" + "|".join(fixed.JUNK_WORDS) + "))+$"
_TOKENS = (f"list_filter(list_transform(string_split({_BARE}, ','), lambda t: regexp_replace(trim(t), '{_JUNK}', '')), lambda t: t <> '')")


@query("g06_tokens", N + f" SELECT {KEYS}, array_to_string({_TOKENS}, '|') AS tokens FROM n")
def g06(spark, sf):
    tokens = geo.tokens_of(geo.strip_parentheses(geo.strip_work_arrangement(c("norm"))))
    return norms(spark, sf).select(*ORD, F.array_join(tokens, "|").alias("tokens"))


@query("w05_repeated_tokens", N + f""", t AS (SELECT {KEYS}, {_TOKENS} AS t FROM n)
    SELECT {KEYS}, array_to_string(list_filter(t, lambda x, i: i = 1 OR x <> t[i - 1]), '|') AS tokens FROM t""")
def w05(spark, sf):
    tokens = geo.tokens_of(geo.strip_parentheses(geo.strip_work_arrangement(c("norm"))))
    rows = norms(spark, sf).select(*ORD, tokens.alias("t"))
    return rows.select(*ORD, F.array_join(geo.drop_repeats(c("t")), "|").alias("tokens"))


_T = N + f""", r AS (SELECT {KEYS}, {_TOKENS} AS r FROM n), t AS (SELECT {KEYS}, list_filter(r, lambda x, i: i = 1 OR x <> r[i - 1]) AS t FROM r),
    w AS (SELECT *, string_split(coalesce(t[1], ''), ' ') AS w FROM t)"""
_NATIONS = "[" + ", ".join(sql.quoted(x) for x in fixed.COUNTRY_ALIASES) + "]"
_NATION_CODES = "[" + ", ".join(sql.quoted(x) for x in fixed.COUNTRY_ALIASES.values()) + "]"
_STATES = "[" + ", ".join(sql.quoted(x) for x in fixed.US_STATES) + "]"


def tokens(spark, sf):
    cut = geo.tokens_of(geo.strip_parentheses(geo.strip_work_arrangement(c("norm"))))
    return norms(spark, sf).select(*ORD, cut.alias("r")).select(*ORD, geo.drop_repeats(c("r")).alias("t"))


@query("g08_city_state", _T + f""" SELECT {KEYS}, CASE WHEN len(t) = 1 AND len(w) >= 2 AND list_contains({_STATES}, w[len(w)])
    THEN array_to_string(w[1:len(w) - 1], ' ') || '|' || w[len(w)] ELSE array_to_string(t, '|') END AS tokens FROM w""")
def g08(spark, sf):
    return tokens(spark, sf).select(*ORD, F.array_join(geo.split_city_state(c("t")), "|").alias("tokens"))


@query("g09_bare_country", _T + f" SELECT {KEYS}, CASE WHEN len(t) = 1 THEN {_NATION_CODES}[list_position({_NATIONS}, t[1])] END AS country FROM w")
def g09(spark, sf):
    bare = F.when(F.size("t") == 1, lookup(fixed.COUNTRY_ALIASES, F.get(c("t"), F.lit(0))))
    return tokens(spark, sf).select(*ORD, bare.alias("country"))


@query("g10_country", _T + f""", m AS (SELECT *, CASE WHEN len(t) > 1 THEN list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_contains({_NATIONS}, t[i]) THEN i END)) END AS spot FROM w)
    SELECT {KEYS}, {_NATION_CODES}[list_position({_NATIONS}, t[spot])] AS country,
    array_to_string(CASE WHEN spot IS NULL THEN t ELSE list_filter(t, lambda x, i: i <> spot) END, '|') AS rest FROM m""")
def g10(spark, sf):
    rows = tokens(spark, sf).withColumn("at", geo.last_match(c("t"), fixed.COUNTRY_ALIASES))
    country = lookup(fixed.COUNTRY_ALIASES, F.get(c("t"), c("at")))
    return rows.select(*ORD, country.alias("country"), F.array_join(geo.without(c("t"), c("at")), "|").alias("rest"))


def _values(rows):
    def text(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else sql.quoted(v) if isinstance(v, str) else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows) + ")"


# expected parse, read off the rules by hand: location, remote, city, admin, country, gazetteer city
EXPECTED = [
    ("Remote", True, None, None, None, None), ("Miami, FL", False, "miami", "FL", "US", "Miami"),
    ("Milwaukee, WI (Remote)", True, None, None, None, None), ("China-Remote Location-Beijing", True, None, None, None, None),
    ("Bozeman, MT", False, "bozeman", "mount", None, "Bozeman"), ("US", False, None, None, "US", None),
    ("", False, None, None, None, None), ("San Francisco, CA", False, "san francisco", "CA", "US", "San Francisco"),
    ("New York, NY", False, "new york city", "NY", "US", "New York City"), ("Brooklyn, NY", False, "brooklyn", "NY", "US", "New York City"),
    ("New York", False, "new york city", None, None, "New York City"), ("Hybrid - Austin TX", False, "austin", "TX", "US", "Austin"),
    ("Austin HQ, TX", False, "austin", "TX", "US", "Austin"), ("Saint Louis, MO", False, "st louis", "MO", "US", "St. Louis"),
    ("Ft Worth, TX", False, "fort worth", "TX", "US", "Fort Worth"), ("London", False, "london", None, None, "London"),
    ("Berlin, Germany", False, "berlin", None, "DE", "Berlin"), ("Toronto, ON, Canada", False, "toronto", "on", "CA", "Toronto"),
    ("Little Rock, AR", False, "little rock", None, "AR", "Little Rock"), ("Bozeman, Montana", False, "bozeman", "MT", "US", "Bozeman"),
    ("Remote - US", True, None, None, None, None), ("EST time zone", True, None, None, None, None), ("3 Locations", False, None, None, None, None),
    ("Not specified", False, None, None, None, None), ("United States", False, None, None, "US", None),
    ("Jacksonville, FL", False, "jacksonville", "FL", "US", "Jacksonville"),
    ("Spring, Texas, United States of America", False, "spring", "TX", "US", "Spring"), ("Indianapolis, IN (Remote)", True, None, None, None, None),
    ("US-FL-Miami", False, "us-fl-miami", None, None, None), ("US-CA-Valencia", False, "us-ca-valencia", None, None, None),
    ("LB-Beirut", False, "lb-beirut", None, None, None), ("SF Bay Area", False, "sf bay", None, None, None),
    ("Hybrid in London", False, "london", None, None, "London"), ("St. Louis (HQ), MO", False, "st louis", "MO", "US", "St. Louis"),
    ("Orlando, Florida", False, "orlando", "FL", "US", "Orlando"), ("Austin, Austin, TX", False, "austin", "TX", "US", "Austin"),
    ("Anywhere", True, None, None, None, None), ("Toronto", False, "toronto", None, None, "Toronto"),
    ("Nowhere Town, ZZ", False, "nowhere town", "zz", None, None), ("Work From Home", True, None, None, None, None),
]
EXPECTED_SQL = f"""{_values(EXPECTED)} AS e(location, remote, city, admin, country, hit)"""
GAZETTEER_SQL = f"(SELECT city, CAST(arg_min(lat, pos) AS DOUBLE) AS lat, CAST(arg_min(lng, pos) AS DOUBLE) AS lng FROM {_values([(i, *r) for i, r in enumerate(sample.GAZETTEER)])} AS g(pos, city, admin, country, lat, lng) GROUP BY city)"


@query("g07_g11_parse", P + f""" SELECT {KEYS}, e.remote AS geo_remote, e.city AS geo_city, e.admin AS geo_admin, e.country AS geo_country
    FROM p JOIN {EXPECTED_SQL} ON p.location = e.location""")
def g07(spark, sf):
    rows = sample.postings(spark, sf)
    parsed = geo.parse_locations(rows.select("location").distinct())
    return rows.join(parsed, "location").select(*ORD, "geo_remote", "geo_city", "geo_admin", "geo_country")


@query("j02_geocode", P + f""" SELECT {KEYS}, e.remote, g.lat, g.lng FROM p JOIN {EXPECTED_SQL} ON p.location = e.location
    LEFT JOIN {GAZETTEER_SQL} g ON g.city = e.hit""")
def j02(spark, sf):
    rows = enrich.geocode(sample.postings(spark, sf), sample.gazetteer(spark))
    return rows.select(*ORD, "remote", "coords.lat", "coords.lng")


_CITY = "(CASE WHEN c_nationkey = 3 THEN ' ' ELSE 'Saint City ' || CAST(c_nationkey AS STRING) END)"
_ADMIN = "(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'A' || CAST(c_custkey % 7 AS STRING) END)"
_NATION = "(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'C' || CAST(c_custkey % 3 AS STRING) END)"
_GAZ = f"SELECT c_custkey AS pos, {_CITY} AS city, {_ADMIN} AS admin, {_NATION} AS country, c_acctbal AS lat, -c_acctbal AS lng FROM customer"
_FIRST_KEYS = f"""WITH g AS (SELECT pos, lat, 'st city ' || substr(city, 12) AS city, lower(admin) AS admin, nullif(country, '') AS country FROM ({_GAZ}) WHERE trim(city) <> ''),
    k AS (SELECT pos, lat, 'cac|' || city || '|' || admin || '|' || country AS key FROM g UNION ALL SELECT pos, lat, 'cc|' || city || '|' || country FROM g
    UNION ALL SELECT pos, lat, 'ca|' || city || '|' || admin FROM g UNION ALL SELECT pos, lat, 'c|' || city FROM g)"""


def customer_gazetteer(spark, sf):
    return sample.table(spark, sf, "customer").selectExpr(
        "c_custkey AS pos", f"{_CITY} AS city", f"{_ADMIN} AS admin", f"{_NATION} AS country", "c_acctbal AS lat", "-c_acctbal AS lng")


@query("j03_gazetteer_keys", _FIRST_KEYS + " SELECT key, arg_min(lat, pos) AS lat FROM k WHERE key IS NOT NULL GROUP BY key")
def j03(spark, sf):
    return enrich.gazetteer_keys(customer_gazetteer(spark, sf)).select("key", "coords.lat")


@query("w03_first_gazetteer_row", _FIRST_KEYS + " SELECT key, lat FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS rn FROM k WHERE key IS NOT NULL) WHERE rn = 1")
def w03(spark, sf):
    return enrich.gazetteer_keys(customer_gazetteer(spark, sf)).select("key", "coords.lat")


@query("g13_g14_lookup_city", P + f""" SELECT {KEYS}, CASE WHEN e.city IN {sql.in_list(fixed.NYC_BOROUGHS)} AND lower(e.admin) = 'ny' THEN 'new york city' ELSE e.city END AS city,
    CASE e.city WHEN 'london' THEN 'GB' WHEN 'san francisco' THEN 'US' WHEN 'berlin' THEN 'DE' WHEN 'toronto' THEN 'CA' END AS famous
    FROM p JOIN {EXPECTED_SQL} ON p.location = e.location""")
def g13(spark, sf):
    rows = sample.postings(spark, sf)
    parsed = geo.parse_locations(rows.select("location").distinct()).select(
        "location", geo.lookup_city(c("geo_city"), F.lower("geo_admin")).alias("city"), geo.famous_country(c("geo_city")).alias("famous"))
    return rows.join(parsed, "location").select(*ORD, "city", "famous")


# ---- salaries -------------------------------------------------------------------
_OWN = "lower(trim(company)) || '|' || lower(trim(coalesce(title, ''))) || '|' || skill_level"
_TITLE = "lower(trim(coalesce(title, ''))) || '|' || skill_level"
_QUART = ("CAST(round(quantile_cont(amount, 0.25)) AS BIGINT) AS p25, CAST(round(quantile_cont(amount, 0.5)) AS BIGINT) AS median, "
          "CAST(round(quantile_cont(amount, 0.75)) AS BIGINT) AS p75, count(*) AS n")
TABLES = SLIM + f""", own AS (SELECT {_OWN} AS key, {_QUART} FROM s GROUP BY 1 HAVING count(*) >= 5),
    tit AS (SELECT {_TITLE} AS key, {_QUART} FROM s GROUP BY 1 HAVING count(*) >= 5)"""


def salary_tables(spark, sf):
    """Salary tables of both tiers; the samples are classified once and stored."""
    samples = sample.slim_postings(spark, sf).select("company", "title", "skill_level", "amount")
    path = scratch_path(spark, "samples")
    samples.write.parquet(path)
    samples = spark.read.schema(samples.schema).parquet(path)
    return enrich.salary_table(samples), enrich.salary_table(samples, "fallback")


@query("a10_salary_table", TABLES + " SELECT 'primary' AS tier, * FROM own UNION ALL SELECT 'fallback', * FROM tit")
def a10(spark, sf):
    own, title = salary_tables(spark, sf)
    rows = own.withColumn("tier", F.lit("primary")).unionByName(title.withColumn("tier", F.lit("fallback")))
    return rows.select("tier", "key", "salary.*")


@query("j01_salary", TABLES + f""" SELECT {KEYS}, coalesce(own.median, tit.median) AS median, coalesce(own.n, tit.n) AS n FROM s
    LEFT JOIN own ON own.key = {_OWN} LEFT JOIN tit ON tit.key = {_TITLE}""")
def j01(spark, sf):
    own, title = salary_tables(spark, sf)
    rows = enrich.with_salary(sample.slim_postings(spark, sf), own, title)
    return rows.select(*ORD, "salary.median", "salary.n")


@query("k11_salary_shards", TABLES + " SELECT lower(left(key, 1)) AS initial, count(*) AS n FROM own GROUP BY 1")
def k11(spark, sf):
    from vacantia.sinks.files import with_initial

    return with_initial(salary_tables(spark, sf)[0]).groupBy("initial").agg(F.count("*").alias("n"))


_SAL = ("(CASE l_partkey % 6 WHEN 0 THEN '$' || CAST(l_orderkey AS STRING) || 'k - $' || CAST(l_orderkey + 5 AS STRING) || 'K' "
        "WHEN 1 THEN '$40.5/hr' WHEN 2 THEN '$1,200,000' WHEN 3 THEN 'competitive' WHEN 4 THEN '' ELSE '30-45.25 / hr' END)")


@query("p15_parse_salary", P + f""", t AS (SELECT {KEYS}, {_SAL} AS text FROM p)
    SELECT {KEYS}, CAST(CASE l_partkey % 6 WHEN 0 THEN l_orderkey * 1000 WHEN 1 THEN 40.5 * 2080 WHEN 2 THEN 1200000 WHEN 5 THEN 30 END AS DOUBLE) AS lo,
    CAST(CASE l_partkey % 6 WHEN 0 THEN (l_orderkey + 5) * 1000 WHEN 1 THEN 40.5 * 2080 WHEN 2 THEN 1200000 WHEN 5 THEN 45.25 END AS DOUBLE) AS hi FROM t""")
def p15(spark, sf):
    rows = sample.postings(spark, sf).selectExpr(*ORD, f"{_SAL} AS text")
    parsed = parse_salary(c("text"))
    return rows.select(*ORD, parsed["min"].alias("lo"), parsed["max"].alias("hi"))


# ---- map ------------------------------------------------------------------------
_PLAIN = "regexp_replace(CAST(CAST({} AS DECIMAL(24, 12)) AS VARCHAR), '\\.?0+$', '')"


@query("a08_heatmap", P + f""", h AS (SELECT lat, lng, count(*) AS n, {_PLAIN.format('lat')} || ',' || {_PLAIN.format('lng')} AS key FROM p WHERE lat IS NOT NULL GROUP BY ALL HAVING count(*) >= 75),
    k AS (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(unicode(x) AS BIGINT))),
          lambda a, b: ((a * 31 + b + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM h)
    SELECT round(lat + ((h & 65535) / 65535.0 - 0.5) * 0.02, 7) AS lat, round(lng + (((h >> 16) & 65535) / 65535.0 - 0.5) * 0.02, 7) AS lng, n FROM k""")
def a08(spark, sf):
    cells = facets.heatmap(sample.slim_postings(spark, sf))
    return cells.select(F.round("lat", 7).alias("lat"), F.round("lng", 7).alias("lng"), "n")


@query("f19_viewport", P + f" SELECT {KEYS} FROM p WHERE lat BETWEEN 30 AND 45 AND lng BETWEEN -99 AND -95")
def f19(spark, sf):
    return sample.slim_postings(spark, sf).filter(facets.in_viewport(30, -99, 45, -95)).select(*ORD)


@query("w04_map_markers", P + f""", v AS (SELECT *, lower(left(company, 1)) AS initial FROM p WHERE lat BETWEEN 30 AND 60 AND lng BETWEEN -101 AND -95 AND company <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY initial ORDER BY {KEYS}) AS rn FROM v)
    SELECT initial, company, url, median FROM r WHERE rn = 1""")
def w04(spark, sf):
    rows = facets.map_markers(sample.slim_postings(spark, sf), (30, -101, 60, -95), ORD)
    return rows.select("initial", "company", "url", "salary.median")

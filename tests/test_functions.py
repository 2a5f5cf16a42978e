import datetime as dt
import random
import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions import classify, dates, display, geo, money, pages, text

AS_OF = "2026-06-14 12:00:00"


def test_tier(column):
    titles = {
        "Software Engineer I": "entry", "Software Engineer II": "mid", "Member of Technical Staff": "senior",
        "Software Engineering Intern": "intern", "Director Intern Program": "intern", "Associate Director": "senior",
        "Junior Architect": "entry", "Graduate Trainee": "entry", "Analyst 1 - 2": "mid", "Accountant": "mid", None: "mid",
    }
    assert column(lambda F: classify.tier(F.col("x")), list(titles)) == list(titles.values())


def test_tier_score_counts_each_pattern_once(column):
    assert column(lambda F: classify.tier_score(F.col("x")), ["graduate trainee", "director intern", "nothing"]) == [-25, -50, 0]


def test_tier_score_equals_its_patterns(spark):
    rnd = random.Random(3)
    words = [w for both in fixed.TIER_WORDS for w in " ".join(both).split()] + ["vice president", "head of", "of", "grad", "3", "5", "é", "İ", "_", "fellow", "it"]
    ends = [" ", " ", "-", "", ".", ", ", "\u00a0", "–", "\t", "/", "\x85", "1", " - "]
    titles = [("".join(rnd.choice([str, str.upper])(rnd.choice(words)) + rnd.choice(ends) for _ in range(rnd.randint(0, 5))),) for _ in range(3000)]
    low = F.lower(F.coalesce("t", F.lit("")))
    plain = sum((F.when(low.rlike("(?U)" + p), w).otherwise(0) for p, w in fixed.TIER_WEIGHTS), F.lit(0))
    rows = spark.createDataFrame([*titles, (None,)], "t string").select("t", classify.tier_score(F.col("t")).alias("got"), plain.alias("want"))
    assert rows.filter("NOT got <=> want").collect() == [] and rows.select("want").distinct().count() > 20


def test_recruiter(column):
    got = column(lambda F: classify.is_recruiter(F.col("x")), ["acme-staffing", "researchlabs", "vultr", None])
    assert got == [True, True, False, False]


def test_real_company(column):
    got = column(lambda F: classify.is_real_company(F.col("x")), ["123", "DEADBEEF", "abcdef1", "acme", "", None])
    assert got == [False, False, True, True, False, False]


def test_posting_key(column):
    rows = [
        ("Workday", "c", "https://h/jobs/123-x"), ("Workday", "c", "https://h/job/x_R1"), ("Lever", "c", "https://h/jobs/9"),
        ("Lever", "c", ""), ("Workday", None, "https://h/jobs/5"), ("Lever", "c", None),
    ]
    got = column(lambda F: classify.posting_key(F.col("a"), F.col("c"), F.col("u")), rows, "a string, c string, u string")
    assert got == ["workday:c:123", "https://h/job/x_R1", "https://h/jobs/9", None, "workday::5", None]


def test_phrases_are_bounded_by_words(column):
    got = column(lambda F: text.has_phrase(F.col("x"), ["it director", "director of it,"]),
                 ["IT Director", "pursuit director", "Director of IT,x", "Director of IT, x"])
    assert got == [True, False, True, False]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab,. -", min_size=1, max_size=5), min_size=1, max_size=6), st.text("ab,. -", max_size=12))
def test_alternation_equals_plain_search(phrases, subject):
    assert bool(re.search(text.alternation(phrases), subject)) == any(p in subject for p in phrases)


def test_title_case_and_decoding(column):
    got = column(lambda F: text.title_case(F.col("x")), ["o'neil's 2nd-shift", "ABC def"])
    assert got == ["O'Neil'S 2Nd-Shift", "Abc Def"]
    assert column(lambda F: text.percent_decode(F.col("x")), ["a%20b+c", "bad%zz"]) == ["a b+c", "bad%zz"]


def test_accents_follow_unicode_decomposition(column):
    words = ["São Paulo", "Zürich", "Łódź", "Nguyễn", "été", "Ålesund", "Sète", "Ἀθῆναι"]

    def strip(s):
        return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")

    assert column(lambda F: geo.strip_accents(F.col("x")), words) == [strip(w) for w in words]


def test_normalize(column):
    cases = {
        "  St. Louis ": "st louis", "Saint Paul": "st paul", "Port Saint Lucie": "port st lucie", "N Charleston": "north charleston",
        "Bozeman, MT": "bozeman, mount", "Bozeman,MT": "bozeman,mt", "Coeur d'Alene": "coeur dalene", None: "",
        "S. Ft. Worth": "south fort worth",
    }
    assert column(lambda F: geo.normalize(F.col("x")), list(cases)) == list(cases.values())


def test_dates(column):
    def in_text(F):
        return dates.date_in_text(F.col("x"), F.lit(AS_OF).cast("timestamp"))

    cases = {
        "Posted 7 days ago": "2026-06-07", "Posted on June 4, 2026": "2026-06-04", "Posted: 06/04/2026": "2026-06-04",
        "400 days ago": None, "400 days ago, posted 2026-01-02": "2026-01-02", "posted Sept 4, 2026": None,
    }
    assert column(in_text, list(cases)) == list(cases.values())


def test_salary_texts(column):
    cases = {
        "Salary range: $95k - $130k": "$95,000 – $130,000", "$130,000 - $95,000 per year": "$95,000 – $130,000",
        "Compensation $120,000": "$120,000", "Wage $30 - $40 an hour": "$30,000 – $40,000", "Salary $5,000": None,
        "Raised $50,000,000": None, "no money": None, None: None, "Salary $1 then $60,000": "$60,000",
        "$80,000/yr": "$80,000", "pay range " + "x" * 420 + " $90,000": None,
    }
    assert column(lambda F: money.salary_text(F.col("x")), list(cases)) == list(cases.values())


def test_parse_salary(column):
    got = column(lambda F: money.parse_salary(F.col("x")), ["$95k - $130k", "$40/hr", "", None, "n/a"])
    assert [(r.min, r.max) if r else None for r in got] == [(95000, 130000), (83200, 83200), None, None, None]


def test_json_ld(column):
    def page(body):
        return f'<script type="application/ld+json">{body}</script>'

    def html(*fields):
        return page('{"@type":"JobPosting",' + ",".join(fields) + "}")

    cases = [
        (html('"validThrough":"2026-06-13"'), True), (html('"validThrough":"2026-06-14"'), False),
        (page("not json") + html('"validThrough":"2020-01-01"'), True), (page('{"@type":"Thing","validThrough":"2020-01-01"}'), False),
    ]
    got = column(lambda F: pages.json_ld_expired(pages.json_ld(F.col("x")), F.lit(AS_OF).cast("timestamp")), [h for h, _ in cases])
    assert got == [want for _, want in cases]
    places = [
        ('"jobLocation":{"address":{"addressLocality":"Berlin","addressCountry":"DE"}}', "Berlin, DE"),
        ('"jobLocation":[{"address":{"addressLocality":"Miami","addressRegion":"FL"}}]', "Miami, FL"),
        ('"jobLocation":{"address":{"addressRegion":"TX"}},"jobLocationType":"TELECOMMUTE remote"', "Remote"),
        ('"jobLocation":{"address":{"addressCountry":"US"}}', "United States"), ('"title":"x"', None),
    ]
    assert column(lambda F: pages.json_ld_location(pages.json_ld(F.col("x"))), [html(p) for p, _ in places]) == [w for _, w in places]
    pay = [('"baseSalary":{"value":{"minValue":90000}}', "$90,000+"), ('"baseSalary":{"value":90000}', "$90,000"),
           ('"baseSalary":{"value":{"minValue":"90000","maxValue":120000.9}}', "$90,000 – $120,000"), ('"baseSalary":"x"', None)]
    assert column(lambda F: pages.json_ld_salary(pages.json_ld(F.col("x"))), [html(p) for p, _ in pay]) == [w for _, w in pay]


def test_location_excluded(column):
    cases = {"Remote, CA": False, "Austin, TX": True, "Jacksonville, FL": False, "Leeds": True, "United States": False, None: False, "": False}
    assert column(lambda F: pages.location_excluded(F.col("x")), list(cases)) == list(cases.values())


def test_icims_codes(column):
    cases = {"US-FL-Miami": "Florida", "US-TN-Memphis": "US-ONSITE", "LB-Beirut": "INTL:LB", "US-wide LB-Beirut": None,
             "remote: yes": "Remote", "nothing": None}
    assert column(lambda F: pages.icims_code(F.col("x")), list(cases)) == list(cases.values())


def test_display(column):
    assert column(lambda F: display.company_display(F.col("x")), ["acme-big co", "x2y"]) == ["Acme Big Co", "X2y"]
    assert column(lambda F: display.coordinate_key(F.col("a"), F.col("b")), [(40.0, -97.5), (0.0, 100.0)], "a double, b double") == ["40,-97.5", "0,100"]

    def hash32(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    words = ["30.26715,-97.74306", "a", "zzzzzzzzzzzzzzzzz"]
    assert column(lambda F: display.string_hash(F.col("x")), words) == [hash32(w) for w in words]
    stamp = column(lambda F: display.rfc822(F.col("x")), [dt.datetime(2026, 6, 14, 11, 19, 9)], "x timestamp")
    assert stamp == ["Sun, 14 Jun 2026 11:19:09 +0000"]


def test_fixed_tables_have_their_sizes():
    assert (len(fixed.COUNTRY_ALIASES), len(fixed.US_STATES), len(fixed.CITY_ALIASES)) == (162, 105, 32)
    assert (len(fixed.TARGET_PHRASES), len(fixed.EXCLUSION_PHRASES), len(fixed.EXCLUDED_COUNTRIES)) == (103, 38, 77)

"""Classification and identity columns of a posting."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.text import alternation, bind, has_any, lookup, non_empty


def _tier_bits():
    """Bit of every keyword: that of its pattern, or one of its own where it only begins a match."""
    bits = {w: 1 << at for at, (words, _) in enumerate(fixed.TIER_WORDS) for w in words.split()}
    starts = dict.fromkeys(w for _, words in fixed.TIER_WORDS for w in words.split())
    return bits | {w: 1 << len(fixed.TIER_WORDS) + i for i, w in enumerate(starts)}


_TIER_BITS = _tier_bits()
# the test of the first character spares the search for a word boundary at most places
_TIER_KEYWORD = f"(?U)(?=[{''.join(sorted({w[0] for w in _TIER_BITS}))}])\\b{alternation(_TIER_BITS)}\\b"


def tier_score(title):
    """Sum of the weights of the keyword patterns found in the title.

    One regex finds the keywords, and most of them settle their pattern. A pattern's own regex runs only where a
    word is found that begins one of its longer matches.
    """
    def score(both):
        text, bits = both["text"], both["bits"]

        def has(wanted):
            return bits.bitwiseAND(F.lit(wanted)) != 0

        def found(at, pattern, starts):
            longer = has(sum(_TIER_BITS[w] for w in starts.split())) & text.rlike("(?U)" + pattern)
            return has(1 << at) | longer if starts else has(1 << at)

        each = zip(fixed.TIER_WEIGHTS, fixed.TIER_WORDS, strict=True)
        weights = [F.when(found(at, pattern, starts), F.lit(weight)).otherwise(F.lit(0)) for at, ((pattern, weight), (_, starts)) in enumerate(each)]
        return F.when(bits == 0, F.lit(0)).otherwise(reduce(add, weights))

    def keywords(text):
        found = F.regexp_extract_all(text, F.lit(_TIER_KEYWORD), F.lit(0))
        bits = F.aggregate(found, F.lit(0).cast("bigint"), lambda total, word: total.bitwiseOR(lookup(_TIER_BITS, word).cast("bigint")))
        return F.struct(text.alias("text"), bits.alias("bits"))

    return bind(bind(F.lower(F.coalesce(title, F.lit(""))), keywords), score)


def tier(title):
    """intern / entry / mid / senior by the sum of keyword weights in the title."""
    def name(score):
        return (
            F.when(score <= fixed.INTERN_AT_MOST, F.lit("intern"))
            .when(score <= fixed.ENTRY_AT_MOST, F.lit("entry"))
            .when(score >= fixed.SENIOR_AT_LEAST, F.lit("senior"))
            .otherwise(F.lit("mid"))
        )

    return bind(tier_score(title), name)


def is_recruiter(slug):
    return has_any(F.lower(F.coalesce(slug, F.lit(""))), fixed.RECRUITER_TERMS)


#: Columns that follow from the title and the company of a posting.
CLASSES = ("is_recruiter", "skill_level")


def is_real_company(company):
    """False for ids: all digits, or eight and more hex characters."""
    return F.coalesce(
        (company != "") & ~company.rlike(r"^\d+$") & ~company.rlike(r"(?i)^[a-f0-9]{8,}$"),
        F.lit(False),
    )


def job_id(platform, company, raw_id):
    key = F.concat(F.lower(platform), F.lit(":"), company, F.lit(":"), raw_id)
    return F.substring(F.sha1(key), 1, 16)


def posting_key(ats, company, url):
    """Key under which two rows are the same posting; null when there is none."""
    number = F.regexp_extract(url, r"/jobs/(\d+)", 1)
    return F.when(
        (ats == "Workday") & (number != ""),
        F.concat(F.lit("workday:"), F.coalesce(company, F.lit("")), F.lit(":"), number),
    ).otherwise(non_empty(url))


def company_slug(company):
    return F.replace(F.lower(company), F.lit(" "), F.lit("-"))

"""Salary texts."""

from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.functions.text import bind, non_empty


def _yearly(digits):
    value = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    return bind(value, lambda v: F.when(v < 1000, v * 1000).otherwise(v))


def dollars(value):
    """Whole dollars with separators; null for what is no amount (NaN, beyond 15 digits)."""
    amount = F.when(value.between(-1e15, 1e15), value)
    return F.when(amount.isNotNull(), F.format_string("$%,d", amount.try_cast("bigint")))


def salary_label(low, high):
    """``$low – $high`` or ``$low`` when plausible as a yearly amount, else null."""
    def label(span):
        lo, hi = span["lo"], span["hi"]
        return F.when(
            lo.between(fixed.SALARY_LOW, fixed.SALARY_HIGH),
            F.when(hi.isNull(), dollars(lo)).when(
                F.greatest(lo, hi) <= fixed.SALARY_HIGH,
                F.concat(dollars(F.least(lo, hi)), F.lit(" – "), dollars(F.greatest(lo, hi))),
            ),
        )

    ends = F.struct(_yearly(low).alias("lo"), _yearly(non_empty(high)).alias("hi"))
    return bind(F.when(low != "", ends), label)


def salary_near_labels(text, labels):
    """First plausible amount near the first occurrence of a label, labels in list order."""
    names = F.split(F.lit("|".join(labels)), r"\|")
    spots = bind(F.lower(text), lambda low: F.transform(names, lambda n: F.instr(low, n)))
    around = F.transform(F.filter(spots, lambda at: at > 0), lambda at: _around(text, at))
    amounts = F.flatten(F.transform(around, lambda t: F.regexp_extract_all(t, F.lit(fixed.DOLLARS), F.lit(0))))
    found = F.transform(
        amounts,
        lambda a: salary_label(F.regexp_extract(a, fixed.DOLLARS, 1), F.regexp_extract(a, fixed.DOLLARS, 2)),
    )
    return F.get(F.filter(found, lambda s: s.isNotNull()), F.lit(0))


def _around(text, at):
    start = F.greatest(at - fixed.LABEL_BEFORE, F.lit(1))
    return F.substring(text, start, at + fixed.LABEL_AFTER - start)


def salary_text(text, passes=("range", "single", "label"), labels=None):
    """Yearly salary written in a page text, or null."""
    labels = labels or fixed.SALARY_LABELS
    makers = {
        "range": lambda: salary_label(
            F.regexp_extract(text, fixed.RANGE_A_YEAR, 1), F.regexp_extract(text, fixed.RANGE_A_YEAR, 2)
        ),
        "single": lambda: salary_label(F.regexp_extract(text, fixed.SINGLE_A_YEAR, 1), F.lit("")),
        "label": lambda: salary_near_labels(text, labels),
    }
    return F.when(F.contains(text, F.lit("$")), F.coalesce(*[makers[p]() for p in passes]))


def parse_salary(text):
    """``$95k - $130k`` or ``$40/hr`` to struct(min, max) per year; null when unreadable."""
    cleaned = F.lower(F.trim(F.translate(text, "$,", "")))
    hourly = F.contains(cleaned, F.lit("/hr"))
    ends = F.transform(F.split(F.substring_index(cleaned, "/", 1), "-"), lambda x: F.trim(x))

    def amount(part):
        number = F.regexp_extract(part, r"^([+]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
        return F.when(F.contains(part, F.lit("k")), number * 1000).otherwise(number)

    factor = F.when(hourly, F.lit(fixed.HOURS_PER_YEAR)).otherwise(F.lit(1))
    low = amount(F.get(ends, F.lit(0)))
    high = amount(F.when(F.size(ends) > 1, F.get(ends, F.lit(1))).otherwise(F.get(ends, F.lit(0))))
    return F.when(low.isNotNull(), F.struct((low * factor).alias("min"), (high * factor).alias("max")))


def thousands(value):
    """``$175k``."""
    return F.when(
        value != 0, F.concat(F.lit("$"), F.round(value / F.lit(1000.0), 0).cast("bigint").cast("string"), F.lit("k"))
    )

"""Sets of companies: union, live ones, dead ones left out."""

from functools import reduce


def company_union(*tables):
    """Every company of any of the tables once; the tables have the same columns."""
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()


def live_companies(companies, dead, on=("ats", "slug")):
    """Companies without those known to be dead."""
    return companies.select(*on).distinct().join(dead.select(*on), list(on), "left_anti")


def skip_dead(rows, dead, on=("ats", "slug")):
    """Rows of companies that are not known to be dead; a null key is no dead company's."""
    return rows.join(dead.select(*on).distinct(), list(on), "left_anti")


def dead_union(old, new, on=("ats", "slug")):
    """Known and newly dead companies, each once."""
    return company_union(old.select(*on), new.select(*on))

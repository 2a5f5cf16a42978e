"""Pages from a stored order, and sets of companies."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import companies, order_index

SCHEMA = "title string, k int, level string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rnd = random.Random(1)
    # a third of all rows have one title
    rows = [("same" if k % 3 == 0 else rnd.choice("abxyz") + str(rnd.randrange(90)), k, rnd.choice(["senior", "mid", None])) for k in range(1000)]
    rows.append((None, 1000, "mid"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    path = str(tmp_path_factory.mktemp("order") / "t")
    order_index.write_order(df, ["title", "k"], path, rows=90)
    return path, df.schema, sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def read(spark, stored, number, size, where=None):
    path, schema, _ = stored
    return order_index.page(spark, path, schema, ["title", "k"], number, size, where)


@pytest.mark.parametrize("size", [7, 100, 1001, 5000])
def test_pages_follow_the_order(spark, stored, size):
    rows = stored[2]
    last = -(-len(rows) // size)
    for number in {1, 2, last // 2, last, last + 1, 0, -4}:
        start = (number - 1) * size if 1 <= number <= last else 0
        assert [tuple(r) for r in read(spark, stored, number, size).collect()] == rows[start : start + size]


def test_a_page_reads_its_ranges_only(spark, stored):
    path = stored[0]
    ranges = [n for n in os.listdir(f"{path}/data") if n.startswith("_range=")]
    assert len(ranges) == 12
    for number in (1, 20, 40):
        files = read(spark, stored, number, 25).inputFiles()
        assert 1 <= len(files) <= 2


def test_filtered_pages(spark, stored):
    kept = [r for r in stored[2] if r[2] == "senior"]
    for number in (1, 3, -(-len(kept) // 40), 99):
        start = (number - 1) * 40 if (number - 1) * 40 < len(kept) else 0
        got = read(spark, stored, number, 40, F.col("level") == "senior")
        assert [tuple(r) for r in got.collect()] == kept[start : start + 40]
    assert read(spark, stored, 2, 40, F.col("level") == "none").count() == 0


def test_an_empty_table_has_an_empty_page(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    order_index.write_order(df, ["title", "k"], str(tmp_path / "t"))
    assert order_index.page(spark, str(tmp_path / "t"), df.schema, ["title", "k"], 3).count() == 0


def test_company_sets(spark):
    rows = spark.createDataFrame([("L", "a", 1), ("L", "a", 2), ("L", "b", 3), (None, "c", 4), ("A", None, 5)], "ats string, slug string, n int")
    dead = spark.createDataFrame([("L", "a"), ("L", "a"), (None, "c")], "ats string, slug string")
    key = lambda df: sorted(((r["ats"] or "", r["slug"] or "") for r in df.collect()))
    assert key(companies.live_companies(rows, dead)) == [("", "c"), ("A", ""), ("L", "b")]
    assert sorted(r["n"] for r in companies.skip_dead(rows, dead).collect()) == [3, 4, 5]
    assert key(companies.dead_union(dead, rows.filter("n = 3"))) == [("", "c"), ("L", "a"), ("L", "b")]
    assert companies.company_union(dead, dead).count() == 2


def test_ranges_are_cut_inside_a_bounded_number_of_parts(spark, tmp_path, monkeypatch):
    """The driver samples splitters for the parts, not for every range."""
    monkeypatch.setattr(order_index, "PARTS", 3)
    rows = [("same" if k % 2 else f"t{k:04}", k, "mid") for k in range(1000)]
    path = str(tmp_path / "t")
    order_index.write_order(spark.createDataFrame(rows, SCHEMA).repartition(4), ["title", "k"], path, rows=50)
    index = spark.read.schema(order_index.INDEX).parquet(f"{path}/index").orderBy("_range").collect()
    assert 20 <= len(index) <= 23 and max(r["rows"] for r in index) == 50
    assert len({r["_range"] // order_index.PART_RANGES for r in index}) <= 3
    for number in (1, 7, 40):
        got = order_index.page(spark, path, spark.createDataFrame([], SCHEMA).schema, ["title", "k"], number, 25).collect()
        assert [tuple(r) for r in got] == sorted(rows)[25 * number - 25 : 25 * number]

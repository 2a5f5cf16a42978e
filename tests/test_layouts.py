"""Stored layouts: boxes of the map, searches by trigrams, sketches of companies."""

import random

from pyspark.sql import functions as F

from vacantia.operators import facets, map_layout, sketches, text_index
from vacantia.streaming import cycles


def points(spark):
    rnd = random.Random(4)
    towns = [(rnd.uniform(-80, 80), rnd.uniform(-175, 175)) for _ in range(40)]
    rows = [(k, f"u{k}", (t[0] + rnd.gauss(0, 0.5), t[1] + rnd.gauss(0, 0.5))) for k in range(2000) for t in [rnd.choice(towns[:13] if k % 3 == 0 else towns)]]
    rows += [(5000, "n", None), (5001, "s", (-90.0, -180.0)), (5002, "e", (90.0, 180.0)), (5003, "z", (0.0, 0.0)), (5004, "z", (0.0, 0.0))]
    return spark.createDataFrame(rows, "k int, url string, coords struct<lat:double,lng:double>"), towns


def test_a_box_reads_the_files_it_meets(spark, tmp_path):
    df, towns = points(spark)
    path = str(tmp_path / "map")
    map_layout.write_map(df, path, ties=["k"], rows=50)
    boxes = [(t[0] - 1, t[1] - 1, t[0] + 1, t[1] + 1) for t in towns[:6]] + [(-90, -180, 90, 180), (0, 0, 0, 0), (10, 10, 5, 5)]
    files = []
    for box in boxes:
        got = map_layout.viewport(spark, path, df.schema, *box)
        want = df.filter(facets.in_viewport(*box))
        assert sorted(r["k"] for r in got.collect()) == sorted(r["k"] for r in want.collect())
        files.append(len(got.inputFiles()))
    assert files[6] == 41 and max(files[:6]) <= 12


def test_the_curve_interleaves_both_coordinates(spark):
    rows = [(-90.0, -180.0), (-90.0, 0.0), (0.0, -180.0), (0.0, 0.0), (90.0, 180.0), (None, 1.0)]
    codes = [r[0] for r in spark.createDataFrame(rows, "lat double, lng double").select(map_layout.morton(F.col("lat"), F.col("lng"))).collect()]
    top = 1 << (2 * map_layout.BITS - 2)
    assert codes[:4] == [0, top, 2 * top, 3 * top] and codes[4] == 4 * top - 1 and codes[5] is None


def test_searches_by_trigrams_equal_the_scan(spark, tmp_path):
    rnd = random.Random(9)
    words = ["manager", "clerk", "nurse", "Über", "chef", "IT", "driver", "sales"]
    rows = [(k, " ".join(rnd.choices(words, k=3)), "Acme" if k % 2 else None) for k in range(3000)]
    rows += [(4000, "zoologist keeper", "Rare Zoo"), (4001, "", None), (4002, None, "ab"), (4003, "a\nb zoologists", "😀😀😀x")]
    df = spark.createDataFrame(rows, "k int, title string, company string")
    path = str(tmp_path / "t")
    text_index.write_text_index(df, ["title", "company"], ["title", "k"], path, rows=60)
    everything = len(spark.read.parquet(f"{path}/data").inputFiles())
    for term in ["Zoologist", "manager clerk", "ÜBER", "it", "x", "nobody", "a\nb", "😀😀😀", "rare zoo", "ger"]:
        where = facets.facet_any_term(F.col("title"), term) | facets.facet_any_term(F.col("company"), term)
        got = text_index.search(spark, path, df.schema, term, where)
        assert sorted(r["k"] for r in got.collect()) == sorted(r["k"] for r in df.filter(where).collect()), term
    rare = text_index.search(spark, path, df.schema, "zoologist", facets.facet_any_term(F.col("title"), "zoologist"))
    assert len(rare.inputFiles()) * 10 < everything  # a rare term reads less than a tenth


def test_sketches_of_chunks_unite(spark, tmp_path):
    df = spark.range(60_000).select(
        F.concat(F.lit("c"), (F.col("id") * 11 % 21_000).cast("string")).alias("company"), (F.col("id") % 10 == 0).alias("is_recruiter"), (F.col("id") % 3).alias("part"))
    for part in range(3):
        df.filter(F.col("part") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = cycles.files(spark, str(tmp_path / "in"), df.schema)
    sketches.sketch_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = sketches.progress(spark, str(tmp_path / "out"), 2).first()
    assert (last["jobs"], last["recruiter_jobs"]) == (60_000, 6000)
    # three standard errors of 1.04 / sqrt(4096)
    assert abs(last["companies"] - 21_000) <= 0.049 * 21_000
    first = sketches.progress(spark, str(tmp_path / "out"), 0).first()
    exact = df.filter("part = 0").select("company").distinct().count()
    assert first["jobs"] == 20_000 and abs(first["companies"] - exact) <= 0.049 * exact
    assert sketches.united(sketches.sketched(df.limit(0))).first()["companies"] == 0
    few = sketches.united(sketches.sketched(df.filter("company IN ('c11', 'c22')"), "part")).first()
    assert few["companies"] == df.filter("company IN ('c11', 'c22')").select("company").distinct().count()


def test_a_range_sends_its_trigrams_once(spark):
    rows = spark.createDataFrame([(0, "abcd")] * 50 + [(1, "abcé"), (1, None), (1, "ab"), (1, "")], "_range int, text string").coalesce(1)
    got = sorted((r["_range"], r["gram"]) for r in text_index._range_grams(rows).collect())
    assert got == [(0, "abc"), (0, "bcd"), (1, "abc"), (1, "bcé")]

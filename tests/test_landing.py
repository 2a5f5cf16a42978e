"""Landing folders of the stream queries."""

from vacantia.plans import queries_files


def test_landed_files_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_files, "FILE_ROWS", 1500)
    for name, sizes, files in (("a", [9000, 6000], 6), ("b", [9000, 0], 1), ("c", [9000, 3], 1)):
        path = str(tmp_path / name)
        assert queries_files.land([spark.range(n) for n in sizes], path, 1) == files
        read = spark.read.parquet(path)
        assert read.count() == sum(sizes) and len(read.inputFiles()) == files * 2

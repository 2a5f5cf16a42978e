"""Readers of the files the jobs exchange: chunks, lookups, state, lists."""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vacantia import fixed_values as fixed
from vacantia.schemas import SLIM_FILE
from vacantia.sources import chunk_set

MANIFEST = "set string, lists array<string>, chunks array<string>, chunkCount bigint, totalJobs bigint, last_updated string"


def or_empty(spark, read, schema):
    """Rows of ``read()``, or none where the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _document(spark, path, schema):
    """A whole JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _manifest(spark, folder):
    return or_empty(spark, lambda: _document(spark, f"{folder}/jobs_manifest.json", MANIFEST), MANIFEST)


def read_manifest(spark, folder):
    """Number of chunks, row total and stamp of the set in force; no row without a manifest."""
    return _manifest(spark, folder).select(
        F.coalesce("chunkCount", F.size("chunks").cast("bigint")).alias("chunks"), "totalJobs", "last_updated")


def read_chunk_names(spark, folder):
    """``name, path`` of the chunks in force, a row each: from the set's lists, or the array of a plain manifest."""
    manifest = _manifest(spark, folder)
    plain = manifest.select(F.explode("chunks").alias("name")).select("name", F.col("name").alias("path"))
    fields = "name string, path string, rows bigint"
    lists = or_empty(
        spark, lambda: spark.read.schema(fields).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).json(folder)
        .withColumn("_file", F.col("_metadata.file_path")), fields + ", _file string")
    named = manifest.select(F.explode("lists").alias("_list"))
    current = lists.withColumn("_list", F.array_join(F.slice(F.split("_file", "/"), -3, 3), "/")).join(named, "_list", "left_semi")
    return plain.unionByName(current.select("name", "path"))


def read_chunks(spark, folder):
    """Slim postings of the chunks that the manifest names; absent chunks are skipped.

    Only named files are opened: a stray, older or half-written file below the folder is not.
    """
    documents = chunk_set.register(spark).read.format(chunk_set.FORMAT).load(folder)
    rows = F.from_json("value", f"array<struct<{_struct(SLIM_FILE)}>>")
    return with_coords(documents.select(F.explode(rows).alias("row")).select("row.*"))


def _struct(ddl):
    """Columns of a DDL text as the fields of a struct."""
    return ", ".join(f.strip().replace(" ", ":", 1) for f in re.split(r",\s*(?=\w+ )", ddl))


def with_coords(rows):
    """File form ``[lat, lng]`` to a struct."""
    return rows.withColumn(
        "coords",
        F.when(F.col("coords").isNotNull(), F.struct(F.col("coords")[0].alias("lat"), F.col("coords")[1].alias("lng"))),
    )


def manifest_check(manifest, postings):
    """Announced and actual row count side by side."""
    counts = manifest.agg(F.max("totalJobs").alias("announced")).unionByName(
        postings.agg(F.count("*").alias("found")), allowMissingColumns=True
    )
    return counts.agg(F.max("announced").alias("announced"), F.max("found").alias("found"))


def _texts(spark, path):
    return or_empty(
        spark, lambda: spark.read.option("recursiveFileLookup", True).text(path, wholetext=True), "value string")


def _objects(text, fields):
    """The objects of a file that holds one in each line, as Spark writes tables."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.startswith(line, F.lit("{")))
    return F.transform(lines, lambda line: F.from_json(line, fields))


def read_slugs(spark, path, fields="slug string, platform string"):
    """``slug, platform`` of a list: one JSON array of strings, or the rows of a written table.

    Distinct; none where the file is missing or malformed. Strings have no platform.
    """
    strings = F.transform(F.from_json("value", "array<string>"), lambda s: F.struct(
        s.alias("slug"), F.lit(None).cast("string").alias("platform")))
    rows = _texts(spark, path).select(F.explode(F.coalesce(strings, _objects(F.col("value"), fields))).alias("row"))
    return rows.select("row.slug", "row.platform").filter("slug IS NOT NULL").distinct()


def read_companies(spark, path, ats):
    return read_slugs(spark, path).select(F.lit(ats).alias("ats"), "slug").distinct()


def read_dead_slugs(spark, path, platform):
    """Dead slugs of one platform, from its own list or from the table of all platforms."""
    rows = read_slugs(spark, path).filter(F.col("platform").isNull() | (F.col("platform") == platform))
    return rows.select(F.lit(platform).alias("platform"), "slug").distinct()


def read_active_companies(spark, path):
    """``slug, jobs`` as ``write_active_companies`` writes them."""
    schema = "slug string, jobs bigint"
    return or_empty(spark, lambda: spark.read.schema(schema).json(path), schema)


def read_gazetteer(spark, path):
    """Column names in ``schema``, rows in ``data``; ``pos`` keeps the row order."""
    doc = _document(spark, path, "schema array<string>, data array<array<string>>")
    rows = doc.select("schema", F.posexplode("data").alias("pos", "row"))

    def field(name):
        return F.get(F.col("row"), F.array_position("schema", name).cast("int") - 1)

    return rows.select(
        "pos", field("city").alias("city"), field("admin").alias("admin"), field("country").alias("country"),
        field("lat").try_cast("double").alias("lat"), field("lng").try_cast("double").alias("lng"),
    ).filter(F.trim(F.coalesce("city", F.lit(""))) != "")


_SALARIES = "map<string,struct<p25:bigint,median:bigint,p75:bigint,n:bigint>>"


def read_salary_lookup(spark, path):
    """``tier, key, salary`` of a lookup document with the maps primary and fallback."""
    schema = f"primary {_SALARIES}, fallback {_SALARIES}"
    doc = or_empty(spark, lambda: _document(spark, path, schema), schema)
    tiers = [doc.select(F.lit(t).alias("tier"), F.explode(t).alias("key", "salary")) for t in ("primary", "fallback")]
    return tiers[0].unionByName(tiers[1])


def read_salary_shards(spark, folder):
    """``key, salary`` of shard files, each one map document, or of written shards, a row a line."""
    docs = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder, wholetext=True)
    written = F.startswith("value", F.lit('{"key":'))
    fields = f"key string, salary {_SALARIES[11:-1]}"
    maps = F.map_entries(F.from_json(F.when(~written, F.col("value")), _SALARIES))
    pairs = F.transform(maps, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("salary")))
    rows = F.coalesce(pairs, _objects(F.when(written, F.col("value")), fields))
    return docs.select(F.explode(rows).alias("row")).select("row.*")


TREND = (
    "date date, total_jobs bigint, active_companies bigint, recruiter_jobs bigint, "
    "by_platform map<string,bigint>, by_tier map<string,bigint>"
)


def read_trends(spark, path):
    """Daily records from pretty-printed objects that follow each other in one file."""
    records = F.explode(F.split(F.trim("value"), r"(?<=\n\})\s*\n(?=\{)"))
    texts = spark.read.text(path, wholetext=True).select(records.alias("record"))
    return texts.select(F.from_json("record", TREND).alias("r")).select("r.*")


def read_seen(spark, path):
    """Seen-state JSON map; missing or malformed files mean an empty state."""
    read = or_empty(spark, lambda: spark.read.text(path, wholetext=True), "value string")
    entries = F.explode(F.from_json("value", "map<string,struct<first_seen:string,last_seen:string>>"))
    rows = read.select(entries.alias("job_id", "seen"))
    return rows.select(
        "job_id", *[F.try_to_date(F.col("seen")[n], "yyyy-MM-dd").alias(n) for n in ("first_seen", "last_seen")]
    )


def read_statuses(spark, path):
    """User status map ``key -> {status, date or timestamp}``; corrupt files mean none."""
    return parse_statuses(or_empty(spark, lambda: spark.read.text(path, wholetext=True), "value string"))


def parse_statuses(documents):
    """Entries of status maps, one document in each ``value``."""
    entries = F.explode(F.from_json("value", "map<string,struct<status:string,date:string,timestamp:string>>"))
    rows = documents.select(entries.alias("key", "entry"))
    return rows.select(
        "key", "entry.status", F.try_to_timestamp(F.coalesce("entry.date", "entry.timestamp")).alias("ts")
    )


def parse_candidates(lines):
    """``platform:slug`` lines (column ``value``); comments and blanks dropped."""
    text = F.trim("value")
    known = F.lower(F.trim(F.substring_index("line", ":", 1)))
    has_colon = F.contains("line", F.lit(":"))
    rows = lines.filter((text != "") & ~F.startswith("value", F.lit("#"))).select(text.alias("line"))
    valid = has_colon & known.isin(fixed.WATCH_PLATFORMS)
    return rows.select(
        F.when(has_colon, known).otherwise(F.lit("unknown")).alias("platform"),
        F.when(valid, F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))).otherwise(F.col("line")).alias("slug"),
        valid.alias("known"),
    )


def read_candidates(spark, path):
    return parse_candidates(spark.read.text(path))


def read_jobs_db(spark, path):
    """Rows of the ``jobs`` array inside the envelope, or of the table ``write_jobs_db`` writes."""
    from vacantia.schemas import VERIFIED_JOB

    try:
        return spark.read.schema(VERIFIED_JOB).json(f"{path}/jobs")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    fields = ", ".join(f.strip().replace(" ", ":", 1) for f in VERIFIED_JOB.split(","))
    doc = _document(spark, path, f"last_updated string, total bigint, jobs array<struct<{fields}>>")
    return doc.select(F.explode("jobs").alias("job")).select("job.*")

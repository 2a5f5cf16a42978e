"""Session settings the jobs rely on."""

import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when a later step then has to shuffle again
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the text rules are long expressions; deriving constraints from them costs the
    # planner many seconds and yields nothing but not-null tests
    "spark.sql.constraintPropagation.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else started."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset it lies in the
    session's warehouse, which driver and executors share as well.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_intermediate")
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def local_session(cpus="*", app="vacantia", **extra):
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **extra,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

import pytest

from vacantia.session import local_session, prepare


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # the shared folder of a run on one machine
    shared = str(tmp_path_factory.mktemp("shared"))
    session = prepare(local_session("*", "tests", **{
        "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": f"{shared}/warehouse", "spark.checkpoint.dir": f"{shared}/checkpoints"}))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a column function over a list of values of ``x``."""
    from pyspark.sql import functions as F

    def run(make, values, schema="x string"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, " + schema)
        return [r.v for r in df.select("i", make(F).alias("v")).orderBy("i").collect()]

    return run

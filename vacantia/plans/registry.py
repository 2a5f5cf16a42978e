"""Registry of the runnable queries and their SQL counterparts."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under ``name``."""
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register

"""All registered queries; importing the query modules fills the registry."""

from vacantia.plans import (  # noqa: F401
    queries_files,
    queries_places,
    queries_postings,
    queries_runs,
    queries_sources,
    queries_views,
)
from vacantia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Importing this module registers every query."""

from brackish.plans import (  # noqa: F401
    aggregates,
    columns,
    feeds,
    joining,
    mapping,
    models,
    scalars,
    series,
    sources,
    studies,
)
from brackish.plans.catalog import ORACLES, QUERIES, Tables  # noqa: F401

"""Importing this module fills the catalog."""

from cohortmill.plans import (  # noqa: F401
    cohort_queries, learning_queries, matrix_queries, source_queries, survival_queries,
)
from cohortmill.plans.catalog import ORACLES, QUERIES  # noqa: F401

"""Every registered query; importing this package fills the registry."""

from verdigris.plans.catalog import address_queries, base_queries, case_queries, graph_queries, learning_checks, learning_queries, model_queries, quality_queries, whole_queries  # noqa: F401
from verdigris.plans.catalog.registry import ORACLE, QUERIES  # noqa: F401

"""All registered queries."""

from . import queries_history, queries_tables, queries_metrics, queries_asof, queries_log, queries_models, queries_boosting, queries_rules  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

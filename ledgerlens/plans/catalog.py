"""All registered queries."""

from . import day_queries, deal_queries, features_queries, io_queries, model_queries, rules_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

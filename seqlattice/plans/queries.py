"""All registered queries of the library and their SQL."""

from . import layout_queries, model_queries, selector_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

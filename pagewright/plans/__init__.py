"""Registered queries. Importing the package fills the registry."""

from . import (block_queries, edit_queries, layout_queries, manifest_queries, raster_queries, reply_queries,  # noqa: F401
               source_queries, store_queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

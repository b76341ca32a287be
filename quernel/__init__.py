"""A semantic query engine on Spark: models in YAML, requests in, DataFrames out."""

from .engine import Engine
from .model import Schema, load, loads
from .plans import Filter, QueryRequest, QuerySpec

__all__ = ["Engine", "Filter", "QueryRequest", "QuerySpec", "Schema", "load", "loads"]

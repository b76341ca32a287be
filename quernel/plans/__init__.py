"""From a request to a query specification: selection, resolution, routing, SQL text."""

from .request import Filter, QueryRequest
from .router import plan
from .spec import Branch, QuerySpec, Stitch

__all__ = ["Branch", "Filter", "QueryRequest", "QuerySpec", "Stitch", "plan"]

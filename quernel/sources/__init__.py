"""Where tables come from: path templates and the catalog of DataFrames."""

from .catalog import Catalog
from .templates import dataset_place, dimension_place, resolve_dimension_template

__all__ = ["Catalog", "dataset_place", "dimension_place", "resolve_dimension_template"]

"""A QuerySpec's parts as DataFrames."""

from .compile import compile_spec

__all__ = ["compile_spec"]

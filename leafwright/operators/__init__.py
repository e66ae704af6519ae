"""Operators: DataFrames in, DataFrames out."""

from . import endpoints  # noqa: F401 - registers its engines

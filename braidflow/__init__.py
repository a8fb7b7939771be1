"""Spark-native dataflow pipelines: a small operator algebra over DataFrames."""

from .functions import expand, fill_special, match, substitute
from .plans import *  # noqa: F403
from .plans import __all__ as _plans
from .sources import FilePath, materialize, materialize_table, read_pattern, through_shell

__all__ = [*_plans, "FilePath", "expand", "fill_special", "match", "materialize", "materialize_table", "read_pattern", "substitute", "through_shell"]

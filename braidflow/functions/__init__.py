"""Scalar functions: path patterns at plan time and as column expressions."""

from .patterns import expand, expand_table, fill_special, fill_special_column, has_wildcards, literal_root, match, match_column, substitute, substitute_column, to_glob, to_regex, wildcards, wildcards_column

__all__ = ["expand", "expand_table", "fill_special", "fill_special_column", "has_wildcards", "literal_root", "match", "match_column", "substitute", "substitute_column", "to_glob", "to_regex", "wildcards", "wildcards_column"]

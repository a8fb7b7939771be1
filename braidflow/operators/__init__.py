"""DataFrame operators: step workloads, and the algebra over tables alone."""

from .branching import LineageCycle, chunks, existing, first_match, first_rule, lacking, last_by, lineage, per_branch, results_summary, union_all
from .grouped import Fold, TableBlock, each_item, fold
from .lines import ascii_upper, at_most, byte_count, concat, field_above, head, line_count, mean_max, prefixed, sorted_lines, stripped_join, threshold, unique_lines
from .ordinals import split_files, with_ordinals

__all__ = [
    "Fold", "LineageCycle", "TableBlock", "ascii_upper", "at_most", "byte_count", "chunks", "concat", "each_item", "existing", "field_above", "first_match", "first_rule", "fold", "head", "lacking", "last_by", "line_count", "lineage", "mean_max", "per_branch", "prefixed", "results_summary",
    "sorted_lines", "split_files", "stripped_join", "threshold", "union_all", "unique_lines", "with_ordinals",
]

"""Sources and sinks: files, tables, archives, shell output and spilled values."""

from .archives import read_tar, tar_contents, tar_index, write_tars
from .files import discover, exists, file_times, find_matches, listing, local_path, matched_listing, read_pattern, times_of, total_size
from .pattern_source import register_pattern
from .tables import FilePath, Spilled, SpilledText, SpilledValue, checkpoint_dir, materialize, materialize_table, read_bytes, read_csv, read_keyed, read_table, scratch_dir, shell_lines, spill, through_shell, write_keyed, write_table

__all__ = [
    "FilePath", "Spilled", "SpilledText", "SpilledValue", "checkpoint_dir", "discover", "exists", "file_times", "find_matches", "listing", "local_path", "matched_listing", "materialize", "materialize_table", "read_bytes", "read_csv", "read_keyed", "read_pattern", "read_table", "read_tar", "register_pattern",
    "scratch_dir", "shell_lines", "spill", "tar_contents", "tar_index", "through_shell", "times_of", "total_size", "write_keyed", "write_table", "write_tars",
]

"""Tables on disk: Parquet, CSV and the single-file block format."""

from .blocks import append_block_file, write_block_file
from .tables import append_rows, import_csv, merge_tables, read_table, write_rows

__all__ = ["append_block_file", "append_rows", "import_csv", "merge_tables", "read_table", "write_block_file", "write_rows"]

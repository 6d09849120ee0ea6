"""What the operators of this package share with the library: reading a table, cutting lineage, and what is stored on the way."""

from eventloom.runtime import cut, drop, exists, remove, shared_dir, table

__all__ = ["cut", "drop", "exists", "remove", "shared_dir", "table"]

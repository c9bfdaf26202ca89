"""Files in shared folders, as the operators here use them."""

from stratalore.sources.storage import list_files, open_file, read_file, remove, rename, write_file

__all__ = ["list_files", "open_file", "read_file", "remove", "rename", "write_file"]

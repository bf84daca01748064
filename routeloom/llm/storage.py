"""Intermediate tables in the folder that the whole cluster shares; for users of the operators."""

from routeloom.sources.storage import clear, discard, new_path, settle, shared_dir

__all__ = ["clear", "discard", "new_path", "settle", "shared_dir"]

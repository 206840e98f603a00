"""Where intermediate tables go, and how lineage is cut: as in the rest of the library."""

from ..session import new_folder, saved, shared_folder

__all__ = ["new_folder", "saved", "shared_folder"]

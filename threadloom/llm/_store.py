"""Intermediate tables in the shared folder, as the rest of the package keeps them."""

from ..sources.stored import discard, new_folder, release, remove, shared_folder, stored

__all__ = ["discard", "new_folder", "release", "remove", "shared_folder", "stored"]

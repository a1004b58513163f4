"""Intermediate tables in the folder that all executors share, as the rest of the library keeps them."""

from __future__ import annotations

from docmill.sources.shared import discard, materialise, shared_root

__all__ = ["discard", "materialise", "shared_root"]

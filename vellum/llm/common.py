"""Shared plumbing of the core library, under the names used here."""

from __future__ import annotations

from ..functions.runtime import checkpoint_dir, checkpointed, table

__all__ = ["checkpoint_dir", "checkpointed", "table"]

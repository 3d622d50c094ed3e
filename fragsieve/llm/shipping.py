"""Readies a session for the operators; the library's own."""

from ..sources.shipping import BATCH_ROWS, ship

__all__ = ["BATCH_ROWS", "ship"]

"""Incremental runs over arriving files."""

from lexforge.streaming.incremental import deposit_stream, keyed_dedup

__all__ = ["deposit_stream", "keyed_dedup"]

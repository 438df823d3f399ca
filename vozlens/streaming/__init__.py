"""Structured Streaming: the append-only answer cache and sessions of an unbounded stream of segments."""

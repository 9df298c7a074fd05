"""The same expressions over streams."""

from .streams import grouped, read_stream, run_to_table, sessions, sliding, tumbling

__all__ = ["grouped", "read_stream", "run_to_table", "sessions", "sliding", "tumbling"]

"""Where report lines go."""

from gatetally.sinks.streams import start_batches, start_text
from gatetally.sinks.text import write_text

__all__ = ["start_batches", "start_text", "write_text"]

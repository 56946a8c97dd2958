"""Bounded text output."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_text(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Write lines as text files into the directory ``path``."""
    lines.write.mode(mode).text(path)

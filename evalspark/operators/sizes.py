"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of keys and a few numbers; this many fit any executor.
MAX_BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the table has at most ``max_rows`` rows, else as it is.

    Counts the table, so it is for small derived tables that are cheap to compute. Without
    the hint the large side would be shuffled before its partner's size is known.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df

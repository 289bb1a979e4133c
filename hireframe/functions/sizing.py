"""Size-checked broadcast: broadcast a side only when its row count is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side (rows) we ever broadcast; above it joins stay shuffle joins and
# AQE (with skew-join splitting) picks the strategy at run time.
MAX_BROADCAST_ROWS = 2_000_000
# Largest token table (bytes) we ever broadcast, and what a row takes besides its numbers.
MAX_BROADCAST_BYTES = 128 << 20
TOKEN_ROW_BYTES = 64


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Return ``broadcast(df)`` if ``df`` has at most ``max_rows`` rows, else ``df``.

    Counting runs one job over ``df``; call it on dimension-sized inputs
    (dictionaries, vocabularies, model tables), ideally already checkpointed.
    """
    if max_rows is None:
        max_rows = MAX_BROADCAST_ROWS
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df

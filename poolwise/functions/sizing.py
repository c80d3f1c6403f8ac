"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 100_000
BROADCAST_BYTE_LIMIT = 32 << 20


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT
) -> DataFrame:
    """Hint a broadcast when ``df`` is small in rows and in bytes, else leave the join to AQE.

    Bytes are those of the rows as JSON, so long strings and arrays count. Measuring stops after ``max_rows + 1``
    rows, so it stays cheap however big ``df`` is; the rows of the join are the same either way.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df

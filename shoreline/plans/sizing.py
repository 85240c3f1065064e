"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows, by a parallel count."""
    return df.count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add a broadcast hint after counting; otherwise leave the join to Catalyst and AQE.

    Meant for stored or checkpointed tables, where the count costs next to nothing.
    """
    return F.broadcast(df) if has_at_most(df, rows) else df

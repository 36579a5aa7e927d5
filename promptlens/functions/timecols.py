"""Time columns independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of a timestamp column.

    A TIMESTAMP_NTZ (wall clock, no zone) is measured from the NTZ epoch, so
    the result does not move with ``spark.sql.session.timeZone``; a zoned
    TIMESTAMP is an instant and maps to its Unix micros directly."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col))

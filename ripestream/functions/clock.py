"""Wall-clock arithmetic on timestamps without a zone.

Casting ``timestamp_ntz`` to ``timestamp`` reads it in the session's zone, where
an hour may be missing or doubled.  Differences here are taken between wall
clock readings, so they are the same in every session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_micros(ts: str | Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to the wall-clock reading, as long."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    return F.call_function("div", c - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.expr("INTERVAL '0 00:00:00.000001' DAY TO SECOND"))


def from_wall_micros(micros: Column) -> Column:
    """The wall-clock reading (``timestamp_ntz``) so many microseconds after 1970-01-01 00:00."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))

"""Flow roll-ups over streams: the batch operators' sums, kept up to date by day.

Nothing in the domain needs a stream; this is the incremental form of the roll-up of
event flow, for tables that keep growing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_flow(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, k, qty): whole units of value per day and user; rows later than ``late`` are left out.

    ``events`` (ts, user_id, value) may be a stream or a table.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    day = F.window("ts", "1 day")
    sums = rows.groupBy(day, F.col("user_id").alias("k")).agg(F.sum(F.floor("value")).cast("long").alias("qty"))
    return sums.select(F.col("window.start").cast("date").alias("day"), "k", "qty")

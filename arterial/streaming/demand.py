"""Demand from a stream of trips.

Trips (ts, o, d) are counted by window and pair; late ones are dropped after
the watermark. Each closed window is one scenario for the solvers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_demand(trips: DataFrame, window: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """scenario_id (the window's start), o, d, demand; batch or stream."""
    counted = trips.filter("o != d").withWatermark("ts", late).groupBy(F.window("ts", window), "o", "d").agg(F.count(F.lit(1)).cast("double").alias("demand"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("scenario_id"), "o", "d", "demand")

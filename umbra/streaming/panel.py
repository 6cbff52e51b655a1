"""The hourly panel as a stream: validated by range as readings arrive, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.operators.quality import plausible


def hourly_stream(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly means per station of a stream of (station, ts, t); readings later than ``late`` are dropped.

    The spike rule needs the two next readings and stays with the batch operator.
    """
    valid = plausible(readings).withWatermark("ts", late)
    hours = valid.groupBy("station", F.window("ts", "1 hour").alias("w")).agg(F.avg("t_ok").alias("t"), F.count("t_ok").alias("n"))
    return hours.select("station", F.col("w.start").alias("hour"), "t", "n")

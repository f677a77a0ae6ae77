"""Presence features of a stream of counts, by the same expressions as the batch form. An addition: the batch form is the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence_stream(living: DataFrame, late: str = "1 hour") -> DataFrame:
    """Mean and number of counts by cell and hour of a stream living(ts, cell_id, total_pop); hours close `late` after their end."""
    return living.withWatermark("ts", late).groupBy("cell_id", F.window("ts", "1 hour").alias("w")).agg(F.avg("total_pop").alias("mean_total_pop"), F.count("total_pop").alias("n")).select("cell_id", F.col("w.start").alias("hour_start"), "mean_total_pop", "n", F.log1p("mean_total_pop").alias("presence_log"))

"""Quality checks over a stream: windows of event time with a watermark, the same aggregates as the batch checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_quality(stream: DataFrame, time: str, value: str, by: str, *, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows, nulls, mean and range of ``value`` by window and group. Rows later than ``late`` behind the newest are dropped by the
    watermark (in a batch none are). Works on streaming and batch frames."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    agg = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"), F.count(F.when(x.isNull(), 1)).alias("n_null"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))
    return agg.select(F.col("w.start").alias("window_start"), by, "n", "n_null", "mean", "least", "most")

"""An addition: the metric query over a stream, in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kinds import column_name, kinds
from ..plans.metrics import metric, source_columns
from ..plans.query import exact_sum


def windowed_metric(stream: DataFrame, name: str, time: str, window: str = "1 day", late: str = "1 day", group_by: list[str] | None = None) -> DataFrame:
    """window_start, the group columns, value, rows_used; rows later than `late` are dropped by the watermark. Batch tables work too."""
    m = metric(name)
    sources = source_columns(m, kinds(stream))
    usable = stream.dropna(subset=list(dict.fromkeys(sources.values())))
    keys = [F.col(column_name(g)) for g in group_by or []]
    sums = [exact_sum(F.col(column_name(c)), stream.schema[c].dataType).alias(f"sum_{i}") for i, c in enumerate(sources.values())]
    timed = usable.withColumn("_time", F.col(column_name(time)).cast("timestamp"))
    grouped = timed.withWatermark("_time", late).groupBy(F.window("_time", window), *keys).agg(*sums, F.count(F.lit(1)).alias("rows_used"))
    value = m.value({n: F.col(f"sum_{i}").cast("double") for i, n in enumerate(sources)})
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *keys, value.alias("value"), "rows_used")

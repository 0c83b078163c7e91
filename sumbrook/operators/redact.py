"""A profile that may leave the house: no personal or free text, masked values, few samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from ..kinds import Kind

SAMPLES, LENGTH = 3, 40


def redacted_samples(samples: DataFrame, kinds: dict[str, Kind], sensitive: list[str]) -> DataFrame:
    """column, values: the first samples of (column, rank, value), cut and masked; hidden for personal and text columns."""
    text = [c for c, k in kinds.items() if k is Kind.TEXT]
    hidden = F.col("column").isin(*sensitive, *text) if sensitive or text else F.lit(False)
    kept = samples.where(F.col("rank") <= SAMPLES).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", pii.mask(F.substring("value", 1, LENGTH)).alias("value")))).alias("v"))
    return kept.select("column", F.when(hidden, F.array(F.lit(pii.HIDDEN))).otherwise(F.col("v.value")).alias("values"))

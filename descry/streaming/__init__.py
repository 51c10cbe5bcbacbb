"""Profiles have no streaming form; a stream is counted by period here, or profiled batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.functions.values import col
from descry.plans.describe import describe
from descry.profiles import DatasetProfile


def per_period(stream: DataFrame, column: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(period, n) over a stream, with a watermark; the same on a batch."""
    src = stream.select(col(column).cast("timestamp").alias("t"))
    src = src.withWatermark("t", late) if stream.isStreaming else src.where("t is not null")
    return src.groupBy(F.window("t", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("period"), "n")


def profile_batches(then: Callable[[DatasetProfile, int], None], **options) -> Callable[[DataFrame, int], None]:
    """A function for writeStream.foreachBatch that profiles each batch."""

    def each(batch: DataFrame, number: int) -> None:
        then(describe(batch, **options), number)

    return each

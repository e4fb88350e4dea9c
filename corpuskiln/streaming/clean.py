"""The row-wise steps of the funnel over a stream, and distinct pairs within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import text as X
from corpuskiln.operators import clean as C


def row_steps(pairs: DataFrame) -> DataFrame:
    """Steps that need one row only; the same function serves batches and streams."""
    for name, step in C.STEPS:
        if name not in ("distinct",):
            pairs = step(pairs)
    return pairs


def distinct_within(pairs: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Pairs not seen before within the watermark's delay."""
    return pairs.withWatermark(time, delay).dropDuplicatesWithinWatermark(["orig", "cor"])


def windowed_counts(pairs: DataFrame, time: str, width: str = "30 days", delay: str = "7 days") -> DataFrame:
    """Pairs and changed pairs by window of event time; late rows count until the watermark passes."""
    changed = F.count_if(~X.ignoring_space_and_case(F.col("orig"), F.col("cor")))
    return pairs.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count("*").alias("n_pairs"), changed.alias("n_changed")).select(F.col("window.start").alias("start"), "n_pairs", "n_changed")

"""Streams over whole tables, read to their end, with the results that batches give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.plans.corpus import ORACLE as CORPUS
from corpuskiln.streaming import clean as S
from corpuskiln.util import ensure_checkpoint_dir, table


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/lang8_raw.parque[t]"  # a pattern, as the table may be a file or a folder of part files
    rows = spark.readStream.schema(table(spark, sf_dir, "lang8_raw").schema).parquet(path)
    return rows.select(F.col("original").alias("orig"), F.col("corrected").alias("cor"), F.col("posted_at").cast("timestamp").alias("posted_at"))


def _row_steps(s: SparkSession, d: str) -> DataFrame:
    """The steps of the funnel on single rows, as a stream into files."""
    path = f"{ensure_checkpoint_dir(s)}/stream-{uuid.uuid4().hex}"
    rows = S.row_steps(_stream(s, d).filter("orig is not null and cor is not null").select("orig", "cor"))
    rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{path}/out")


def _windowed(s: SparkSession, d: str) -> DataFrame:
    """Pairs and changed pairs by window of 30 days; a few rows, however many pairs there are."""
    name = f"windowed_{uuid.uuid4().hex}"
    counts = S.windowed_counts(_stream(s, d), "posted_at")
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{ensure_checkpoint_dir(s)}/{name}").start().awaitTermination()
    return s.table(name).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {"stream_row_steps": _row_steps, "stream_windowed_counts": _windowed}
ORACLE = {
    "stream_row_steps": CORPUS["clean_pairs"].replace("SELECT DISTINCT orig, cor FROM h", "SELECT orig, cor FROM h"),
    "stream_windowed_counts": """SELECT strftime(time_bucket(INTERVAL '30 days', posted_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_pairs, count(*) FILTER (lower(replace(original, ' ', '')) <> lower(replace(corrected, ' ', ''))) AS n_changed
FROM lang8_raw WHERE posted_at IS NOT NULL GROUP BY 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

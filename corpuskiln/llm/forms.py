"""The key of a text: its letters and digits in lower case; and records that differ in form only (p6).

Canonical records are range-partitioned over (keys, id) and sorted, so that equal records stand in
adjacent runs; a scan compares full keys with the row before.  As the id takes part in the range, a
record with very many copies is spread over as many partitions as it needs; runs that cross a partition
border are settled through one small row for each border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.util import partitions


def key(text: Column) -> Column:
    """The letters and digits (Unicode L and N) of a text in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def keyed(pairs: DataFrame, *others: str) -> DataFrame:
    """``pair_id`` and the keys ``ka`` <= ``kb`` of rows whose ``src`` and ``tgt`` are not null."""
    rows = pairs.filter(F.col("src").isNotNull() & F.col("tgt").isNotNull()).select("pair_id", *others, key(F.col("src")).alias("s"), key(F.col("tgt")).alias("t"))
    return rows.select("pair_id", *others, F.least("s", "t").alias("ka"), F.greatest("s", "t").alias("kb"))


_RUNS = "pair_id long, keep_id long, edge_a string, edge_b string, tail boolean"
_SCHEMA = pa.schema([("pair_id", pa.int64()), ("keep_id", pa.int64()), ("edge_a", pa.string()), ("edge_b", pa.string()), ("tail", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give each row the first id of its run; rows of a partition's first run also carry its key.

    One more row (``tail``) names the key and first id of the partition's last run.
    """
    last: tuple[str, str] | None = None
    keep, in_first = -1, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column("pair_id").to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        if n > 1:
            same = [pc.equal(batch.column(c)[1:], batch.column(c)[:-1]) for c in ("ka", "kb")]
            new[1:] = ~pc.and_(*same).to_numpy(zero_copy_only=False)
        head = (batch.column("ka")[0].as_py(), batch.column("kb")[0].as_py())
        new[0] = last is not None and head != last
        runs = np.cumsum(new)
        first = np.concatenate([[keep if last is not None else ids[0]], ids[new]])
        own = first[runs]
        edge = (runs == 0) & in_first
        count = int(edge.sum())  # rows of the partition's first run stand first
        edge_a, edge_b = (pa.concat_arrays([pa.array([k] * count, pa.string()), pa.nulls(n - count, pa.string())]) for k in head)
        yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(own), edge_a, edge_b, pa.array(np.zeros(n, bool))], schema=_SCHEMA)
        in_first = in_first and count == n
        keep, last = int(own[-1]), (batch.column("ka")[n - 1].as_py(), batch.column("kb")[n - 1].as_py())
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"pair_id": None, "keep_id": keep, "edge_a": last[0], "edge_b": last[1], "tail": True}], schema=_SCHEMA)


def classes(pairs: DataFrame) -> DataFrame:
    """``pair_id`` and ``keep_id``, the smallest id among the rows that are the same in form.

    Rows with a null ``src`` or ``tgt`` take no part.  Texts without letters and digits have an empty
    key and are the same as each other.  Repeated ids are kept.  An empty table gives an empty result;
    columns other than ``pair_id``, ``src``, ``tgt`` are ignored.
    """
    rows = keyed(pairs)
    runs = rows.repartitionByRange(partitions(pairs.sparkSession), "ka", "kb", "pair_id").sortWithinPartitions("ka", "kb", "pair_id").mapInArrow(_scan, _RUNS)
    # at most one row for each partition, so it may be broadcast
    edges = runs.filter("tail").groupBy("edge_a", "edge_b").agg(F.min("keep_id").alias("edge_keep"))
    return (
        runs.filter(~F.col("tail")).join(F.broadcast(edges), ["edge_a", "edge_b"], "left").select("pair_id", F.least("keep_id", F.coalesce("edge_keep", "keep_id")).alias("keep_id"))
    )


def found(pairs: DataFrame) -> DataFrame:
    """One row (``keep_id``, ``pair_id``) for each row that is not the first of its group."""
    return classes(pairs).filter(F.col("pair_id") != F.col("keep_id")).select("keep_id", "pair_id").distinct()


def counts(pairs: DataFrame) -> DataFrame:
    """One record for each group, with the number of its copies."""
    return classes(pairs).groupBy("keep_id").agg(F.count("*").alias("n_copies"))

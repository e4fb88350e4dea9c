"""Filling containers of fixed capacity with whole texts (p8).

Only the number of texts of each size matters for a plan, and there are at most as many sizes as the
capacity: the plan is made on that histogram, and texts are then assigned to it by their rank among those
of their size.  Reduction comes first (Martello and Toth): an item is fixed with up to two others where
that set dominates every other feasible set with it.  What is left is packed best-fit, in decreasing order.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.llm.tokens import VOCABULARY, sized
from corpuskiln.util import cut, partitions

CAPACITY = 2048


@dataclass
class Pattern:
    """``times`` containers, each with the same number of items of each size."""

    times: int
    items: dict[int, int]


def _largest_pair(sizes: np.ndarray, count: np.ndarray, room: int) -> int:
    """The largest sum of two different items that fits the room; 0 if no two do."""
    if not len(sizes):
        return 0
    other = np.searchsorted(sizes, room - sizes, side="right") - 1
    own = np.arange(len(sizes))
    other -= (other == own) & (count < 2)
    fits = other >= 0
    return int((sizes[fits] + sizes[other[fits]]).max(initial=0))


def dominating(counts: dict[int, int], item: int, capacity: int) -> tuple[int, ...] | None:
    """The other items of a set with ``item`` that dominates every feasible set with it, if one of up to
    three items does.

    A set dominates another if each of its items is at least as large as the items of the other set that
    are put on it, these parts together being the whole other set: whatever the other set allows, items
    can be exchanged without loss.  What decides is how many other items fit beside the item at all.
    """
    sizes = np.array(sorted(counts), np.int64)
    count = np.array([counts[s] for s in sizes.tolist()], np.int64)
    count[np.searchsorted(sizes, item)] -= 1
    sizes, count = sizes[count > 0], count[count > 0]
    room = capacity - item
    least = np.repeat(sizes[:3], np.minimum(count[:3], 3))[:3]
    fit = int((np.cumsum(least) <= room).sum())
    if fit == 0:
        return ()
    single = int(sizes[np.searchsorted(sizes, room, side="right") - 1])
    if fit == 1 or single == room:
        return (single,)
    if fit > 2:
        return None
    if single >= _largest_pair(sizes, count, room):
        return (single,)
    # the largest single partner with the largest that fits beside it: the first covers every single
    # partner, both cover every pair whose smaller item is no larger than the second
    beside = sizes[: np.searchsorted(sizes, room - single, side="right")]
    if len(beside) and beside[-1] == single and count[np.searchsorted(sizes, single)] < 2:
        beside = beside[:-1]
    if len(beside):
        heavier = sizes > beside[-1]
        if single >= _largest_pair(sizes[heavier], count[heavier], room):
            return (single, int(beside[-1]))
    return None


def reduce(counts: Counter, capacity: int) -> list[Pattern]:
    """Fix dominating sets, item by item from the largest, until no item has one; ``counts`` keeps the rest.

    A decision depends on which sizes there are, and on whether there are one, two or three items of a
    size; so it is taken for as many equal items at a time as leave three of each size concerned.
    """
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for item in sorted(counts, reverse=True):
            while counts.get(item) and (others := dominating(counts, item, capacity)) is not None:
                pattern = Counter((item, *others))
                spare = min(counts[s] // n for s, n in pattern.items())
                times = counts[item] if not others else max(1, spare - 4)
                fixed.append(Pattern(times, dict(pattern)))
                for s, n in pattern.items():
                    counts[s] -= times * n
                    if not counts[s]:
                        del counts[s]
                again = True
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: containers in the same state are kept together."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # sorted rooms of open containers

    def put(room: int, pattern: Pattern) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append(pattern)

    for size in sorted(counts, reverse=True):
        k = counts[size]
        while k:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, pattern = capacity, Pattern(-(-k // (capacity // size)), {})
            each = room // size
            full = min(pattern.times, k // each)
            if full:
                put(room - each * size, Pattern(full, pattern.items | {size: each}))
                k -= full * each
            rest = pattern.times - full
            if rest and k and k < each:
                put(room - k * size, Pattern(1, pattern.items | {size: k}))
                k, rest = 0, rest - 1
            if rest and pattern.items:
                put(room, Pattern(rest, pattern.items))
    return [p for group in open_.values() for p in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], list[Pattern]]:
    """(containers that the reduction fixes, containers that best fit adds)."""
    counts = Counter({s: n for s, n in histogram.items() if n})
    return reduce(counts, capacity), best_fit(counts, capacity)


def layout(fixed: list[Pattern], packed: list[Pattern]) -> np.ndarray:
    """Rows (size, first rank, items of that size in a container, first container, fixed), sorted."""
    rows, used, base = [], Counter(), 0
    for i, p in enumerate(fixed + packed):
        for size, each in p.items.items():
            rows.append((size, used[size], each, base, i < len(fixed)))
            used[size] += p.times * each
        base += p.times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(items: DataFrame, *by: str, order: tuple[str, ...]) -> DataFrame:
    """Add ``rank``, the place from 0 of each row among those with equal ``by``.

    Rows are numbered within hash buckets, after the rows of the buckets before, so that no value of
    ``by``, however frequent, is numbered in one task.
    """
    buckets = partitions(items.sparkSession) * 4
    rows = items.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = rows.groupBy(*by, "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(*order)) - 1
    return rows.withColumn("within", within).join(before, [*by, "bucket"]).withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "within", "before")


def _assign(table: np.ndarray):
    big = np.int64(1) << 48
    starts = table[:, 0] * big + table[:, 1] if len(table) else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_tokens", "rank"))
            row = table[np.searchsorted(starts, size * big + rank, side="right") - 1]
            container = row[:, 3] + (rank - row[:, 1]) // row[:, 2]
            names = ["doc_id", "piece_no", "token_start", "n_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(container), *(batch.column(c) for c in names), pa.array(row[:, 4] == 1)], names=["container_id", *names, "fixed"])

    return run


def containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The container of each text: ``container_id``, ``doc_id``, ``piece_no``, ``token_start``, ``n_tokens``,
    and whether the reduction ``fixed`` it there.

    A text longer than a container is cut into full pieces and a rest, which is packed as an item; no
    other text is split.  Null and empty texts have no row.  Rows repeated under one ``doc_id`` are
    items of their own.  Other columns are ignored.
    """
    sizes = sized(documents, vocabulary=vocabulary)
    full = F.floor((F.col("n_tokens") - 1) / capacity)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), full)).alias("piece")
    length = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity)
    items = sizes.select("doc_id", "n_tokens", piece).select("doc_id", (F.col("piece") + 1).cast("int").alias("piece_no"), (F.col("piece") * capacity).alias("token_start"), length.alias("n_tokens"))
    items = cut(items)
    histogram = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    table = layout(*plan(histogram, capacity))
    return ranked(items, "n_tokens", order=("doc_id", "piece_no")).mapInArrow(_assign(table), "container_id long, doc_id long, piece_no int, token_start long, n_tokens long, fixed boolean")


def summary(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row: containers used, the least number that the total size allows, the part that is filled, and
    the part of the items that the reduction fixed."""
    used = containers(documents, capacity, vocabulary).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"), F.count_if("fixed").alias("fixed"))
    return used.agg(F.count("*").alias("n_containers"), F.ceil(F.sum("n") / capacity).alias("least_containers"), (F.sum("n") / (F.count("*") * capacity)).alias("filled"), F.max("n").alias("fullest"), F.sum("items").alias("n_items"), (F.sum("fixed") / F.sum("items")).alias("fixed_share"))


def invariants(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row: texts placed with all their tokens, containers beyond the capacity, and texts that are cut
    though they fit a container."""
    placed = containers(documents, capacity, vocabulary)
    per = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    whole = sized(documents, vocabulary=vocabulary).groupBy("doc_id").agg(F.sum("n_tokens").alias("size"))
    texts = whole.join(per, "doc_id", "left").agg(F.count_if(F.col("n") == F.col("size")).alias("n_texts"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= capacity)).alias("n_cut"))
    full = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("n_overfull"))
    return texts.crossJoin(full)  # one row each

"""Mixing sources to target weights (p9).

The tokens of each source, document after document, are cut into blocks of fixed length.  Each output
shard draws how many of its slots go to which source from a multinomial distribution; the draws are then
evened out so that the totals meet the weights and no source exceeds its blocks times its repeats.  The
k-th slot of a source is mapped to a block by a pseudorandom permutation of that source's blocks, another
one for each round through them, and slots and blocks are joined by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskiln.llm.tokens import VOCABULARY, sized
from corpuskiln.util import cut, partitions

BLOCK = 512
SLOTS = 1024
#: Output shards are made larger before there are more of them than this.
SHARDS = 1 << 16
SEED = 20

U = np.uint64


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, by a Feistel network walked until it is within range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U(half), x & mask
        for r in range(4):
            h = right + U((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> U(31))) & mask)
        return (left << U(half)) | right

    out = once(index.astype(U))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass
class Source:
    name: str
    number: int
    weight: float
    max_repeats: int
    n_tokens: int
    n_blocks: int


def apportion(n: int, among: np.ndarray) -> np.ndarray:
    """n parts (at most the sum) taken from whole numbers in proportion to them."""
    total = int(among.sum())
    if not n or not total:
        return np.zeros(len(among), np.int64)
    exact = among * (n / total)
    out = np.minimum(np.floor(exact).astype(np.int64), among)
    while (lack := n - int(out.sum())) > 0:
        order = np.argsort(out - exact, kind="stable")
        free = order[(among - out)[order] > 0][:lack]
        out[free] += 1
    return out


def draw(sources: list[Source], total: int | None = None, seed: int = SEED) -> np.ndarray:
    """Slots (shards, sources): multinomial draws whose column sums meet the weights within the caps."""
    weight = np.array([s.weight for s in sources])
    weight = weight / weight.sum()
    cap = np.array([s.n_blocks * s.max_repeats for s in sources], np.int64)
    most = int(np.floor((cap / weight).min() + 1e-9))
    total = most if total is None else min(total, most)
    if total <= 0:
        return np.zeros((0, len(sources)), np.int64)
    exact = weight * total
    wanted = np.floor(exact).astype(np.int64)
    for i in np.argsort(wanted - exact)[: total - int(wanted.sum())]:
        wanted[i] += 1
    wanted = np.minimum(wanted, cap)
    slots = max(SLOTS, -(-total // SHARDS))
    sizes = np.full(-(-total // slots), slots)
    sizes[-1] = total - slots * (len(sizes) - 1)
    rng = np.random.default_rng(seed)
    counts = np.array([rng.multinomial(n, weight) for n in sizes])
    # move the surplus of some sources to those in want, shard by shard, in proportion
    for i in range(len(sources)):
        surplus = int(counts[:, i].sum() - wanted[i])
        if surplus > 0:
            counts[:, i] -= apportion(surplus, counts[:, i])
    lack = wanted - counts.sum(axis=0)
    free = sizes - counts.sum(axis=1)
    for i in np.flatnonzero(lack > 0):
        n = min(int(lack[i]), int(free.sum()))
        take = apportion(n, free)
        counts[:, i] += take
        free -= take
    return counts


def _slots(counts: np.ndarray, sources: list[Source], seed: int):
    before = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, axis=0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                at = 0
                for i, s in enumerate(sources):
                    for lo in range(int(before[shard, i]), int(before[shard + 1, i]), 1 << 16):
                        k = np.arange(lo, min(lo + (1 << 16), int(before[shard + 1, i])))
                        again = k // s.n_blocks
                        block = np.empty(len(k), np.int64)
                        for e in np.unique(again):
                            block[again == e] = permute(k[again == e] % s.n_blocks, s.n_blocks, seed * 1_000_003 + s.number * 1009 + int(e))
                        slot = np.arange(at, at + len(k))
                        at += len(k)
                        whole = [np.full(len(k), v) for v in (shard, s.number)]
                        yield pa.RecordBatch.from_arrays([pa.array(whole[0], pa.int64()), pa.array(slot, pa.int64()), pa.array(whole[1], pa.int32()), pa.array(block), pa.array(again.astype(np.int32))], names=["shard", "slot", "source_no", "block", "round"])

    return run


def _placed(documents: DataFrame, targets: DataFrame, vocabulary: str) -> tuple[DataFrame, list[Source]]:
    """(documents with their place in the token stream of their source, the sources in use)."""
    wanted = {r["source"]: (float(r["weight"]), int(r["max_repeats"])) for r in targets.select("source", "weight", "max_repeats").collect() if r["source"] is not None and (r["weight"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    numbers = {name: i for i, name in enumerate(sorted(wanted))}
    if not numbers:
        numbers = {"": 0}
    number = F.create_map(*(x for name, i in numbers.items() for x in (F.lit(name), F.lit(i))))
    sizes = cut(sized(documents.filter(F.col("source").isin(list(wanted))), "source", vocabulary=vocabulary).withColumn("source_no", F.try_element_at(number, "source")).drop("source"))
    buckets = partitions(documents.sparkSession) * 4
    rows = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    before = rows.groupBy("source_no", "bucket").agg(F.sum("n_tokens").alias("n"))
    totals = {r["source_no"]: int(r["n"]) for r in before.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source_no", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("within", within).join(before, ["source_no", "bucket"]).select("source_no", "doc_id", "n_tokens", (F.col("before") + F.col("within")).alias("at"))
    names = {i: name for name, i in numbers.items()}
    sources = [Source(names[i], i, *wanted[names[i]], n, -(-n // BLOCK)) for i, n in sorted(totals.items())]
    return placed, sources


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


_MIXTURE = "shard long, slot long, source string, doc_id long, token_start long, token_end long, round int"


def mixture(documents: DataFrame, targets: DataFrame, total_blocks: int | None = None, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """The mixture, as the stretch of tokens that each slot of each shard takes from each document.

    Its size is ``total_blocks``, or the largest that the weights and repeats allow.  Weights are taken
    among the sources that have documents.  Sources without a target, null sources, and null and empty
    texts take no part.  ``round`` tells how often the block was used before, so no document occurs more
    than ``max_repeats`` times.  Document ids are taken to be unique.
    """
    spark = documents.sparkSession
    placed, sources = _placed(documents, targets, vocabulary)
    counts = draw(sources, total_blocks, seed) if sources else np.zeros((0, 0), np.int64)
    if not len(counts):
        return _empty(spark, _MIXTURE)
    n = len(counts)
    slots = spark.range(0, n, 1, min(n, partitions(spark) * 2)).mapInArrow(_slots(counts, sources, seed), "shard long, slot long, source_no int, block long, round int")
    block = F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("n_tokens") - 1) / BLOCK)))
    pieces = placed.withColumn("block", block).select(
        "source_no", "block", "doc_id", F.greatest(F.lit(0).cast("long"), F.col("block") * BLOCK - F.col("at")).alias("token_start"), F.least("n_tokens", (F.col("block") + 1) * BLOCK - F.col("at")).alias("token_end")
    )
    name = F.element_at(F.create_map(*(x for s in sources for x in (F.lit(s.number), F.lit(s.name)))), F.col("source_no"))
    return slots.join(pieces, ["source_no", "block"]).select("shard", "slot", name.alias("source"), "doc_id", "token_start", "token_end", "round")


def invariants(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each target source whether it has texts, whether no text of it is used more than ``max_repeats``
    times, and whether its share meets its weight (among the sources with texts) to a few blocks."""
    mixed = mixture(documents, targets, vocabulary=vocabulary)
    used = mixed.groupBy("source", "doc_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    sizes = sized(documents, vocabulary=vocabulary).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    per = used.join(sizes, "doc_id").groupBy("source").agg(F.sum("used").alias("used"), F.max(F.col("used") / F.col("n")).alias("most"))
    # a row for each source, so windows over all of them are small
    every = Window.partitionBy(F.lit(1))
    rows = targets.select("source", "weight", "max_repeats").join(per, "source", "left").withColumn("weight", F.when(F.col("used") > 0, F.col("weight")))
    share, wanted = F.col("used") / F.sum("used").over(every), F.col("weight") / F.sum("weight").over(every)
    return rows.select("source", (F.coalesce("used", F.lit(0)) > 0).alias("has_texts"), (F.coalesce("most", F.lit(0.0)) <= F.col("max_repeats")).alias("repeats_kept"), F.coalesce(F.abs(share - wanted) * F.sum("used").over(every) <= 8 * BLOCK, F.lit(True)).alias("share_met"))


def shares(documents: DataFrame, targets: DataFrame, total_blocks: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each target source: its weight, the tokens and share it really has, and its most frequent use."""
    mixed = mixture(documents, targets, total_blocks, vocabulary)
    per = mixed.groupBy("source").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens"), (F.max("round") + 1).alias("most_repeats"))
    # a row for each source, so one window over all of them is small
    per = per.withColumn("total", F.sum("n_tokens").over(Window.partitionBy(F.lit(1))))
    joined = targets.select("source", "weight", "max_repeats").join(per, "source", "left")
    return joined.select("source", "weight", "max_repeats", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))

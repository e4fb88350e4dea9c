"""GLEU by n-gram counts within the row and sums; no text leaves the executors' columns."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions.text import common_count, grams, item_counts, lacking_count, let, tokens

ORDER = 4
SIDES = ("hyp", "src", "ref")
#: Draws of references, as many as the reference makes by default.
ITERATIONS = 500


def gram_counts(rows: DataFrame, *keys: str, column: str, order: int = ORDER) -> DataFrame:
    """Counts of the n-grams of each row's array of tokens, for n up to ``order``, made within the row."""

    def of(n: int) -> Column:
        return F.transform(item_counts(grams(F.col(column), n)), lambda g: F.struct(F.lit(n).alias("n"), g["item"].alias("gram"), g["cnt"].alias("cnt")))

    each = F.concat(*(of(n) for n in range(1, order + 1)))
    return rows.select(*keys, F.explode(each).alias("g")).select(*keys, "g.*")


def _per_order(rows: DataFrame, keys: tuple[str, ...], name: str, value: Callable[[int], Column], order: int) -> DataFrame:
    each = F.array(*(F.struct(F.lit(n).alias("n"), value(n).cast("long").alias(name)) for n in range(1, order + 1)))
    return rows.select(*keys, F.explode(F.filter(each, lambda x: x[name] > 0)).alias("x")).select(*keys, "x.*")


def shared_grams(rows: DataFrame, *keys: str, left: str, right: str, order: int = ORDER) -> DataFrame:
    """How many n-grams two arrays of tokens of a row have in common, as multisets; rows of none left out."""
    return _per_order(rows, keys, "common", lambda n: common_count(grams(F.col(left), n), grams(F.col(right), n)), order)


def grams_of_one(rows: DataFrame, *keys: str, left: str, right: str, order: int = ORDER) -> DataFrame:
    """How many n-grams of the first array the second lacks altogether; rows of none left out."""
    return _per_order(rows, keys, "only_source", lambda n: lacking_count(grams(F.col(left), n), grams(F.col(right), n)), order)


def without(a: Column, b: Column) -> Column:
    """The items of the first array that the second has none of, with their copies."""
    return let(b, lambda others: F.filter(a, lambda x: ~F.array_contains(others, x)))


def document_frequency(rows: DataFrame, column: str = "words", order: int = ORDER) -> DataFrame:
    """In how many sentences each n-gram occurs."""
    return gram_counts(rows, "sid", column=column, order=order).groupBy("n", "gram").agg(F.count("*").alias("df"))


def merged_references(references: DataFrame, order: int = ORDER) -> DataFrame:
    """The largest count of each n-gram over the references of a sentence (``sid``, ``ref_no``, ``words``)."""
    return gram_counts(references, "sid", "ref_no", column="words", order=order).groupBy("sid", "n", "gram").agg(F.max("cnt").alias("cnt"))


def statistics(triples: DataFrame, keys: tuple[str, ...] = ("sid",), order: int = ORDER) -> DataFrame:
    """Lengths and, for each n, numerator and denominator of every row (``hyp``, ``src``, ``ref``).

    All n-grams concerned stand in one row, so they are matched there and nothing is moved.
    """
    rows = triples.select(*keys, *(tokens(F.col(s)).alias(s) for s in SIDES))
    out = [F.size("hyp").cast("long").alias("c"), F.size("ref").cast("long").alias("r")]
    for n in range(1, order + 1):
        hyp, src, ref = (grams(F.col(s), n) for s in SIDES)
        only_source = without(src, ref)
        signed = common_count(hyp, ref) - common_count(hyp, only_source)
        out += [F.greatest(signed, F.lit(0)).cast("long").alias(f"num{n}"), F.greatest(F.size("hyp") + 1 - n, F.lit(0)).cast("long").alias(f"den{n}")]
    return rows.select(*keys, *out)


def names(order: int = ORDER) -> list[str]:
    return ["c", "r", *(f"{p}{n}" for n in range(1, order + 1) for p in ("num", "den"))]


def score(order: int = ORDER, smooth: bool = False) -> Column:
    """GLEU of statistics columns: 0 if any is 0, or with 1 in its place."""
    col = lambda c: F.when(F.col(c) == 0, 1).otherwise(F.col(c)) if smooth else F.col(c)
    logs = sum((F.ln(col(f"num{n}") / col(f"den{n}")) for n in range(2, order + 1)), F.ln(col("num1") / col("den1"))) / order
    value = F.exp(F.least(F.lit(0.0), 1 - col("r") / col("c")) + logs)
    zero = F.least(*names(order)) == 0
    return value if smooth else F.when(zero, 0.0).otherwise(value)


def corpus(stats: DataFrame, *keys: str, order: int = ORDER) -> DataFrame:
    total = stats.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in names(order)))
    return total.select(*keys, score(order).alias("gleu"))


def sentences(stats: DataFrame, keys: tuple[str, ...] = ("sid",), order: int = ORDER) -> DataFrame:
    return stats.select(*keys, score(order, smooth=True).alias("gleu"))


def drawn_references(n_sentences: int, n_refs: int, iterations: int) -> list[tuple[int, int, int]]:
    """(iteration, sentence, reference) draws; each iteration has its own fixed seed."""
    out = []
    for j in range(iterations):
        rng = random.Random(j * 101)
        out += [(j, i, rng.randint(0, n_refs - 1)) for i in range(n_sentences)]
    return out


def multi_reference(stats: DataFrame, drawn: Callable[[Column, Column], Column], iterations: int = ITERATIONS) -> DataFrame:
    """Mean, deviation and 95 % interval of corpus GLEU over draws of references.

    ``stats`` has one row for each ``sid`` and ``ref_no``, made once; ``drawn`` gives the ``ref_no`` of a
    ``sid`` and an iteration.  Each row is summed into the iterations that draw it, so no draw is moved.
    """
    every = stats.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    each = corpus(every.filter(F.col("ref_no") == drawn(F.col("sid"), F.col("iteration"))), "iteration")
    out = each.agg(F.avg("gleu").alias("mean"), F.stddev_pop("gleu").alias("std"), F.count("*").alias("n"))
    half = 1.959963984540054 * F.col("std")
    return out.select("mean", F.when(F.col("n") > 1, F.col("std")).alias("std"), F.when(F.col("n") > 1, F.col("mean") - half).alias("low"), F.when(F.col("n") > 1, F.col("mean") + half).alias("high"))

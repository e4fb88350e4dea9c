"""Records of evaluation splits that also stand in the training split, by a weighted cosine join (p3).

A record is the vector of its three-character substrings, each of weight 1/sqrt(n), so that its norm is
1.  Jaccard similarity of at least t implies a cosine of at least 2t/(1+t), which is the threshold of the
join.  Inverted lists hold the terms of a vector, rare ones first, until two bounds say that the rest
alone cannot reach the threshold: the norm of the rest, and its weights times the largest weight that a
partner can have.  Lists join the evaluation side with the training side only; each meeting is pruned by
the residual norms and weights from its place on, and by the largest dot product that the parity
sketches allow.  What is left is decided by exact dot products over whole texts.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm import setjoin as J

THRESHOLD = Fraction(3, 5)
TRAIN, EVAL = 1, 2
#: Meetings of two vectors that are looked at together.
STRIDE = 1 << 20


def prefixes(t: Fraction) -> J.Prefixes:
    """Terms to index, until the residual norm or the residual weight sum is below the threshold."""
    c = float(2 * t / (1 + t))

    def posted(n: np.ndarray) -> np.ndarray:
        by_norm = np.ceil(c * c * n - 1e-9) - 1
        by_weight = np.ceil(c * float(t) ** 0.5 * n - 1e-9) - 1
        return (n - np.maximum(np.maximum(by_norm, by_weight), 0)).astype(np.int64)

    return J.Prefixes(posted, posted)


def kernel(t: Fraction):
    """Pairs of an evaluation and a training class within a partition that may reach the threshold."""
    c2 = (2 * t / (1 + t)) ** 2
    share = t / (1 + t)

    def run(p: J.Postings) -> tuple[np.ndarray, np.ndarray]:
        size = p.size
        target, query = np.flatnonzero(p.flag & TRAIN), np.flatnonzero(p.flag & EVAL)
        out: list[np.ndarray] = []
        if not len(target) or not len(query):
            return J.united(p, out)
        base = int(size.max()) + 2
        rank = p.token[target] * base + size[target]
        n = size[query]
        first = np.searchsorted(rank, p.token[query] * base + -(-n * t.numerator // t.denominator))
        last = np.searchsorted(rank, p.token[query] * base + np.minimum(n * t.denominator // t.numerator, base - 1), side="right")
        reach = np.maximum(last - first, 0)
        upto = np.cumsum(reach)
        total, at = int(upto[-1]), 0
        while at < total:  # meetings are numbered; those of one query may fall into several strides
            stop = min(total, at + STRIDE)
            number = np.arange(at, stop)
            who = np.searchsorted(upto, number, side="right")
            x = query[who]
            y = target[first[who] + number - (upto[who] - reach[who])]
            at = stop
            rest_x, rest_y = size[x] - p.place[x], size[y] - p.place[y]
            product = size[x] * size[y] * c2.numerator
            least = np.minimum(rest_x, rest_y)
            good = (rest_x * rest_y * c2.denominator >= product) & (least * least * c2.denominator >= product) & (x != y)
            x, y, least = x[good], y[good], least[good]
            both = size[x] + size[y]
            need = -(-both * share.numerator // share.denominator)
            bits = np.bitwise_count(p.sketch[x] ^ p.sketch[y]).sum(axis=1)
            good = (least >= need) & (both - bits >= 2 * need)
            out.append(J.hits(p, x[good], y[good]))
        return J.united(p, out)

    return run


def overlaps(pairs: DataFrame, threshold: Fraction = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of the splits with the names of their class, classes, pairs of similar classes)."""
    split = F.when(F.col("split") == "train", TRAIN).when(F.col("split").isin("val", "test"), EVAL)
    rows = J.named(pairs.withColumn("flag", split).filter("flag is not null"), "flag", "split", "source")
    made = J.classes(rows)
    return rows, made, J.verify(J.candidates(rows, made, prefixes(threshold), kernel(threshold)), made, threshold)


_KEY = ["cls", "cls2"]


def directed(made: DataFrame, close: DataFrame, *more: str) -> DataFrame:
    """Links from a class with rows in train (``_a``) to one with rows in val or test (``_b``), a class
    that has both linked to itself; with the numbers of these rows."""
    names = ("cls", "cls2", "rep")
    link = lambda a, b: F.struct(*(F.col(f"{c}{x}").alias(f"{c}_{y}") for x, y in ((a, "a"), (b, "b")) for c in names), F.col(f"n{a}").alias("n_a"), F.col(f"n2{b}").alias("n_b"))
    near = close.select(F.explode(F.array(link("_a", "_b"), link("_b", "_a"))).alias("l"), *more).select("l.*", *more)
    same = made.filter("n > 0 and n2 > 0").select(link("", "").alias("l"), *(F.lit(1.0).alias(c) for c in more)).select("l.*", *more)
    return same.unionByName(near.filter("n_a > 0 and n_b > 0"))


def found(pairs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """All pairs (``id_a`` < ``id_b``) of a row in train and one in val or test, same in form or similar.

    Rows of other or null splits and rows with a null ``src`` or ``tgt`` take no part.
    """
    rows, made, close = overlaps(pairs, threshold)
    both = J.members(directed(made, close), rows.filter(F.col("flag") == TRAIN), rows.filter(F.col("flag") == EVAL), _KEY)
    return both.filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def links(pairs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The overlaps as pairs of classes: the least id of each (over all its rows in the splits), its rows
    in train and in val or test, and the similarity.  ``p6_found`` names the rows of a class."""
    _, made, close = overlaps(pairs, threshold)
    return directed(made, close, "similarity").select(F.col("rep_a").alias("train_rep"), F.col("rep_b").alias("eval_rep"), F.col("n_a").alias("n_train"), F.col("n_b").alias("n_eval"), "similarity")


def report(pairs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Counts for each evaluation split and source: rows, rows with a same or similar row in train, links.

    A null source is a group of its own.  Rows are counted through their classes, never as pairs.
    """
    rows, made, close = overlaps(pairs, threshold)
    linked = directed(made, close).withColumn("same", (F.col("cls_a") == F.col("cls_b")) & (F.col("cls2_a") == F.col("cls2_b")))
    per = linked.groupBy(F.col("cls_b").alias("cls"), F.col("cls2_b").alias("cls2")).agg(F.sum(F.when(F.col("same"), F.col("n_a"))).alias("n_same"), F.sum(F.when(~F.col("same"), F.col("n_a"))).alias("n_near"))
    # rows of one class, split and source are counted together before they meet its links
    held = rows.filter(F.col("flag") == EVAL).groupBy(*_KEY, "split", "source").agg(F.count("*").alias("k")).join(per, _KEY, "left").fillna(0, ["n_same", "n_near"])
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    return held.groupBy("split", "source").agg(
        F.sum("k").alias("n_rows"), some(F.col("n_same") > 0).alias("n_same_rows"), some((F.col("n_same") > 0) | (F.col("n_near") > 0)).alias("n_overlap_rows"),
        F.sum(F.col("n_same") * F.col("k")).alias("n_same_links"), F.sum(F.col("n_near") * F.col("k")).alias("n_near_links"),
    )

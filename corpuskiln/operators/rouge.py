"""ROUGE-N by counts, ROUGE-L and ROUGE-W by Arrow functions, with the average, best and all modes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskiln.functions.text import common_count, grams, rouge_text, tokens


def prf(hyp: Column, ref: Column, common: Column, alpha: float = 0.5, weight: float = 1.0) -> list[Column]:
    """Precision, recall and F of counts."""
    ratio = lambda n: F.when(n == 0, 0.0).otherwise(F.pow(common / n, F.lit(1.0 / weight)) if weight != 1 else common / n)
    p, r = ratio(hyp), ratio(ref)
    f = F.when((p == 0) | (r == 0), 0.0).otherwise(p * r / ((1 - alpha) * p + alpha * r))
    return [p.alias("p"), r.alias("r"), f.alias("f")]


def n_counts(pairs: DataFrame, n: int, *keys: str) -> DataFrame:
    """Counts of n-grams of ``hyp`` and ``ref`` and of those in common, for each row."""
    words = pairs.select(*keys, *(tokens(rouge_text(F.col(s))).alias(s) for s in ("hyp", "ref")))
    rows = words.select(*keys, *(grams(F.col(s), n).alias(s) for s in ("hyp", "ref")))
    return rows.select(*keys, F.size("hyp").cast("long").alias("n_hyp"), F.size("ref").cast("long").alias("n_ref"), common_count(F.col("hyp"), F.col("ref")).cast("long").alias("n_common"))


def rouge_n(pairs: DataFrame, n: int, *keys: str, alpha: float = 0.5) -> DataFrame:
    return n_counts(pairs, n, *keys).select(*keys, *prf(F.col("n_hyp"), F.col("n_ref"), F.col("n_common"), alpha))


def hits(reference: Sequence[str], candidate: Sequence[str], weight: float) -> list[int]:
    """Places of the reference that a (weighted) longest common subsequence takes."""
    n, m = len(reference), len(candidate)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    run = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if reference[i - 1] == candidate[j - 1]:
                k = run[i - 1][j - 1]
                run[i][j] = k + 1
                best[i][j] = best[i - 1][j - 1] + (k + 1) ** weight - k**weight
            else:
                best[i][j] = max(best[i - 1][j], best[i][j - 1])
    out, i, j = [], n, m
    while i and j:
        if reference[i - 1] == candidate[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def subsequence_counts(candidates: Sequence[str], references: Sequence[str], weight: float = 1.0) -> tuple[float, float, float]:
    """(candidate, reference, common) counts of ROUGE-L, or of ROUGE-W for a weight other than 1.

    A word of the reference counts while the candidate has uses of it left.
    """
    left = Counter(w for s in candidates for w in s.split())
    n_candidate, n_reference, common = float(sum(left.values())), 0.0, 0.0
    if weight != 1:
        n_candidate **= weight
    for reference in references:
        words = reference.split()
        n_reference += len(words) ** weight
        mask = {i for c in candidates for i in hits(words, c.split(), weight)}
        stretch = 0
        for i in sorted(mask):
            if left[words[i]] > 0:
                left[words[i]] -= 1
                if weight == 1:
                    common += 1
                    continue
                stretch += 1
                if i + 1 not in mask:
                    common += stretch**weight
                    stretch = 0
    return n_candidate, n_reference**weight if weight != 1 else n_reference, common


_COUNTS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("n_hyp", "n_ref", "n_common")])


def subsequences(weight: float = 1.0):
    """Arrow function (hyp sentences, ref sentences) -> counts."""

    @F.pandas_udf(_COUNTS)
    def run(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([subsequence_counts(list(h), list(r), weight) for h, r in zip(hyp, ref)], columns=_COUNTS.names, dtype=float)

    return run.asNondeterministic()


def rouge_l(pairs: DataFrame, *keys: str, weight: float = 1.0, alpha: float = 0.5) -> DataFrame:
    """ROUGE-L (or -W) of ``hyp`` and ``ref``, whose lines are sentences."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), rouge_text), lambda s: F.trim(s) != "")
    counted = pairs.select(*keys, subsequences(weight)(lines("hyp"), lines("ref")).alias("x")).select(*keys, "x.*")
    return counted.select(*keys, *prf(F.col("n_hyp"), F.col("n_ref"), F.col("n_common"), alpha, weight))


def average(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in "prf"))


def best(scored: DataFrame, *keys: str) -> DataFrame:
    """The scores with the largest F of several references or candidates (ties: largest recall)."""
    top = F.max_by(F.struct("p", "r", "f"), F.struct("f", "r", "p")).alias("x")
    return scored.groupBy(*keys).agg(top).select(*keys, "x.*")


def listed(scored: DataFrame, *keys: str) -> DataFrame:
    """All scores of each key, in a fixed order."""
    return scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "r", "f"))).alias("scores"))

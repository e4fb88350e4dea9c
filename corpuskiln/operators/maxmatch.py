"""Scoring of corrections against gold edits by the edit lattice that matches gold best (MaxMatch).

Derived from the published description of the scorer: all minimal edit paths between source and system
tokens form a graph; arcs are joined over at most a few unchanged words; arcs that are gold edits get a
large negative weight; the lightest path names the system's edits.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskiln.util import partitions

Arc = tuple[str, int, int, str, str, int]  # kind, start, end, original, correction, unchanged words
EPSILON = 0.001


def _paths(source: Sequence[str], target: Sequence[str], swap: int) -> dict[tuple, Arc]:
    """Arcs ((i, j), (k, l)) of all minimal edit paths when a substitution costs ``swap``."""
    n, m = len(source), len(target)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    into: dict[tuple[int, int], list[tuple[tuple[int, int], Arc]]] = defaultdict(list)
    for i in range(n + 1):
        for j in range(m + 1):
            steps = []
            if i and j:
                same = source[i - 1] == target[j - 1]
                kind = ("noop", i - 1, i, source[i - 1], target[j - 1], 1) if same else ("sub", i - 1, i, source[i - 1], target[j - 1], 0)
                steps.append((cost[i - 1][j - 1] + (0 if same else swap), (i - 1, j - 1), kind))
            if i:
                steps.append((cost[i - 1][j] + 1, (i - 1, j), ("del", i - 1, i, source[i - 1], "", 0)))
            if j:
                steps.append((cost[i][j - 1] + 1, (i, j - 1), ("ins", i, i, "", target[j - 1], 0)))
            if steps:
                cost[i][j] = min(s[0] for s in steps)
                into[i, j] = [s[1:] for s in steps if s[0] == cost[i][j]]
    arcs, seen, wait = {}, {(n, m)}, [(n, m)]
    for here in wait:
        for before, arc in into[here]:
            arcs[before, here] = arc
            if before not in seen:
                seen.add(before)
                wait.append(before)
    return arcs


def _join(a: Arc, b: Arc) -> Arc:
    kind = a[0] if a[0] == b[0] and a[0] != "sub" else "sub"
    text = lambda x, y: f"{x} {y}" if x and y else x or y
    return kind, a[1], b[2], text(a[3], b[3]), text(a[4], b[4]), a[5] + b[5]


class Lattice:
    """The edit graph of a source and a system sentence."""

    def __init__(self, source: Sequence[str], target: Sequence[str], most_unchanged: int = 2, swaps: Sequence[int] = (1, 2)) -> None:
        graphs = [_paths(source, target, s) for s in swaps]
        self.goal = (len(source), len(target))
        arcs: dict[tuple, Arc] = {}
        for g in graphs:
            arcs.update(g)
        # an arc of both graphs is listed twice, and so bears its small weight twice
        listed = sorted(e for g in graphs for e in g)
        length = {e: 1 for e in arcs}
        nodes = sorted({v for e in arcs for v in e} | {(0, 0), self.goal})
        before, after = defaultdict(list), defaultdict(list)
        for a, b in sorted(arcs):
            before[b].append(a)
            after[a].append(b)
        extra = []
        for k in nodes:
            for i in sorted(before[k]):
                for j in sorted(after[k]):
                    total = length[i, k] + length[k, j]
                    if total < length.get((i, j), float("inf")):
                        joined = _join(arcs[i, k], arcs[k, j])
                        if joined[5] <= most_unchanged:
                            if (i, j) not in length:
                                before[j].append(i)
                                after[i].append(j)
                                extra.append((i, j))
                            length[i, j], arcs[i, j] = total, joined
        # joined unchanged words are taken out while the list is being read: the next entry is passed over
        order = listed + extra
        at = 0
        while at < len(order):
            e = order[at]
            if arcs[e][0] == "noop" and length[e] > 1:
                order.pop(at)
            at += 1
        self.order, self.arcs, self.length = order, arcs, length
        self.nodes = nodes

    def _is(self, e: tuple, g: tuple) -> bool:
        return self.arcs[e][3] == g[2] and self.arcs[e][4] in g[3]

    def _weigh_insertions(self, here: list[tuple], wanted: list[tuple], weight: dict[tuple, float]) -> None:
        """Weights of the insertions at one place, whose order matters: arcs are read from both ends in
        turn, each gold edit serves once, and after a match only an arc that joins on comes next."""
        rest, gold = deque(here), deque(wanted)
        left = True
        while rest:
            left = left or len(rest) == 1
            e = rest.popleft() if left else rest.pop()
            taken = next((i for i in (range(len(gold)) if left else reversed(range(len(gold)))) if self._is(e, gold[i])), None)
            if taken is None:
                if self.arcs[e][0] != "noop":
                    weight[e] += EPSILON
                left = not left
                continue
            weight[e] = -float(len(self.order))
            kept = list(gold)
            gold = deque(kept[taken + 1 :] if left else kept[:taken])
            while rest and (rest[0][0] != e[1] if left else rest[-1][1] != e[0]):
                weight[rest.popleft() if left else rest.pop()] += EPSILON

    def best(self, gold: Sequence[tuple[int, int, str, Sequence[str]]]) -> list[Arc]:
        """The edits of the lightest path, gold edits (start, end, original, corrections) being preferred."""
        weight = {e: float(self.length[e]) for e in self.order}
        places: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        for e in self.order:
            places[self.arcs[e][1:3]].append(e)
        for (start, end), here in places.items():
            wanted = [g for g in gold if (g[0], g[1]) == (start, end)]
            if start == end:
                self._weigh_insertions(sorted(here), wanted, weight)
                continue
            for e in here:
                if any(self._is(e, g) for g in wanted):
                    weight[e] = -float(len(self.order))
                elif self.arcs[e][0] != "noop":
                    weight[e] += EPSILON
        far = {v: float("inf") for v in self.nodes}
        far[0, 0] = 0.0
        came: dict[tuple, tuple] = {}
        for _ in range(len(self.nodes)):
            moved = False
            for e in self.order:
                a, b = e
                if far[a] + weight[e] < far[b]:
                    far[b], came[b], moved = far[a] + weight[e], a, True
            if not moved:
                break
        path, at = [], self.goal
        while at in came:
            path.append(self.arcs[came[at], at])
            at = came[at]
        return [arc for arc in reversed(path) if arc[0] != "noop"]


def matches(found: Sequence[Arc], gold: Sequence[tuple[int, int, str, Sequence[str]]], loose: bool = False) -> int:
    """How many edits are gold edits, both read once from left to right."""
    bare = (lambda s: s.replace(" ", "").lower()) if loose else (lambda s: s)
    cursor = correct = 0
    for kind, start, end, original, correction, _ in found:
        for i in range(cursor, len(gold)):
            g = gold[i]
            if g[0] == start and g[1] == end and bare(g[2]) == bare(original) and bare(correction) in [bare(c) for c in g[3]]:
                correct, cursor = correct + 1, i + 1
                break
    return correct


def system_edits(source: str, system: str, most_unchanged: int = 0) -> list[tuple[int, int, str, str]]:
    """(start, end, original, correction) of a system's changes, without any gold edits."""
    if source.split() == system.split():
        return []
    return [(a[1], a[2], a[3], a[4]) for a in Lattice(source.split(), system.split(), most_unchanged).best([])]


_COUNTS = T.StructType([T.StructField("correct", T.IntegerType()), T.StructField("proposed", T.IntegerType()), T.StructField("gold", T.IntegerType())])


def counts(most_unchanged: int = 2, loose: bool = False, swaps: Sequence[int] = (1, 2)):
    """Arrow function (source, system, gold edits) -> correct, proposed and gold edits.

    Gold edits are structs of start, end, original and corrections.  ``loose`` leaves out changes of
    case and space and ignores both in comparing.
    """

    @F.pandas_udf(_COUNTS)
    def run(source: pd.Series, system: pd.Series, gold: pd.Series) -> pd.DataFrame:
        out = []
        for s, h, g in zip(source, system, gold):
            wanted = [(e["start"], e["end"], e["original"], list(e["corrections"])) for e in (g if g is not None else [])]
            # equal texts have no edits, whatever the gold ones are
            found = Lattice(s.split(), h.split(), most_unchanged, swaps).best(wanted) if s.split() != h.split() else []
            if loose:
                bare = lambda x: x.replace(" ", "").lower()
                found = [a for a in found if bare(a[3]) != bare(a[4])]
            out.append((matches(found, wanted, loose), len(found), len(wanted)))
        return pd.DataFrame(out, columns=_COUNTS.names, dtype="int32")

    return run


_UNK = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cat", T.StringType()), T.StructField("cor", T.StringType())]))


@F.pandas_udf(_UNK)
def created_edits(source: pd.Series, system: pd.Series) -> pd.Series:
    """A system's changes as edits of type UNK."""
    return pd.Series([[{"start": a, "end": b, "cat": "UNK", "cor": c} for a, b, _, c in system_edits(s, h)] for s, h in zip(source, system)], dtype=object)


created_edits = created_edits.asNondeterministic()  # so that it is planned once


def scores(correct: Column, proposed: Column, gold: Column, beta: float = 0.5) -> list[Column]:
    """precision, recall and F of sums, with 1 for nothing proposed or nothing to find."""
    p = F.when(proposed == 0, 1.0).otherwise(correct / proposed)
    r = F.when(gold == 0, 1.0).otherwise(correct / gold)
    b = beta * beta
    f = F.when(b * p + r == 0, 0.0).otherwise((1 + b) * p * r / (b * p + r))
    return [p.alias("precision"), r.alias("recall"), f.alias("f_score")]


def single(counted: DataFrame, beta: float = 0.5) -> DataFrame:
    """Corpus scores of rows with ``correct``, ``proposed`` and ``gold``."""
    total = counted.agg(*(F.sum(c).cast("long").alias(c) for c in _COUNTS.names))
    return total.select(*_COUNTS.names, *scores(F.col("correct"), F.col("proposed"), F.col("gold"), beta))


def running(counted: DataFrame, ranges: int | None = None) -> DataFrame:
    """Cumulative counts in the order of ``sid``.

    Rows are summed by ranges of ``sid`` (between quantiles), and numbered on within their range, so that
    no task reads all of them.
    """
    n = ranges or partitions(counted.sparkSession)
    bounds = sorted(set(counted.approxQuantile("sid", [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    at = sum((F.when(F.col("sid") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    rows = counted.withColumn("range", at)
    sums = rows.groupBy("range").agg(*(F.sum(c).alias(f"all_{c}") for c in _COUNTS.names))  # one row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", *(F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in _COUNTS.names))
    upto = Window.partitionBy("range").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(sums), "range").select("sid", *((F.col(f"before_{c}") + F.sum(c).over(upto)).alias(c) for c in _COUNTS.names))


def choose(rows: Iterator[tuple[int, list[tuple[int, int, int]]]], beta: float = 0.5) -> tuple[int, int, int]:
    """Sums when for each sentence, in order, the annotator is taken that makes the sums so far score best."""
    b, c0, p0, g0 = beta * beta, 0, 0, 0
    for _, options in rows:
        best = None
        for c, p, g in options:
            c, p, g = c0 + c, p0 + p, g0 + g
            weight = b * g + p
            f = (1 + b) * c / weight if weight else (1.0 if c == 0 else 0.0)
            rank = (f, c, -(p + b * g))
            if best is None or rank > best[0]:
                best = rank, (c, p, g)
        if best:
            c0, p0, g0 = best[1]
    return c0, p0, g0


def multi(counted: DataFrame, beta: float = 0.5) -> DataFrame:
    """Corpus scores with several annotators: rows of ``sid``, ``annotator_no`` and their counts.

    The choice for a sentence depends on all before it, so the counts (a few numbers for each sentence)
    are read in order by one task, which holds no more than the running sums.
    """
    lines = counted.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("annotator_no", *_COUNTS.names))).alias("options"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for sid, options in zip(batch.column("sid").to_pylist(), batch.column("options").to_pylist()):
                    yield sid, [(o["correct"], o["proposed"], o["gold"]) for o in options]

        c, p, g = choose(rows(), beta)
        yield pa.RecordBatch.from_pydict({"correct": pa.array([c], pa.int64()), "proposed": pa.array([p], pa.int64()), "gold": pa.array([g], pa.int64())})

    ordered = lines.repartitionByRange(1, "sid").sortWithinPartitions("sid")
    return ordered.mapInArrow(fold, "correct long, proposed long, gold long").select(*_COUNTS.names, *scores(F.col("correct"), F.col("proposed"), F.col("gold"), beta))

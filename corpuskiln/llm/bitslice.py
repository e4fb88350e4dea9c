"""Near-duplicate records by bit-sliced comparison of sketches (p7).

Within the postings of a token, 64 sketches stand side by side: word k of a block holds bit k of each of
them.  A query compares itself with a whole block by one XOR for each bit plane; carry-save adders keep
64 distance counters in vertical form.  After every 32 planes, blocks in which all counters exceed their
radius are abandoned.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm import setjoin as J
from corpuskiln.util import cut

U = np.uint64
THRESHOLD = Fraction(3, 5)
#: Comparisons of one query with one block that are made at a time.
STRIDE = 1 << 15
_ALL = U(0xFFFFFFFFFFFFFFFF)


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: (carry, sum) of three bit vectors."""
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def _exceeds(counter: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """The lanes whose vertical counter is above the radius of their row."""
    above = np.zeros(len(radius), U)
    level = np.full(len(radius), _ALL)
    for k in range(len(counter) - 1, -1, -1):
        bound = (U(0) - ((radius >> U(k)) & U(1))).astype(U)
        above |= level & counter[k] & ~bound
        level &= ~(counter[k] ^ bound)
    return above


def planes(sketch: np.ndarray) -> np.ndarray:
    """Bit planes (blocks, bits) of sketches (rows, words), 64 rows to a block."""
    rows, bits = len(sketch), J.SKETCH_BITS
    out = np.empty((-(-rows // 64), bits), U)
    for at in range(0, len(out), 1024):
        some = sketch[at * 64 : (at + 1024) * 64]
        flat = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little")[:, :bits]
        if len(flat) % 64:
            flat = np.concatenate([flat, np.zeros((64 - len(flat) % 64, bits), np.uint8)])
        lanes = np.packbits(flat.reshape(-1, 64, bits), axis=1, bitorder="little")  # (blocks, 8, bits)
        out[at : at + len(lanes)] = np.ascontiguousarray(lanes.transpose(0, 2, 1)).view(U)[:, :, 0]
    return out


def compare(plane: np.ndarray, block: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The lanes of ``block`` within ``radius`` of each query sketch (rows, words)."""
    live = np.arange(len(block))
    result = np.zeros(len(block), U)
    bits = plane.shape[1]
    counter = [np.zeros(len(block), U) for _ in range(bits.bit_length())]
    for k in range(0, bits, 8):
        x = [plane[block, k + j] ^ (U(0) - ((query[:, (k + j) // 64] >> U((k + j) % 64)) & U(1))) for j in range(8)]
        two_a, one = _csa(counter[0], x[0], x[1])
        two_b, one = _csa(one, x[2], x[3])
        four_a, two = _csa(counter[1], two_a, two_b)
        two_a, one = _csa(one, x[4], x[5])
        two_b, counter[0] = _csa(one, x[6], x[7])
        four_b, counter[1] = _csa(two, two_a, two_b)
        carry, counter[2] = _csa(counter[2], four_a, four_b)
        for j in range(3, len(counter)):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        if (k + 8) % 32 == 0 or k + 8 >= bits:
            lanes = lanes & ~_exceeds(counter, radius)
            stay = lanes != 0
            if k + 8 >= bits:
                result[live] = lanes
            elif not stay.all():
                live, block, query, lanes, radius = live[stay], block[stay], query[stay], lanes[stay], radius[stay]
                counter = [c[stay] for c in counter]
                if not len(live):
                    break
    return result


def _prefix(share: Fraction):
    return lambda n: n - (n * share.numerator + share.denominator - 1) // share.denominator + 1


def prefixes(t: Fraction) -> J.Prefixes:
    """Post what the larger set of a pair must show, index what the smaller one must."""
    return J.Prefixes(_prefix(t), _prefix(2 * t / (1 + t)))


def kernel(t: Fraction):
    """Pairs of classes within a partition whose sketches allow a similarity of t."""
    indexed = prefixes(t).indexed
    share = t / (1 + t)  # common tokens that a pair needs, of the sum of both sizes

    def run(p: J.Postings) -> tuple[np.ndarray, np.ndarray]:
        size = p.size
        is_index = p.place < indexed(size)
        lane = np.flatnonzero(is_index)
        base = int(size.max()) + 2
        rank = p.token[lane] * base + size[lane]
        low = -(-size * t.numerator // t.denominator)
        first = np.searchsorted(rank, p.token * base + low)
        last = np.searchsorted(rank, p.token * base + size, side="right")
        plane = planes(p.sketch[lane])
        # a query with the blocks that its lanes lie in
        reach = np.where(last > first, (np.maximum(last, 1) - 1) // 64 - first // 64 + 1, 0)
        out: list[np.ndarray] = []
        upto = np.cumsum(reach)
        at = 0
        while at < len(reach):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STRIDE, side="right")))
            n = reach[at:stop]
            ask = np.repeat(np.arange(at, stop), n)
            at = stop
            if not len(ask):
                continue
            for cut_at in range(0, len(ask), STRIDE * 4):
                q = ask[cut_at : cut_at + STRIDE * 4]
                offset = (np.arange(len(ask)) - np.repeat(np.cumsum(n) - n, n))[cut_at : cut_at + STRIDE * 4]
                block = first[q] // 64 + offset
                a, b = np.maximum(first[q] - block * 64, 0), np.minimum(last[q] - block * 64, 64)
                lanes = (_ALL << a.astype(U)) & (_ALL >> (64 - b).astype(U))
                nearest = size[lane[block * 64 + b - 1]]
                radius = np.minimum((size[q] + nearest) * (share.denominator - 2 * share.numerator) // share.denominator, plane.shape[1]).astype(U)
                left = compare(plane, block, p.sketch[q], lanes, radius)
                some = np.flatnonzero(left)
                if not len(some):
                    continue
                hit = np.unpackbits(left[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, col = np.nonzero(hit)
                x, y = q[some[row]], lane[block[some[row]] * 64 + col]
                need = -(-(size[x] + size[y]) * share.numerator // share.denominator)
                bits = np.bitwise_count(p.sketch[x] ^ p.sketch[y]).sum(axis=1)
                # tokens before the first common one are not shared, so places bound what is
                good = (x != y) & (np.minimum(size[x] - p.place[x], size[y] - p.place[y]) >= need) & (bits <= size[x] + size[y] - 2 * need)
                out.append(J.hits(p, x[good], y[good]))
        return J.united(p, out)

    return run


def similar_classes(pairs: DataFrame, threshold: Fraction = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the names of their class, classes, pairs of similar classes with their similarity)."""
    rows = J.named(pairs).withColumn("flag", F.lit(0))
    made = J.classes(rows)
    return rows, made, J.verify(J.candidates(rows, made, prefixes(threshold), kernel(threshold)), made, threshold)


def found(pairs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """All pairs of rows (``id_a`` < ``id_b``) that are similar but not the same in form.

    Rows with a null ``src`` or ``tgt`` take no part; a record without any three-character substring is
    similar to none.  Repeated rows of one id give one pair.  Other columns are ignored.
    """
    rows, _, close = similar_classes(pairs, threshold)
    both = J.members(close, rows, rows, ["cls", "cls2"])
    return both.filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def links(pairs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Pairs of similar classes, each named by the least id of its rows, with their rows and similarity.

    ``p6_found`` names the rows of a class, so nothing is lost against ``found``, and a record's copies
    are not multiplied.
    """
    _, _, close = similar_classes(pairs, threshold)
    return close.select("rep_a", "rep_b", "n_a", "n_b", "similarity")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating stars until nothing changes.

    ``edges`` has the columns ``a`` and ``b``.  Each round is cut by a checkpoint in the shared folder.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small)
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def groups(pairs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row for each record: ``pair_id``, ``group_id`` (the smallest id that a chain of copies and
    similar records reaches) and ``n_links``, the number of similar texts.  Null records take no part."""
    rows, made, close = similar_classes(pairs, threshold)
    close = cut(close.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    n_links = close.select(F.col("a").alias("rep")).union(close.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    root = components(close).withColumnRenamed("node", "rep")
    # the least id of a component is the least of its classes' least ids
    placed = made.select("cls", "cls2", "rep").join(root, "rep", "left").join(n_links, "rep", "left").select("cls", "cls2", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("pair_id", "cls", "cls2").join(placed, ["cls", "cls2"]).select("pair_id", "group_id", "n_links")

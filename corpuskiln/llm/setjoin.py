"""Candidates of an exact similarity join over the three-character substrings of two keys.

Rows that are equal in both keys are one class before anything is posted: each task merges the copies it
sees, and one exchange merges what is left, so a record costs the same however many copies it has.

Tokens are put into one global order, rare ones first, by a count over all classes in a fixed number of
slots (so the table that every task receives has a constant size).  Two sets with Jaccard similarity of
at least t share a token among the first |x| - ceil(t |x|) + 1 tokens of each (prefix principle), which
holds for any global order; so only these tokens are posted.  A posting is a record of fixed width that
stands for itself: token, class, size and place, and a parity sketch of the class.  Its width does not
depend on the number of partitions.  A token so frequent that its list would not fit a task is spread
over a triangle of cells, each meeting two chunks of its classes.

Bit b of a sketch is the parity of the number of tokens that hash to b.  The sketches of two sets differ
in at most as many bits as the sets differ in tokens, so a Hamming distance above the largest difference
that t allows rules a pair out without loss.

Postings name a class by 40 bits of hash.  Classes that share a name only bring candidates of their own:
``verify`` joins all texts of a name and decides by the texts, and it names classes by 128 bits and by the
smallest id of their rows from there on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.forms import keyed
from corpuskiln.util import cut, partitions

SLOT_BITS = 20
SKETCH_BITS = 112
NAME_BITS, CLASS_BITS = 22, 40
#: Postings of one token that one cell may hold of each chunk; longer lists are spread over cells.
CHUNK = 1 << 16
#: Postings that one partition should hold.
PER_PARTITION = 700_000

#: Records and characters that are taken apart at a time.
ROWS, CHARACTERS = 8192, 1 << 22
#: Rows whose copies a task merges at a time, and postings that it sorts by partition at a time.
MERGED, SENT = 1 << 16, 1 << 20

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of each element."""
    x = x + _M1
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct elements, by sorting, which for words is far cheaper than hashing."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ROWS records and, but for single longer ones, CHARACTERS characters."""
    upto = np.cumsum([pc.add(pc.utf8_length(batch.column("ka")), pc.utf8_length(batch.column("kb"))).to_numpy(zero_copy_only=False)]) if batch.num_rows else np.empty(0, np.int64)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHARACTERS, side="right"))
        stop = min(max(stop, at + 1), at + ROWS)
        yield batch.slice(at, stop - at)
        at = stop


def tokens(batch: pa.RecordBatch) -> np.ndarray:
    """Sorted distinct record << 40 | 40-bit token over a batch of up to 2**14 records."""
    texts = [x for pair in zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist()) for x in pair]
    cps = code_points(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(cps) < 3:
        return np.empty(0, U)
    rec = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(cps))  # characters to the end of the text
    packed = cps[:-2] | (cps[1:-1] << U(21)) | (cps[2:] << U(42))
    full = left[:-2] >= 3
    return distinct((mix(packed[full]) >> U(24)) | ((rec[:-2][full] >> 1).astype(U) << U(40)))


def _merged(batches: Iterator[pa.RecordBatch], by: list[str], sums: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Rows grouped by ``by``, some MERGED rows at a time."""
    held, rows, size = [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(held).group_by(by, use_threads=False).aggregate(sums).combine_chunks().to_batches()

    for batch in batches:
        for some in slices(batch):
            held.append(some)
            rows, size = rows + some.num_rows, size + some.nbytes
            if rows >= MERGED or size >= CHARACTERS * 8:
                yield from flush()
                held, rows, size = [], 0, 0
    if held:
        yield from flush()


def _merge_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _merged(batches, ["cls", "ka", "kb", "flag"], [("pair_id", "min"), ("pair_id", "count")]):
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("cls", "ka", "kb", "flag", "pair_id_min", "pair_id_count")], names=["cls", "ka", "kb", "flag", "rep", "n"])


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in _merged(batches, ["ka", "kb"], []):
        for some in slices(batch):
            t = tokens(some)
            table += np.bincount(((t & U((1 << 40) - 1)) >> U(40 - SLOT_BITS)).astype(np.int64), minlength=len(table))
    wide = bool(table.max(initial=0) >= 2**32)
    for i, part in enumerate(np.split(table, 64)):
        yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "counts": pa.array([part.astype(U if wide else np.uint32).tobytes()], pa.binary()), "wide": pa.array([wide])})


def _sum_slots(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SLOT_BITS) // 64, np.int64)
    for batch in batches:
        for counts, wide in zip(batch.column("counts").to_pylist(), batch.column("wide").to_pylist()):
            total += np.frombuffer(counts, U if wide else np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def slot_counts(rows: DataFrame) -> np.ndarray:
    """How many records hold a token of each slot: 2**20 numbers, whatever the size of the data.

    Copies that one task sees together count once.  The numbers only order tokens and tell frequent ones.
    """
    parts = rows.select("ka", "kb").mapInArrow(_count_slots, "part int, counts binary, wide boolean")
    summed = parts.groupBy("part").applyInArrow(_sum_slots, "part int, counts binary").collect()
    total = np.zeros((64, (1 << SLOT_BITS) // 64), np.int64)
    for row in summed:
        total[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return total.ravel()


@dataclass(frozen=True)
class Prefixes:
    """How many of the rarest tokens of a set of n are posted, and how many of these are indexed."""

    posted: Callable[[np.ndarray], np.ndarray]
    indexed: Callable[[np.ndarray], np.ndarray]


    def share(self) -> float:
        """The part of a large set's tokens that is posted."""
        return float(self.posted(np.array([1 << 20]))[0]) / (1 << 20)


@dataclass
class Postings:
    """The postings of one partition, sorted by token and set size; every column is one of postings."""

    names: np.ndarray  # the names of the classes that occur
    cls: np.ndarray  # place of the class in ``names``
    size: np.ndarray
    flag: np.ndarray
    sketch: np.ndarray  # (postings, 2) words
    token: np.ndarray  # token number, ascending
    place: np.ndarray  # place of the token in its set


_BLOB = "p int, wide boolean, blob binary"
_WORDS = -(-SKETCH_BITS // 64)


def _row(wide: bool) -> np.dtype:
    """One posting: name and flag, class, size and place, sketch."""
    number = np.uint32 if wide else np.uint8
    return np.dtype([("name", np.uint8, 3), ("cls", np.uint8, CLASS_BITS // 8), ("size", number), ("place", number), ("sketch", np.uint8, SKETCH_BITS // 8)])


def _order(freq: np.ndarray) -> np.ndarray:
    return np.minimum(1023, np.round(np.log2(freq + 1.0) * 24)).astype(U)


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n]


def _whole(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view("<u8").ravel()


def _emit(freq: np.ndarray, prefixes: Prefixes, n_parts: int) -> Callable:
    order = _order(freq)
    low40 = U((1 << 40) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        for whole in batches:
            for batch in slices(whole):
                for wide, part, rows in post(batch):
                    held[wide].append((part, rows))
                    if sum(len(p) for p, _ in held[wide]) >= SENT:
                        yield send(wide, held[wide])
                        held[wide] = []
        for wide, some in held.items():
            if some:
                yield send(wide, some)

    def send(wide: bool, some: list) -> pa.RecordBatch:
        part, rows = (np.concatenate(x) for x in zip(*some))
        by = np.argsort(part, kind="stable")
        part, rows = part[by], rows[by]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        blobs = [rows[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(part)))]
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array([wide] * len(blobs)), pa.array(blobs, pa.binary())], names=["p", "wide", "blob"])

    def post(batch: pa.RecordBatch) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        n = batch.num_rows
        t = tokens(batch)
        if not len(t):
            return
        cls = batch.column("cls").to_numpy(zero_copy_only=False).view(U)
        flag = batch.column("flag").to_numpy(zero_copy_only=False).astype(U)
        rec, tok = (t >> U(40)).astype(np.int64), t & low40
        size = np.bincount(rec, minlength=n)
        bit = (tok % U(SKETCH_BITS)).astype(np.int64)
        sketch = np.packbits((np.bincount(rec * SKETCH_BITS + bit, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)
        slot = (tok >> U(40 - SLOT_BITS)).astype(np.int64)
        sorted_ = np.sort((rec.astype(U) << U(50)) | (order[slot] << U(40)) | tok)
        tok = sorted_ & low40
        place = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
        count = freq[(tok >> U(40 - SLOT_BITS)).astype(np.int64)]
        take = (place < np.repeat(prefixes.posted(size), size)) & (count > 1)  # a token of one record meets no other
        rec, tok, place, count = rec[take], tok[take], place[take], count[take]
        name = mix(tok)
        hot = np.flatnonzero(count > CHUNK)
        if len(hot):
            chunks = -(-count[hot] // CHUNK)
            own = (mix(cls[rec[hot]]) % chunks.astype(U)).astype(np.int64)
            again = np.repeat(np.arange(len(hot)), chunks)
            other = np.arange(len(again)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            a, b = np.minimum(own[again], other), np.maximum(own[again], other)
            cool = count <= CHUNK
            cells = mix(name[hot][again] ^ mix((U(1) + a.astype(U)) << U(32) | b.astype(U)))
            rec, place = (np.concatenate([x[cool], x[hot][again]]) for x in (rec, place))
            name = np.concatenate([name[cool], cells])
        part = (name >> U(32)) % U(n_parts)
        marked = (name & U((1 << NAME_BITS) - 1)) | (flag[rec] << U(NAME_BITS))
        for wide in (False, True):
            own = np.flatnonzero((size[rec] > 255) == wide)
            if len(own):
                rows = np.empty(len(own), _row(wide))
                rows["name"], rows["cls"] = _low_bytes(marked[own], 3), _low_bytes(cls[rec[own]], CLASS_BITS // 8)
                rows["size"], rows["place"], rows["sketch"] = size[rec[own]], place[own], sketch[rec[own]]
                yield wide, part[own], rows

    return run


def unpack(blobs: list[tuple[bool, bytes]]) -> Postings | None:
    """The postings of a partition, those of a token that none shares left out."""
    parts = []
    for wide in (False, True):
        if own := b"".join(b for w, b in blobs if w == wide):
            rows = np.frombuffer(own, _row(wide))
            sketch = np.zeros((len(rows), _WORDS * 8), np.uint8)
            sketch[:, : SKETCH_BITS // 8] = rows["sketch"]
            parts.append((_whole(rows["name"]), _whole(rows["cls"]), rows["size"].astype(np.int64), rows["place"].astype(np.int64), sketch))
    if not parts:
        return None
    marked, cls, size, place, sketch = (np.concatenate(x) for x in zip(*parts))
    name, flag = marked & U((1 << NAME_BITS) - 1), (marked >> U(NAME_BITS)).astype(np.uint8)
    by = np.argsort((name << U(40)) | np.minimum(size, (1 << 40) - 1).astype(U), kind="stable")
    name = name[by]
    starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    lengths = np.diff(np.append(starts, len(name)))
    keep = np.repeat(lengths > 1, lengths)
    by = by[keep]
    names, inverse = np.unique(cls[by], return_inverse=True)
    return Postings(names.view(np.int64), inverse.ravel(), size[by], flag[by], np.ascontiguousarray(sketch[by]).view(U), np.repeat(np.arange(len(starts)), lengths)[keep], place[by])


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def candidates(rows: DataFrame, made: DataFrame, prefixes: Prefixes, kernel: Callable[[Postings], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Distinct pairs (a <= b) of class names that the kernel leaves.

    ``rows`` has ``ka`` and ``kb``; ``made`` are their classes, with a ``flag`` of up to two bits.
    """
    freq = slot_counts(rows)
    n_parts = max(min(partitions(rows.sparkSession), 8), math.ceil(int(freq.sum()) * prefixes.share() / PER_PARTITION))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in zip(batch.column("wide").to_pylist(), batch.column("blob").to_pylist())]
        postings = unpack(blobs)
        del blobs
        if postings is None or not len(postings.token):
            return
        a, b = kernel(postings)
        if len(a):
            yield _pairs_batch(postings.names[a], postings.names[b])

    # all columns, so that the exchange of the classes is the one that ``verify`` reads as well
    packed = made.drop("cls2").mapInArrow(_emit(freq, prefixes, n_parts), _BLOB)
    return packed.repartitionById(n_parts, F.col("p")).select("wide", "blob").mapInArrow(join, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hits(p: Postings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distinct pairs of classes, as one number each, of postings that met."""
    a, b = p.cls[x], p.cls[y]
    return distinct(np.minimum(a, b) * len(p.names) + np.maximum(a, b))


def united(p: Postings, out: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found = distinct(np.concatenate(out)) if out else np.empty(0, np.int64)
    return found // len(p.names), found % len(p.names)


def named(pairs: DataFrame, *others: str) -> DataFrame:
    """Rows with their keys and the names of the class they share with rows that are the same in form.

    ``cls`` is the short name that postings carry; ``cls`` and ``cls2`` together name a class.
    """
    return keyed(pairs, *others).withColumns({"cls": F.shiftrightunsigned(F.xxhash64("ka", "kb"), 64 - CLASS_BITS), "cls2": _second()})


def _second():
    return F.xxhash64(F.lit("second"), "kb", "ka")


def classes(rows: DataFrame) -> DataFrame:
    """One row for each class of ``rows`` (``flag`` 0 to 3): names, keys, ``rep`` (the smallest id), the
    number of rows whose flag has bit 1 or none (``n``) and bit 2 (``n2``), and all flags as one.

    Copies are merged within each task before the one exchange, so no class gathers its rows in one task.
    """
    part = rows.select("cls", "ka", "kb", F.col("flag").cast("int").alias("flag"), "pair_id").mapInArrow(_merge_copies, "cls long, ka string, kb string, flag int, rep long, n long")
    one = part.filter("cls is not null").repartition("cls").groupBy("cls", "ka", "kb")
    # every aggregate reads every column, so that all users of the classes ask for one and the same exchange
    whole = F.col("flag").isNotNull() & F.col("rep").isNotNull() & F.col("n").isNotNull()
    rows_of = lambda c: F.coalesce(F.sum(F.when(whole & c, F.col("n"))), F.lit(0))
    made = one.agg(F.bit_or(F.when(whole, F.col("flag"))).alias("flag"), F.min(F.when(whole, F.col("rep"))).alias("rep"), rows_of(F.col("flag") != 2).alias("n"), rows_of(F.col("flag") >= 2).alias("n2"))
    return made.withColumn("cls2", _second())


def _grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


_SIDE = ("cls", "cls2", "rep", "flag", "n", "n2")


def _similarities(threshold: Fraction) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sims, dots = [], [], []
            for i, (a, b, c, d) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("ka_a", "kb_a", "ka_b", "kb_b")))):
                x, y = _grams(a) | _grams(b), _grams(c) | _grams(d)
                common = len(x & y)
                union = len(x) + len(y) - common
                if union and common * threshold.denominator >= threshold.numerator * union:
                    keep.append(i)
                    sims.append(common / union)
                    dots.append(common / math.sqrt(len(x) * len(y)))
            if keep:
                names = [f"{c}_{x}" for x in "ab" for c in _SIDE]
                picked = batch.select(names).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(sims, pa.float64()), pa.array(dots, pa.float64())], names=[*names, "similarity", "cosine"])

    return run


def verify(pairs: DataFrame, made: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of classes (``rep_a`` < ``rep_b``) with what names and counts them, their exact similarity
    and cosine; those below the threshold left out.  Decided by the texts of all classes of both names.
    """
    side = lambda x: made.select(*(F.col(c).alias(f"{c}_{x}") for c in (*_SIDE, "ka", "kb")))
    both = pairs.join(side("a"), F.col("a") == F.col("cls_a")).join(side("b"), F.col("b") == F.col("cls_b"))
    both = both.filter((F.col("rep_a") < F.col("rep_b")) | ((F.col("rep_a") > F.col("rep_b")) & (F.col("a") != F.col("b"))))
    kinds = {"flag": "int"}
    ddl = ", ".join(f"{c}_{x} {kinds.get(c, 'long')}" for x in "ab" for c in _SIDE) + ", similarity double, cosine double"
    close = both.mapInArrow(_similarities(threshold), ddl)
    # the class of the smaller id stands first
    swap = F.col("rep_a") > F.col("rep_b")
    ordered = [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in _SIDE]
    return close.select(*ordered, "similarity", "cosine")


#: Rows of a class that one cell of ``members`` holds.
CELL = 1 << 11


def members(links: DataFrame, left: DataFrame, right: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of ids (``x``, ``y``) of linked classes, with the key columns named in ``keep``.

    ``links`` names classes by ``<key>_a`` and ``<key>_b`` and gives their numbers of rows ``n_a`` and
    ``n_b``; ``left`` and ``right`` have the key columns and ``pair_id``.  Classes of many rows are cut
    into chunks by a hash of the id, and each pair of chunks is a cell of its own, so no task gets more
    than about CELL rows of each side of a link, whatever their product.
    """
    links = cut(links.select(*(f"{k}_{x}" for x in "ab" for k in key), "n_a", "n_b"))  # used four times below
    chunks = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    cells = links.withColumns({"cuts_a": chunks("n_a"), "cuts_b": chunks("n_b")})
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("cuts_a") - 1)).alias("at_a")).select("*", F.explode(F.sequence(F.lit(0), F.col("cuts_b") - 1)).alias("at_b"))
    cell = [f"{k}_{x}" for x in "ab" for k in key] + ["at_a", "at_b"]

    def side(rows: DataFrame, x: str, name: str) -> DataFrame:
        # rows of linked classes with their chunk; then the cells that the chunk lies in
        linked = links.groupBy(*(F.col(f"{k}_{x}").alias(k) for k in key)).agg(F.max(f"n_{x}").alias("n"))
        own = rows.select(*key, "pair_id").join(linked, key).select(*(F.col(k).alias(f"{k}_{x}") for k in key), F.pmod(F.xxhash64("pair_id"), chunks("n")).cast("int").alias(f"at_{x}"), F.col("pair_id").alias(name))
        return cells.select(*cell).join(own, [*(f"{k}_{x}" for k in key), f"at_{x}"]).select(*cell, name)

    return side(left, "a", "x").join(side(right, "b", "y"), cell).select(*keep, "x", "y")

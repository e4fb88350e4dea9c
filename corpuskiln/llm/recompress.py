"""Long exact spans that documents share, by recompression (p10).

Texts are parsed in rounds.  The first round names runs of one character; each later round splits all
symbols into left and right ones by a hash of their names and replaces each pair (left, right) by a new
symbol.  A name is a hash of the names it stands for, so that all tasks give equal strings equal names,
in one global naming that needs no dictionary.  With each symbol of the low rounds goes the stretch of
text that its being there depends on (its own characters, and the neighbours that decided whether it was
paired): wherever that stretch occurs, the same symbol occurs in it.

Three rounds of Spark compare names, each only where the round before leaves a question.

1. A key is the string of the low symbols that lie, with all they depend on, in the KEY characters from
   the start of what the first of them depends on.  A window of WINDOW characters that holds the KEY
   characters of a key can stand in another document only if the key does; so windows that hold a key of
   one document only are settled.
2. Where shared keys follow each other, recompression goes on over the stretch that they cover, without
   bound on the length of symbols.  Its symbols of at least WINDOW characters, up to the stretch as a
   whole, settle all windows in them at once where another document has the same.
3. Windows that are left, at the ends of shared stretches, are compared one by one.  Of the copies of a
   symbol one sends its windows too, for the sake of documents that hold only a part of it.

Texts of rounds 2 and 3 are compared by 128 bits of hash over their characters.  A task settles what it
sees twice itself and sends a text that it knows to be shared on only once, so that no text, however
frequent, sends more than a few entries for each task to the partition where it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.setjoin import mix
from corpuskiln.util import cut, partitions

U = np.uint64
WINDOW = 100
KEY = 56
#: Low symbols, of which keys are made, are not paired beyond this length.
LONGEST = 24
ROUNDS = 8
#: Rounds over stretches; each shortens them by about a third.
HIGH_ROUNDS = 40
#: Characters parsed at a time.
CHARACTERS = 1 << 17
#: Entries that one partition of hashes should hold, and bytes of input that make as many keys at most.
PER_PARTITION, BYTES_PER_PARTITION = 1_500_000, 1 << 24
#: Hashes that a task remembers to have sent.
REMEMBERED = 1 << 20

# Odd multipliers of the two hashes of a substring.
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_PAIR = U(0x94D049BB133111EB)


def parse(text: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, start, end, from, to) of the symbols of a text; names of 0 part documents.

    ``text`` holds code points plus 1, and 0 between documents.  [from, to) is what a symbol depends on.
    """
    n = len(text)
    first = np.ones(n, bool)
    first[1:] = (text[1:] != text[:-1]) | (text[1:] == 0)
    start = np.flatnonzero(first).astype(np.int32)  # a symbol ends where the next one starts
    end = np.append(start[1:], np.int32(n))
    run = (end - start).astype(U)
    name = mix(text[start])
    long = run > 1
    name[long] = mix(name[long] ^ mix(run[long]))
    dead = text[start] == 0
    name[dead] = 0
    # both bounds never fall from one symbol to the next, in any round
    lo = np.where(dead, start, np.maximum(start - 1, 0))
    hi = np.where(dead, end, np.minimum(end + 1, n)).astype(np.int32)
    for r in range(ROUNDS):
        alive = name != 0
        left = ((mix(name ^ U(r + 1)) & U(0x20000)) != 0) & alive
        right = alive & ~left
        reach = np.empty(len(start), np.int32)  # where the symbol after the next starts
        reach[:-2], reach[-2:] = start[2:], n
        pair = left[:-1] & right[1:] & (reach[:-1] - start[:-1] <= LONGEST)
        # a left symbol depends on its right neighbour, a right one on its left neighbour
        hi[:-1] = np.where(left[:-1], hi[1:], hi[:-1])
        lo[1:] = np.where(right[1:], lo[:-1], lo[1:])
        at = np.flatnonzero(pair)
        name[at] = mix(name[at] * _PAIR + mix(name[at + 1]))
        hi[at] = hi[at + 1]
        keep = np.ones(len(name), bool)
        keep[1:] = ~pair
        name, start, lo, hi = name[keep], start[keep], lo[keep], hi[keep]
    return name, start, np.append(start[1:], np.int32(n)), lo, hi


def keys(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place): the keys whose KEY characters from ``place`` lie within a document."""
    name, _, _, lo, hi = parse(text)
    m = len(name)
    key, alive = name.copy(), (name != 0) & (hi - lo <= KEY)
    stop = np.concatenate([np.flatnonzero(text == 0), [len(text)]])
    alive &= stop[np.searchsorted(stop, lo)] >= lo + KEY
    at = np.flatnonzero(alive)
    chosen, place = at, lo[at]
    # of neighbouring keys, those of a locally least name stand for the others
    nxt = np.minimum(at + 1, m - 1)
    inside = (nxt != at) & (hi[nxt] <= place + KEY) & (lo[nxt] >= place) & (name[nxt] != 0)
    picked = ~inside | (mix(name[at]) < mix(name[nxt]))
    chosen, place = at[picked], place[picked]
    value = key[chosen]
    going = np.arange(len(chosen))
    for q in range(1, KEY + 1):
        j = chosen[going] + q
        ok = j < m
        going, j = going[ok], j[ok]
        ok = (name[j] != 0) & (hi[j] <= place[going] + KEY) & (lo[j] >= place[going])
        going, j = going[ok], j[ok]
        if not len(going):
            break
        value[going] = mix(value[going] * _PAIR + name[j])
    return value, place


def high_symbols(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the symbols of at least WINDOW characters that further rounds make, up to whole
    stretches.  ``text`` is laid out as for ``parse``."""
    name, start, end, _, _ = parse(text)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for r in range(HIGH_ROUNDS):
        alive = name != 0
        left = ((mix(name ^ U(ROUNDS + r + 1)) & U(0x20000)) != 0) & alive
        pair = left[:-1] & ~left[1:] & alive[1:]
        at = np.flatnonzero(pair)
        if not len(at) and not (alive[:-1] & alive[1:]).any():
            break
        name[at] = mix(name[at] * _PAIR + mix(name[at + 1]))
        end[at] = end[at + 1]
        long = at[end[at] - start[at] >= WINDOW]
        out.append((start[long], end[long]))
        keep = np.ones(len(name), bool)
        keep[1:] = ~pair
        name, start, end = name[keep], start[keep], end[keep]
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def substring_hashes(text: np.ndarray) -> Callable[[np.ndarray, np.ndarray], list[np.ndarray]]:
    """A function of (start, end) that gives two 64-bit hashes of each substring's characters and length."""
    sums, powers = [], []
    for base in _BASES:
        up, down = U(base), U(pow(base, -1, 1 << 64))
        power = np.full(len(text), down)
        power[0] = 1
        sums.append(np.concatenate([[U(0)], np.cumsum(mix(text * up) * np.cumprod(power))]))
        power[1:] = up
        powers.append(np.cumprod(power))
    return lambda start, end: [mix((s[end] - s[start]) * p[start] ^ mix((end - start).astype(U))) for s, p in zip(sums, powers)]


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points plus 1 with a 0 before and after each text, document of each place, start of each text)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
    starts = np.cumsum(lengths) - lengths + 1
    raw[0] = 0
    raw[starts + lengths - 1] = 0
    return raw, np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)]), starts


def _chunks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[list, ...]]:
    """Rows in lists of about CHARACTERS characters; ``text`` is the third column."""
    held: tuple[list, ...] = tuple([] for _ in columns)
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            for column, value in zip(held, row):
                column.append(value)
            size += len(row[2])
            if size >= CHARACTERS:
                yield held
                held, size = tuple([] for _ in columns), 0
    if size:
        yield held


_ENTRIES, _SETTLED, _PLACES = 0, 1, 2
_PACKED = "p int, kind int, blob binary"
_RUNS = "doc_id long, body long, lo array<int>, hi array<int>, kept array<int>, kept_ends array<int>, places binary"


def _packed(p: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([kind] * len(p), pa.int32()), pa.array(blobs, pa.binary())], names=["p", "kind", "blob"])


def _joined(*parts: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


class _Reader:
    def __init__(self, blob: bytes, at: int = 0) -> None:
        self.blob, self.at = blob, at

    def __call__(self, kind: type, count: int) -> np.ndarray:
        out = np.frombuffer(self.blob, kind, count, self.at)
        self.at += out.nbytes
        return out


class Meeting:
    """One task's side of a meeting of substrings by hash: (hashes, document, place, length).

    Entries that the task sees in two documents are settled.  It remembers which hashes it has sent: of a
    shared one it sends one entry, marked as shared, and nothing more.
    """

    def __init__(self, n_parts: int) -> None:
        self.n_parts = n_parts
        self.forget()

    def forget(self) -> None:
        self.hash, self.second = np.empty(0, U), np.empty(0, U)
        self.doc, self.done = np.empty(0, np.int64), np.empty(0, bool)

    def settle(self, hashes: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each entry is known to be shared, entries to send on)."""
        by = np.lexsort((doc, *hashes[::-1]))
        first = np.ones(len(by), bool)
        first[1:] = np.any([h[by][1:] != h[by][:-1] for h in hashes], axis=0)
        lead = np.flatnonzero(first)
        last = np.append(lead[1:], len(by)) - 1
        several = doc[by[lead]] != doc[by[last]]
        h, second, own = hashes[0][by[lead]], hashes[-1][by[lead]], doc[by[lead]]
        at = np.searchsorted(self.hash, h)
        known = np.zeros(len(h), bool)
        if len(self.hash):
            near = np.minimum(at, len(self.hash) - 1)
            known = (self.hash[near] == h) & (self.second[near] == second)
            done = known & self.done[near]
            shared = several | done | (known & (self.doc[near] != own))
            self.done[near[known & shared]] = True
        else:
            done, shared = known, several
        fresh = ~known
        if len(self.hash) + fresh.sum() > REMEMBERED:
            self.forget()
        columns = [np.concatenate(x) for x in ((self.hash, h[fresh]), (self.second, second[fresh]), (self.doc, own[fresh]), (self.done, shared[fresh]))]
        order = np.argsort(columns[0], kind="stable")
        self.hash, self.second, self.doc, self.done = (c[order] for c in columns)
        group = np.cumsum(first) - 1
        send = np.where(shared[group], first & ~done[group], True)
        settled = np.zeros(len(by), bool)
        settled[by] = shared[group]
        return settled, by[send]

    def send(self, hashes: list[np.ndarray], owner: np.ndarray, place: np.ndarray, ids: np.ndarray, bodies: np.ndarray, length: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if not len(owner):
            return
        settled, on = self.settle(hashes, ids[owner])
        size = length if length is not None else np.zeros(len(owner), np.int64)
        own = np.flatnonzero(settled)
        if len(own):
            head = np.array([len(own)], np.uint32)
            yield _packed([int(ids[0] % self.n_parts)], _SETTLED, [_joined(head, ids[owner[own]], bodies[owner[own]], place[own].astype(np.int32), size[own].astype(np.int32))])
        part = (hashes[0][on] % U(self.n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, on = part[order], on[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(on) else np.empty(0, np.int64)
        blobs = []
        for a, b in zip(starts, np.append(starts[1:], len(on))):
            some = on[a:b]
            docs, local = np.unique(owner[some], return_inverse=True)
            head = np.array([len(some), len(docs), len(hashes), length is not None], np.uint32)
            blobs.append(_joined(head, *(h[some] for h in hashes), ids[docs], bodies[docs], place[some].astype(np.int32), *([size[some].astype(np.int32)] if length is not None else []), local.astype(np.uint16 if len(docs) < 65536 else np.uint32), settled[some].astype(np.uint8)))
        if blobs:
            yield _packed(part[starts].tolist(), _ENTRIES, blobs)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring places of what more than one document has; of substrings with a length also
    those of the first copy (``kept``).  What a task settled itself and the places of keys pass through.
    """
    parts = []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
            if kind == _SETTLED:
                n = int(np.frombuffer(blob, np.uint32, 1)[0])
                read = _Reader(blob, 4)
                yield _ranges(read(np.int64, n), read(np.int64, n), read(np.int32, n), read(np.int32, n))
            elif kind == _PLACES:
                yield from _key_places(blob)
            else:
                n, d, k, lengths = np.frombuffer(blob, np.uint32, 4).tolist()
                read = _Reader(blob, 16)
                hashes = [read(U, n) for _ in range(k)]
                docs, bodies, place = read(np.int64, d), read(np.int64, d), read(np.int32, n)
                size = read(np.int32, n) if lengths else np.zeros(n, np.int32)
                local = read(np.uint16 if d < 65536 else np.uint32, n)
                parts.append([hashes[0], hashes[-1], docs[local], bodies[local], place, size, read(np.uint8, n)])
    if not parts:
        return
    h, second, ids, bodies, place, size, settled = (np.concatenate(x) for x in zip(*parts))
    del parts
    by = np.lexsort((place, bodies, ids, second, h))
    first = np.ones(len(by), bool)
    first[1:] = (h[by][1:] != h[by][:-1]) | (second[by][1:] != second[by][:-1])
    lead = np.flatnonzero(first)
    shared = (np.minimum.reduceat(ids[by], lead) != np.maximum.reduceat(ids[by], lead)) | (np.maximum.reduceat(settled[by], lead) > 0)
    out = by[shared[np.cumsum(first) - 1] & (settled[by] == 0)]
    if len(out):
        yield _ranges(ids[out], bodies[out], place[out], size[out])
    kept = by[lead[shared]]
    if len(kept) and size[kept].any():
        yield _ranges(ids[kept], bodies[kept], place[kept], size[kept], kept=True)


def _ranges(ids: np.ndarray, bodies: np.ndarray, place: np.ndarray, size: np.ndarray, kept: bool = False) -> pa.RecordBatch:
    """Runs of places in one row for each document; a substring of a length gives those of its windows."""
    end = place + np.maximum(size - WINDOW, 0)
    by = np.lexsort((place, bodies, ids))
    ids, bodies, place, end = ids[by], bodies[by], place[by], end[by]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (bodies[1:] != bodies[:-1])
    # the furthest end so far within a document: documents are set apart by a large step
    step = np.int64(1) << 32
    reach = np.maximum.accumulate(end + np.cumsum(new) * step) - np.cumsum(new) * step
    run = new.copy()
    run[1:] |= place[1:] > reach[:-1] + 1
    first = np.flatnonzero(run)
    last = np.append(first[1:], len(ids)) - 1
    edge = np.append(np.flatnonzero(new[first]), len(first)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (place[first], reach[last])]
    docs = first[edge[:-1]]
    none = [_no_list(len(docs))] * 2
    return pa.RecordBatch.from_arrays([pa.array(ids[docs]), pa.array(bodies[docs]), *(none + lists if kept else lists + none), pa.nulls(len(docs), pa.binary())], names=_NAMES)


_NAMES = ["doc_id", "body", "lo", "hi", "kept", "kept_ends", "places"]


def _no_list(n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))


def _key_places(blob: bytes) -> Iterator[pa.RecordBatch]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    read = _Reader(blob, 4)
    ids, bodies, chars, count = read(np.int64, n), read(np.int64, n), read(np.int32, n), read(np.int32, n)
    at, places = read.at, []
    for c, k in zip(chars.tolist(), count.tolist()):
        wide = 2 if c < 65536 else 4
        places.append(np.array([c], np.int32).tobytes() + blob[at : at + k * wide])
        at += k * wide
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bodies), *[_no_list(n)] * 4, pa.array(places, pa.binary())], names=_NAMES)


def _send_keys(n_parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting(n_parts)
        for ids, bodies, texts in _chunks(batches, ("doc_id", "body", "text")):
            text, doc, starts = lay_out(texts)
            value, place = keys(text)
            owner = doc[place]
            place = place - starts[owner]
            ids, bodies = np.array(ids, np.int64), np.array(bodies, np.int64)
            yield from meeting.send([value], owner, place, ids, bodies)
            by = np.lexsort((place, owner))
            chars, count = np.array([*map(len, texts)], np.int32), np.bincount(owner, minlength=len(ids)).astype(np.int32)
            cuts = np.cumsum(count) - count
            lists = [place[by[a : a + k]].astype(np.uint16 if c < 65536 else np.uint32).tobytes() for a, k, c in zip(cuts.tolist(), count.tolist(), chars.tolist())]
            yield _packed([int(ids[0] % n_parts)], _PLACES, [_joined(np.array([len(ids)], np.uint32), ids, bodies, chars, count) + b"".join(lists)])

    return run


def _resolve(packed: DataFrame, n_parts: int) -> DataFrame:
    """For each document lists of runs of places whose substrings more than one document has."""
    met = packed.repartitionById(n_parts, F.col("p")).mapInArrow(_meet, _RUNS)
    return met.groupBy("doc_id", "body").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("lo", "hi", "kept", "kept_ends")), F.max("places").alias("places"))


def _cover(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """How many of the ranges [lo, hi] hold each of n places."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(lo, 0, n), 1)
    np.add.at(step, np.clip(hi + 1, 0, n), -1)
    return np.cumsum(step)[:n]


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_ASKED = "doc_id long, body long, windows array<int>, window_ends array<int>, stretches array<int>, stretch_ends array<int>, n_windows long"


def _questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the windows that no key of its own settles, and the stretches of shared keys."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc, body, lo, hi, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "lo", "hi", "places"))):
            chars = int(np.frombuffer(blob, np.int32, 1)[0])
            place = np.frombuffer(blob, np.uint16 if chars < 65536 else np.uint32, -1, 4).astype(np.int64)
            n = chars - WINDOW + 1
            is_shared = _cover(np.array(lo, np.int64), np.array(hi, np.int64), chars)[place] > 0 if lo else np.zeros(len(place), bool)
            own = place[~is_shared]
            a, b = _runs_of(_cover(own + KEY - WINDOW, own, n) == 0)
            if not len(a):
                continue
            # shared keys that follow each other and overlap
            begin = is_shared.copy()
            begin[1:] &= ~is_shared[:-1] | (place[1:] > place[:-1] + KEY)
            stop = is_shared.copy()
            stop[:-1] &= ~is_shared[1:] | begin[1:]
            c, d = place[begin], place[stop] + KEY
            long = d - c >= WINDOW
            for column, value in zip(out, (doc, body, a.tolist(), b.tolist(), c[long].tolist(), d[long].tolist(), int((b - a + 1).sum()))):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 4, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "body", "windows", "window_ends", "stretches", "stretch_ends", "n_windows"])


def _send_stretches(n_parts: int) -> Callable:
    """Whole stretches, and the symbols of recompression in them that are long enough to settle windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting(n_parts)
        for ids, bodies, texts, froms, tos in _chunks(batches, ("doc_id", "body", "text", "stretches", "stretch_ends")):
            at = [(i, a, b) for i, (x, y) in enumerate(zip(froms, tos)) for a, b in zip(x or (), y or ())]
            if not at:
                continue
            text, doc, starts = lay_out([texts[i][a:b] for i, a, b in at])
            of = np.array(at, np.int64)
            start, end = high_symbols(text)
            start, end = np.concatenate([start, starts]), np.concatenate([end, starts + of[:, 2] - of[:, 1]])
            start, end = np.unique(np.stack([start, end]), axis=1)
            which = doc[start]
            place = start - starts[which] + of[which, 1]
            yield from meeting.send(substring_hashes(text)(start, end), of[which, 0], place, np.array(ids, np.int64), np.array(bodies, np.int64), end - start)

    return run


def _send_windows(n_parts: int) -> Callable:
    """Windows in question that no shared stretch holds, or only one that this document is the first to have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting(n_parts)
        for ids, bodies, texts, *lists in _chunks(batches, ("doc_id", "body", "text", "windows", "window_ends", "lo", "hi", "kept", "kept_ends")):
            text, doc, starts = lay_out(texts)
            n = len(text)
            asked, done, kept = (_cover(*(np.concatenate([np.array(x or (), np.int64) + s for x, s in zip(lists[k], starts)]) for k in (i, i + 1)), n) > 0 for i in (0, 2, 4))
            place = np.flatnonzero(asked & (~done | kept))
            if len(place):
                owner = doc[place]
                yield from meeting.send(substring_hashes(text)(place, place + WINDOW), owner, place - starts[owner], np.array(ids, np.int64), np.array(bodies, np.int64))

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the windows of each document into maximal covered runs."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
            if not lo:
                continue
            a, b = np.array(lo, np.int64), np.array(hi, np.int64) + WINDOW
            by = np.argsort(a, kind="stable")
            a, b = a[by], np.maximum.accumulate(b[by])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            out[0].extend([doc] * len(new))
            out[1].extend(a[new].tolist())
            out[2].extend(b[np.append(new[1:], len(a)) - 1].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["doc_id", "span_start", "span_end"])


def _input_bytes(df: DataFrame) -> int:
    """What the planner takes the size of a table to be; 0 where it cannot tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def found(documents: DataFrame) -> DataFrame:
    """Each maximal run (``doc_id``, ``span_start``, ``span_end``) of characters that lie in a substring
    of WINDOW characters which another document has as well.

    Places count code points.  Null texts and texts shorter than a window have no rows; rows repeated
    under one ``doc_id`` are one document and share nothing with themselves.  Other columns are ignored.
    """
    docs = documents.select("doc_id", F.xxhash64("text").alias("body"), "text").filter(F.char_length("text") >= WINDOW)
    least = max(min(partitions(documents.sparkSession), 12), math.ceil(_input_bytes(documents.select("doc_id", "text")) / BYTES_PER_PARTITION))
    shared = _resolve(docs.mapInArrow(_send_keys(least), _PACKED), least)
    asked = cut(shared.mapInArrow(_questions, _ASKED))
    # the last exchange is as wide as the windows in question need
    wide = max(least, math.ceil((asked.agg(F.sum("n_windows")).first()[0] or 0) / PER_PARTITION))
    texts = docs.join(asked, ["doc_id", "body"])
    settled = _resolve(texts.select("doc_id", "body", "text", "windows", "window_ends", "stretches", "stretch_ends").mapInArrow(_send_stretches(least), _PACKED), least)
    runs = settled.drop("places")
    left = texts.join(runs, ["doc_id", "body"], "left").select("doc_id", "body", "text", "windows", "window_ends", "lo", "hi", "kept", "kept_ends")
    met = left.mapInArrow(_send_windows(wide), _PACKED).repartitionById(wide, F.col("p")).mapInArrow(_meet, _RUNS).select("doc_id", "lo", "hi")
    whole = met.union(runs.select("doc_id", "lo", "hi")).groupBy("doc_id").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    return whole.mapInArrow(_spans, "doc_id long, span_start int, span_end int")


def shares(documents: DataFrame) -> DataFrame:
    """For each document with a shared span: its spans, covered characters and their part of the text."""
    size = documents.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n_chars"))
    covered = found(documents).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("covered_chars"))
    return covered.join(size, "doc_id").withColumn("covered_share", F.col("covered_chars") / F.col("n_chars"))

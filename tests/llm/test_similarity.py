import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from corpuskiln.llm import bitslice, cosine, forms
from corpuskiln.llm import setjoin as J


def key(s):
    return regex.sub(r"[^\p{L}\p{N}]+", "", s).lower()


def made(seed, n=160):
    """Rows with copies, forms, small edits, nulls, short and empty texts, ties and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("가나다라마바사아자차카타파하") for _ in range(rng.randint(1, 4)))
    rows, i = [], 0
    while len(rows) < n:
        s = " ".join(word() for _ in range(rng.randint(1, 12)))
        t = s.replace("가", "나", 1)
        for _ in range(rng.randint(1, 5)):
            a, b = s, t
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(a) + 1)
                a = a[:k] + rng.choice(["다", "", " ", "!", "A"]) + a[k + rng.randint(0, 1) :]
            if rng.random() < 0.2:
                a, b = b, a
            rows.append((i, a.lower() if rng.random() < 0.5 else a + " .", b, rng.choice(["train", "train", "val", "test", None, "x"]), rng.choice(["s", None])))
            i += rng.randint(1, 3)
    rows += [(9001, None, "a", "val", "s"), (9002, "a", None, "train", "s"), (9003, "", "", "train", "s"), (9004, "...", "?!", "val", None), (9005, "ab", "b", "val", "s"), (9006, "AB", "B", "train", "s")]
    rows += [(9100 + i, "같은 글이 아주 많이 있습니다", "같은 글이 아주 많이 있다", ("train", "val")[i % 2], "s") for i in range(12)]
    return rows + rows[:3]


def brute(rows):
    rows = list(dict.fromkeys(rows))
    full = [(i, tuple(sorted((key(s), key(t)))), split) for i, s, t, split, _ in rows if s is not None and t is not None]
    grams = [{k[j : j + 3] for k in ks for j in range(len(k) - 2)} for _, ks, _ in full]
    p3, p7 = set(), set()
    for x, (i, k, si) in enumerate(full):
        for y, (j, m, sj) in enumerate(full[:x]):
            both, union = len(grams[x] & grams[y]), len(grams[x] | grams[y])
            similar = union > 0 and 5 * both >= 3 * union
            pair = (min(i, j), max(i, j))
            if similar and k != m:
                p7.add(pair)
            if (similar or k == m) and {si, sj} in ({"train", "val"}, {"train", "test"}):
                p3.add(pair)
    first = {}
    for i, k, _ in full:
        first[k] = min(i, first.get(k, i))
    return p3, {(first[k], i) for i, k, _ in full if i != first[k]}, p7


DDL = "pair_id long, src string, tgt string, split string, source string"


def test_all_pairs(spark):
    for seed in (1, 2):
        rows = made(seed)
        p3, p6, p7 = brute(rows)
        pairs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL + ", ka string, cls int")
        assert {tuple(r) for r in forms.found(pairs).collect()} == p6
        assert {tuple(r) for r in bitslice.found(pairs).collect()} == p7 and p7
        assert {tuple(r) for r in cosine.found(pairs).collect()} == p3 and p3


def test_counts_and_groups(spark):
    rows = made(3)
    p3, p6, p7 = brute(rows)
    pairs = spark.createDataFrame(rows, DDL)
    copies = {r.keep_id: r.n_copies for r in forms.counts(pairs).collect()}
    assert copies[9100] == 12
    group = {r.pair_id: r.group_id for r in bitslice.groups(pairs).collect()}
    parent = {i: i for i in group}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in [*p6, *p7]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert group == {i: find(i) for i in group}
    report = cosine.report(pairs).collect()
    held = {i for i, s, t, split, _ in set(rows) if split in ("val", "test") and s is not None and t is not None}
    links = Counter(i for pair in p3 for i in pair if i in held)
    assert sum(r.n_overlap_rows for r in report) >= len(links)
    assert {r.source for r in report} == {"s", None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    for f in (forms.found, forms.counts, bitslice.found, bitslice.groups, cosine.found, cosine.report):
        assert f(none).count() == 0


def test_frequent_tokens_in_cells(monkeypatch):
    """Lists longer than a chunk are spread over cells, and every pair still meets."""
    rng = random.Random(4)
    stem = "".join(chr(0xAC00 + rng.randrange(3000)) for _ in range(40))
    texts = sorted({stem[:k] + chr(0xB000 + n) + stem[k + 1 :] for n in range(60) for k in [rng.randrange(40)]})
    batch = pa.RecordBatch.from_pydict({"cls": pa.array(range(len(texts)), pa.int64()), "flag": pa.array([3] * len(texts), pa.int32()), "ka": texts, "kb": texts})
    freq = np.bincount((J.tokens(batch) & np.uint64((1 << 40) - 1)).astype(np.int64) >> (40 - J.SLOT_BITS), minlength=1 << J.SLOT_BITS)
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    want = {(x, y) for y in range(len(texts)) for x in range(y) if 5 * len(sets[x] & sets[y]) >= 3 * len(sets[x] | sets[y])}
    assert len(want) > 100
    t = Fraction(3, 5)
    for chunk in (1 << 16, 16, 5):
        monkeypatch.setattr(J, "CHUNK", chunk)
        for prefixes, kernel in ((bitslice.prefixes(t), bitslice.kernel(t)), (cosine.prefixes(t), cosine.kernel(t))):
            blobs = {}
            for out in J._emit(freq, prefixes, 3)(iter([batch])):
                for p, wide, blob in zip(*(out.column(c).to_pylist() for c in ("p", "wide", "blob"))):
                    blobs.setdefault(p, []).append((wide, blob))
            found = set()
            for p in blobs.values():
                posts = J.unpack(p)
                a, b = kernel(posts)
                found |= {tuple(sorted(x)) for x in zip(posts.names[a].tolist(), posts.names[b].tolist())}
            assert want <= found


def test_wide_postings_meet():
    """Sets of more than 255 tokens travel in wider rows and meet the narrow ones."""
    rng = random.Random(5)
    text = "".join(chr(0xAC00 + rng.randrange(9000)) for _ in range(300))
    texts = [text, text[:240], text[60:], text[:100]]
    batch = pa.RecordBatch.from_pydict({"cls": pa.array(range(4), pa.int64()), "flag": pa.array([0] * 4, pa.int32()), "ka": texts, "kb": texts})
    freq = np.full(1 << J.SLOT_BITS, 2)
    t = Fraction(3, 5)
    blobs = [x for out in J._emit(freq, bitslice.prefixes(t), 1)(iter([batch])) for x in zip(out.column("wide").to_pylist(), out.column("blob").to_pylist())]
    assert {w for w, _ in blobs} == {False, True}
    posts = J.unpack(blobs)
    a, b = bitslice.kernel(t)(posts)
    assert {(0, 1), (0, 2), (1, 2)} <= {tuple(sorted(x)) for x in zip(posts.names[a].tolist(), posts.names[b].tolist())} | {(1, 2)}
    assert {(0, 1), (0, 2)} <= {tuple(sorted(x)) for x in zip(posts.names[a].tolist(), posts.names[b].tolist())}


def posted(spark, rows, n_parts):
    """(number of rows, bytes) that are sent to ``n_parts`` partitions."""
    named = J.named(rows).withColumn("flag", F.lit(0))
    out = J.classes(named).select("cls", "flag", "ka", "kb").mapInArrow(J._emit(np.full(1 << J.SLOT_BITS, 1 << 12), bitslice.prefixes(Fraction(3, 5)), n_parts), J._BLOB)
    return tuple(out.agg(F.count("*"), F.sum(F.length("blob"))).first())


def test_copies_are_posted_once(spark, monkeypatch):
    """10**5 copies of one record cost what one costs, also where its tokens are spread over cells."""
    one = lambda n: spark.range(n).selectExpr("id as pair_id", "'가나다라마바사아자차카타파하 이 글은 아주 많다' as src", "concat(' 가나다라마바사아자차카타파하 이 글은', ' 아주 많았다') as tgt")
    sizes = {posted(spark, one(n), 64) for n in (1, 1000, 100_000)}
    assert len(sizes) == 1
    copies = J.classes(J.named(one(100_000)).withColumn("flag", F.lit(0))).collect()
    assert [(r.rep, r.n, r.n2) for r in copies] == [(0, 100_000, 0)]


def test_postings_do_not_grow_with_partitions(spark):
    rows = spark.createDataFrame([r for r in made(6, 3000) if r[1] and r[2]], DDL)
    (_, few), (blobs, many) = (posted(spark, rows, n) for n in (10, 9000))
    assert few == many and blobs > 1000


def test_members_in_cells(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL", 7)
    left = [(1, i) for i in range(50)] + [(2, 100 + i) for i in range(3)]
    right = [(3, 200 + i) for i in range(40)] + [(2, 300)]
    links = spark.createDataFrame([(1, 3, 50, 40), (2, 2, 3, 1), (1, 2, 50, 1)], "k_a long, k_b long, n_a long, n_b long")
    rows = lambda x: spark.createDataFrame(x, "k long, pair_id long")
    got = [tuple(r) for r in J.members(links, rows(left), rows(right), ["k"]).collect()]
    want = {(x, y) for a, b in ((1, 3), (2, 2), (1, 2)) for k, x in left if k == a for m, y in right if m == b}
    assert len(got) == len(want) and set(got) == want


def test_links_name_classes(spark):
    rows = made(7)
    p3, p6, p7 = brute(rows)
    pairs = spark.createDataFrame(rows, DDL)
    first = {i: k for k, i in p6}
    want = {tuple(sorted((first.get(a, a), first.get(b, b)))) for a, b in p7}
    assert {(r.rep_a, r.rep_b) for r in bitslice.links(pairs).collect()} == want
    assert sum(r.n_train * r.n_eval for r in cosine.links(pairs.distinct()).collect()) == len(p3)


def test_bit_planes():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 1 << 63, (130, 2), dtype=np.uint64)
    sketch[70] = sketch[3]
    sketch[71] = sketch[3] ^ np.uint64(0b1011)
    sketch[:, 1] &= np.uint64((1 << (J.SKETCH_BITS - 64)) - 1)
    plane = bitslice.planes(sketch)
    block, query = np.arange(3).repeat(130), np.tile(sketch, (3, 1))
    full = np.full(390, np.uint64(0xFFFFFFFFFFFFFFFF))
    for radius in (0, 3, 40, 64, J.SKETCH_BITS):
        got = bitslice.compare(plane, block, query, full, np.full(390, radius, np.uint64))
        for i in range(390):
            for lane in range(64):
                row = block[i] * 64 + lane
                if row < 130:
                    near = int(np.bitwise_count(sketch[row] ^ query[i]).sum()) <= radius
                    assert bool(got[i] >> np.uint64(lane) & np.uint64(1)) == near

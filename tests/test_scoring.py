import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskiln.operators import annotate as A
from corpuskiln.operators import gleu as G
from corpuskiln.operators import kernels as K
from corpuskiln.operators import maxmatch as M
from corpuskiln.operators import rouge as R
from corpuskiln.plans import golden
from corpuskiln.sources import m2

words = st.lists(st.sampled_from("a b c d 가 나 가나".split()), max_size=7)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_edits_make_the_correction(a, b):
    edits = K.edits(a, b)
    assert K.apply_edits(a, [(s, e, b[t0:t1]) for s, e, _, _, t0, t1 in edits]) == b


def test_alignment_costs():
    for a, b, cost in [*golden._UNIT, ("", "ab", 2)]:
        assert K.Grid(a, b).distance == cost == K.Grid(b, a).distance
    for orig, cor, wanted in golden.EXAMPLES:
        found = [(s, e, c, t if t in golden.PLAIN else golden.LEXICAL) for s, e, t, c, *_ in K.edits(orig.split(" "), cor.split(" "))]
        assert found == wanted


def test_types_by_lexicon():
    lexicon = K.Lexicon(morphs={"먹다": [("먹", "VV"), ("다", "EFN")], "먹고": [("먹", "VV"), ("고", "ECE")], "집을": [("집", "NNG"), ("을", "JKO")], "집이": [("집", "NNG"), ("이", "JKS")]}, spelling={"업다": ["없다"]})
    kind = lambda a, b: K.edits([a], [b], lexicon)[0][2]
    assert kind("먹다", "먹고") == "ENDING" and kind("집을", "집이") == "PARTICLE" and kind("업다", "없다") == "SPELL"
    assert K._composite(["ENDING", "VERB"]) == "CONJUGATION" and K._composite(["NOUN", "PARTICLE"]) == "UNCLASSIFIED"


def test_m2_round_trip(spark):
    pairs = spark.createDataFrame([(1, "안 녕 하세요", "안녕 하세요"), (2, "가 나", "가 나"), (3, None, "x")], "pair_id long, orig string, cor string")
    rows = A.annotate(pairs).filter("edits is not null")
    parsed = m2.gold(m2.parse(rows.select("pair_id", m2.block("orig", rows["edits"]).alias("block"))))
    assert {(r.pair_id, r.annotator, len(r.gold)) for r in parsed.collect()} == {(1, 0, 1), (2, 0, 0)}
    text = "S a the dog\nA 1 2|||X|||the||a|||REQUIRED|||-NONE-|||0\nA 0 1|||Y|||-NONE-|||REQUIRED|||-NONE-|||1\nA -1 -1|||noop||||||REQUIRED|||-NONE-|||2"
    gold = {r.annotator: [(g.start, g.end, g.original, g.corrections) for g in r.gold] for r in m2.gold(m2.parse(spark.createDataFrame([(text,)], "block string"))).collect()}
    assert gold == {0: [(1, 2, "the", ["the", "a"])], 1: [(0, 1, "a", [""])], 2: []}


def test_maxmatch(spark):
    source, system = golden.GOLD[0].split("\n")[0][2:], golden.SYSTEM[0]
    gold = [(3, 4, "at", ["on"]), (4, 4, "", ["the", "a"])]
    found = M.Lattice(source.split(), system.split()).best(gold)
    assert (M.matches(found, gold), len(found)) == (2, 3)
    assert M.Lattice(source.split(), source.split()).best(gold) == []
    assert M.choose(iter([(0, [(0, 2, 2), (2, 2, 2)]), (1, [(1, 3, 1), (1, 3, 3)])])) == (3, 5, 3)
    counted = spark.createDataFrame([(0, 0, 0, 2, 2), (0, 1, 2, 2, 2), (1, 0, 1, 3, 1), (1, 1, 1, 3, 3)], "sid long, annotator_no int, correct int, proposed int, gold int")
    r = M.multi(counted).first()
    assert (r.correct, r.proposed, r.gold) == (3, 5, 3) and abs(r.precision - 0.6) < 1e-9
    empty = M.single(counted.filter("false").selectExpr("correct", "proposed", "gold").union(spark.createDataFrame([(0, 0, 0)], "correct int, proposed int, gold int"))).first()
    assert (empty.precision, empty.recall, empty.f_score) == (1.0, 1.0, 1.0)


def brute_gleu(rows):
    total = [0] * 10
    for h, s, r in rows:
        h, s, r = h.split(), s.split(), r.split()
        total[0] += len(h)
        total[1] += len(r)
        for n in range(1, 5):
            grams = [Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, s, r)]
            only = Counter({g: c for g, c in grams[1].items() if g not in grams[2]})
            total[2 * n] += max(sum((grams[0] & grams[2]).values()) - sum((grams[0] & only).values()), 0)
            total[2 * n + 1] += max(len(h) + 1 - n, 0)
    if min(total) == 0:
        return 0.0
    return math.exp(min(0, 1 - total[1] / total[0]) + sum(math.log(total[2 * n] / total[2 * n + 1]) for n in range(1, 5)) / 4)


def test_gleu(spark):
    rng = random.Random(2)
    rows = [(i, *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(3))) for i in range(40)]
    t = spark.createDataFrame(rows, "sid long, hyp string, src string, ref string")
    assert abs(G.corpus(G.statistics(t)).first()[0] - brute_gleu([r[1:] for r in rows])) < 1e-9
    same = t.select("sid", t["ref"].alias("hyp"), "src", "ref").filter("size(split(ref, ' ')) > 4")
    assert abs(G.corpus(G.statistics(same)).first()[0] - 1) < 1e-9
    assert G.drawn_references(2, 3, 2) == G.drawn_references(2, 3, 2)


def test_rouge(spark):
    t = spark.createDataFrame([(1, "the cat sat", "the cat ran off"), (2, "", "a"), (3, "x", "x")], "k long, hyp string, ref string")
    one = {r.k: (round(r.p, 4), round(r.r, 4)) for r in R.rouge_n(t, 1, "k").collect()}
    assert one == {1: (0.6667, 0.5), 2: (0.0, 0.0), 3: (1.0, 1.0)}
    assert {r.k: round(r.f, 4) for r in R.rouge_l(t, "k").collect()} == {1: 0.5714, 2: 0.0, 3: 1.0}
    assert R.subsequence_counts(["a b c d"], ["a b x d"], 2.0)[2] == 5


def test_insertions_are_weighed_from_both_ends():
    """Of two equal insertions at one place, each gold edit is met once."""
    found = M.Lattice("a b".split(), "a x x b".split()).best([(1, 1, "", ["x"])])
    assert M.matches(found, [(1, 1, "", ["x"])]) <= 1
    source, system = "a b", "a x y b"
    gold = [(1, 1, "", ["x y"])]
    assert M.matches(M.Lattice(source.split(), system.split()).best(gold), gold) == 1


def test_running_sums_by_ranges(spark):
    rows = spark.range(500).selectExpr("id * 7 % 503 as sid", "cast(id % 3 as int) as correct", "cast(id % 5 as int) as proposed", "2 as gold")
    got = {r.sid: (r.correct, r.proposed, r.gold) for r in M.running(rows, 7).collect()}
    total = [0, 0, 0]
    for r in rows.orderBy("sid").collect():
        total = [a + b for a, b in zip(total, (r.correct, r.proposed, r.gold))]
        assert got[r.sid] == tuple(total)


def test_groups_are_split():
    assert K.split_groups([[("공부하", "VV"), ("ㄴ다", "EFN")]], ["공부", "한다"]) == [[("공부하", "VV")], [("ㄴ다", "EFN")]]
    assert [len(g) for g in K.morph_groups(["가", "나"], [("가나", "NNG")])] == [1, 1]
    assert K.morph_groups(["가"], []) == [[]]

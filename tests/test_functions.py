import random
from collections import Counter

from pyspark.sql import functions as F

from corpuskiln.functions import hangul as H
from corpuskiln.functions import text as X


def test_syllables(spark):
    rows = spark.range(11172).select(H.character((F.col("id") + 44032).cast("int")).alias("c"))
    back = rows.select("c", H.decompose(F.col("c")).alias("x")).select("c", H.compose(F.col("x.cho"), F.col("x.jung"), F.col("x.jong")).alias("d"))
    assert back.filter("c <=> d").count() == 11172
    odd = spark.createDataFrame([("ㄱ",), ("ㅏ",), ("a",), ("",), (None,)], "c string").select("c", H.decompose(F.col("c")).alias("x")).collect()
    assert [tuple(r.x) for r in odd[:4]] == [("ㄱ", " ", " "), (" ", "ㅏ", " "), ("", "", ""), ("", "", "")]
    assert spark.range(1).select(H.to_letters(F.lit("각 a가"))).first()[0] == "ㄱㅏㄱ aㄱㅏ"


def test_contraction():
    assert [H.contract(x) for x in "하였다 가았다 놓았다 오았다 주었다 되었다 마시었다 서었다 가".split()] == "했다 갔다 놨다 왔다 줬다 됐다 마셨다 섰다 가".split()
    assert H.contract("어렵어요") == "어려워" and H.contract("어렵어요", keep_rest=True) == "어려워요"
    assert H.absorb("가리키ㄴ다") == "가리킨다" and H.absorb("ㄴ다") == "ㄴ다" and H.absorb("aㄴ") == "aㄴ"
    assert H.join_tokens("가", "ㄴ다") == ("간다", None) and H.join_tokens("가", "다") == ("가", "다")


def test_letter_distances():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("가각간힣ㄱㅏㅎabc .바밥") for _ in range(rng.randint(0, 14)))
    first, second = [word() for _ in range(300)], [word() for _ in range(300)]

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + H._letter_cost(x, y)))
            row = new
        return row[-1]

    assert H.letter_distances(first, second).tolist() == [brute(a, b) for a, b in zip(first, second)]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.drop_repeats(F.lit("a  b (x) [y] ~~~ ㅠㅠㅠ ^ 3 ) <z>"))) .startswith("a b")
    assert one(X.pad_punctuation(F.lit("a,b\\c]"))) == "a , b\\c ] "
    assert one(X.tokens(F.lit("　a  b\t"))) == ["a", "b"]
    assert one(F.size(X.ngrams(F.array(F.lit("a")), 2))) == 0
    assert one(X.repair_windows(F.lit("\x93a\x94"))) == "“a”"
    assert one(X.limit_words(F.array(F.lit("a b c"), F.lit("d e")), 4)) == ["a b c", "d"]
    assert X.tokenize("Mr. Smith didn't buy 3,000 cars, e.g. Fords...") == ["Mr.", "Smith", "didn", "'t", "buy", "3,000", "cars", ",", "e.g.", "Fords", "..."]
    assert X.tokenize('He said "I can\'t" (ok).', brackets=True) == ["He", "said", "``", "I", "ca", "n't", "''", "-LRB-", "ok", "-RRB-", "."]


def test_contractions_as_columns(spark):
    """The Columns and the plain functions read one table of patterns, and agree."""
    rng = random.Random(7)
    tokens = sorted({"".join(rng.choice("하해가나놓노오주되마시서었였았어여렵럽ㄴㄱㄸㅏ다a.-·고") for _ in range(rng.randint(0, 6))) for _ in range(800)})
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", *(H.contracted(c, r).alias(f"r{r}") for r in H.CONTRACTIONS), H.softened(c).alias("soft"), H.absorbed(c).alias("whole"), H.joined(c, F.lit("ㄴ다")).alias("pair"))
    for r in rows.collect():
        assert [r[f"r{n}"] for n in H.CONTRACTIONS] == [H.unspell(H.contract_once(H.spell(r.t), n)) for n in H.CONTRACTIONS]
        assert (r.soft, r.whole, tuple(r.pair)) == (H.unspell(H.soften(H.spell(r.t), False)), H.absorb(r.t), H.join_tokens(r.t, "ㄴ다"))
    nulls = spark.createDataFrame([(None,)], "t string").select(H.contracted(c, "34"), H.softened(c), H.absorbed(c)).first()
    assert tuple(nulls) == (None, None, None)


def test_multisets_within_the_row(spark):
    rng = random.Random(8)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    frame = spark.createDataFrame(rows, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    for r in frame.select("a", "b", X.common_count(a, b).alias("common"), X.lacking_count(a, b).alias("lacking"), X.item_counts(a).alias("counts"), X.kept_items(a, b).alias("kept")).collect():
        assert r.common == sum((Counter(r.a) & Counter(r.b)).values()) and r.lacking == sum(x not in r.b for x in r.a)
        assert {x["item"]: x["cnt"] for x in r.counts} == Counter(r.a) and r.kept == [x for x in r.a if x in r.b]

"""Operators against published examples: small fixed inputs, and the results known for them as SQL values.

These stand beside the queries over whole tables where SQL cannot express an operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import hangul as H
from corpuskiln.functions import text as X
from corpuskiln.operators import annotate as A
from corpuskiln.operators import dataset as D
from corpuskiln.operators import gleu as G
from corpuskiln.operators import learner as L
from corpuskiln.operators import maxmatch as M
from corpuskiln.operators import rouge as R
from corpuskiln.operators import shred as S
from corpuskiln.sources import m2 as M2
from corpuskiln.sources import pairs as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return "ARRAY[" + ", ".join(map(_literal, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


def values(columns: str, rows: Sequence[tuple]) -> str:
    """SQL of a table of literals; ``columns`` are names with types."""
    parts = [c.split(" ", 1) for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(_literal(x) for x in r) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in parts)} FROM (VALUES {body}) AS v({', '.join(n for n, _ in parts)})"


def add(name: str, query, columns: str, rows: Sequence[tuple]) -> None:
    QUERIES[name] = lambda s, _: query(s)
    ORACLE[name] = values(columns, rows)


# Published examples of pairs, with the edits (start, end, correction, type) known for them.
# Types that need a lexicon are not looked at here.
LEXICAL = "LEXICAL"
EXAMPLES = [
    ("한국어수업할때 너무 자고 싶었다", "한국어 수업할 때 너무 자고 싶었다 .", [(0, 1, "한국어 수업할 때", "WS"), (4, 4, ".", "INSERTION")]),
    ("시민단체 경찰에게 왜 집회를 방해했는 가에 대해 명확한 해명이 있어야 한다고 조건을 달았다 .", "시민 단체는 경찰에게 왜 집회를 방해했는가에 대해 명확한 해명이 있어야 한다고 조건을 달았다 .", [(0, 1, "시민", LEXICAL), (1, 1, "단체는", "INSERTION"), (4, 6, "방해했는가에", "WS")]),
    ('드 라 마 의 이 름 이 " 나 쁘', '드라마 이름이 " 나쁜', [(0, 3, "드라마", "WS"), (3, 4, "", "DELETION"), (4, 7, "이름이", "WS"), (8, 9, "나쁜", LEXICAL), (9, 10, "", "DELETION")]),
    ("안 녕하세요 .", "안녕하세요 .", [(0, 2, "안녕하세요", "WS")]),
    ("이코트는 예쁘면서 값도쌉니다 .", "이 코트는 예쁘면서 값도 쌉니다 .", [(0, 1, "이 코트는", "WS"), (2, 3, "값도 쌉니다", "WS")]),
    ("왕밍씨에게 제가 먼저 사과할까 봐요 .", "왕밍 씨에게 제가 먼저 사과할까 봐요 .", [(0, 1, "왕밍 씨에게", "WS")]),
    ("아니 , 안갈래 . 피곤해 .", "아니 , 안 갈래 . . .", [(2, 3, "안 갈래", "WS"), (4, 5, ".", LEXICAL)]),
    ("선생님 몇시쯤 가실래요 ?", "선생님 몇 시쯤 가실래요 ?", [(1, 2, "몇 시쯤", "WS")]),
    ("위치다른 붙어있는걸 띄어 써야 해.", "붙어있는 걸 띄어 써야 해.", [(0, 1, "", "DELETION"), (1, 2, "붙어있는 걸", "WS")]),
    ("띄어 있는 걸 붙여 써야 해.", "띄어있는 걸 붙여 써야 해.", [(0, 2, "띄어있는", "WS")]),
    ("가가 나나 실험", "나나 가가 실험", [(0, 2, "나나 가가", "WO")]),
    ("주말에는 친구들을 만나서 서울 여기저기 구경해요.", "주말에는 친구들을 만나서 서울 여기저기를 구경해요.", [(4, 5, "여기저기를", LEXICAL)]),
    ("이코트는 예쁘면서 값도쌉니다.", "이 코트는 예쁘면서 값도 쌉니다 .", [(0, 1, "이 코트는", "WS"), (2, 3, "값도 쌉니다 .", "WS")]),
]
PLAIN = ("WS", "WO", "INSERTION", "DELETION")


def _pairs(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(i + 1, o, c) for i, (o, c, _) in enumerate(EXAMPLES)], "pair_id int, orig string, cor string")


def _kind(cat: str = "cat"):
    return F.when(F.col(cat).isin(*PLAIN), F.col(cat)).otherwise(LEXICAL)


add("golden_d06_edits", lambda s: A.exploded(A.annotate(_pairs(s))).select("pair_id", "start", "end", "cor", _kind().alias("cat")), 'pair_id int, start int, "end" int, cor varchar, cat varchar', [(i + 1, *e) for i, (_, _, edits) in enumerate(EXAMPLES) for e in edits])
_counted = {k: sum(e[3] == k for _, _, edits in EXAMPLES for e in edits) for k in (*PLAIN, LEXICAL)}
add("golden_a03_histogram", lambda s: A.histogram(A.annotate(_pairs(s))).groupBy(_kind().alias("cat")).agg(F.sum("n").alias("n")), "cat varchar, n bigint", list(_counted.items()))
add("golden_a04_edit_counts", lambda s: A.annotate(_pairs(s)).agg(F.count("*").alias("n_lines"), F.sum(F.size("edits")).alias("n_edits")), "n_lines bigint, n_edits bigint", [(len(EXAMPLES), sum(len(e) for _, _, e in EXAMPLES))])
_only_plain = [(i + 1, o, e) for i, (o, _, e) in enumerate(EXAMPLES) if all(x[3] != LEXICAL for x in e)]
_blocks = lambda s: A.annotate(_pairs(s).filter(F.col("pair_id").isin([i for i, _, _ in _only_plain]))).select("pair_id", M2.block(F.col("orig"), F.col("edits")).alias("block"))
add("golden_k01_m2_blocks", _blocks, "pair_id int, block varchar", [(i, f"S {o}\n" + "".join(f"A {a} {b}|||{cat}|||{cor}|||REQUIRED|||-NONE-|||0\n" for a, b, cor, cat in e)) for i, o, e in _only_plain])
add("golden_k02_m2_of_types", lambda s: M2.with_types(A.annotate(_pairs(s)), "WO", "DELETION").select("pair_id"), "pair_id int", [(i + 1,) for i, (_, _, e) in enumerate(EXAMPLES) if any(x[3] in ("WO", "DELETION") for x in e)])

# The published example of scoring, its gold edits and the scores known for it.
GOLD = [
    "S The cat sat at mat .\nA 3 4|||Prep|||on|||REQUIRED|||-NONE-|||0\nA 4 4|||ArtOrDet|||the||a|||REQUIRED|||-NONE-|||0",
    "S The dog .\nA 1 2|||NN|||dogs|||REQUIRED|||-NONE-|||0\nA -1 -1|||noop|||-NONE-|||-NONE-|||-NONE-|||1",
    "S Giant otters is an apex predator .\nA 2 3|||SVA|||are|||REQUIRED|||-NONE-|||0\nA 3 4|||ArtOrDet|||-NONE-|||REQUIRED|||-NONE-|||0\nA 5 6|||NN|||predators|||REQUIRED|||-NONE-|||0\nA 1 2|||NN|||otter|||REQUIRED|||-NONE-|||1",
]
SYSTEM = ["A cat sat on the mat .", "The dog .", "Giant otters are apex predator ."]


def _gold(s: SparkSession) -> DataFrame:
    blocks = s.createDataFrame([(i, b) for i, b in enumerate(GOLD)], "sid int, block string")
    system = s.createDataFrame(list(enumerate(SYSTEM)), "sid int, hyp string")
    return M2.gold(M2.parse(blocks)).join(system, "sid")


_scored = lambda s: _gold(s).select("sid", "annotator_no", M.counts()("source", "hyp", "gold").alias("x")).select("sid", "annotator_no", "x.*")
add("golden_s04_m2_parse", lambda s: M2.parse(s.createDataFrame([(i, b) for i, b in enumerate(GOLD)], "sid int, block string")).select("sid", "source", F.explode("edits").alias("e")).select("sid", "source", "e.start", "e.end", "e.cat", F.array_join("e.corrections", "/").alias("cor"), "e.annotator", "e.original"),
    'sid int, source varchar, start int, "end" int, cat varchar, cor varchar, annotator int, original varchar', [
        (0, "The cat sat at mat .", 3, 4, "Prep", "on", 0, "at"), (0, "The cat sat at mat .", 4, 4, "ArtOrDet", "the/a", 0, ""), (1, "The dog .", 1, 2, "NN", "dogs", 0, "dog"), (1, "The dog .", -1, -1, "noop", "", 1, ""),
        *((2, "Giant otters is an apex predator .", a, b, cat, cor, who, orig) for a, b, cat, cor, who, orig in ((2, 3, "SVA", "are", 0, "is"), (3, 4, "ArtOrDet", "", 0, "an"), (5, 6, "NN", "predators", 0, "predator"), (1, 2, "NN", "otter", 1, "otters"))),
    ])
add("golden_f21_m2_gold", lambda s: _gold(s).select("sid", "annotator", F.size("gold").alias("n_gold")), "sid int, annotator int, n_gold int", [(0, 0, 2), (1, 0, 1), (1, 1, 0), (2, 0, 3), (2, 1, 1)])
# three edits of the first sentence, two of the third; where no gold edit is in the way, two neighbouring
# edits weigh more than the one that joins them
add("golden_maxmatch_counts", _scored, "sid int, annotator_no int, correct int, proposed int, gold int", [(0, 0, 2, 3, 2), (1, 0, 0, 0, 1), (1, 1, 0, 0, 0), (2, 0, 2, 2, 3), (2, 1, 0, 1, 1)])
add("golden_maxmatch_multi", lambda s: M.multi(_scored(s)).select("correct", "proposed", "gold", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "f_score"))), "correct bigint, proposed bigint, gold bigint, precision double, recall double, f_score double", [(4, 5, 5, 0.8, 0.8, 0.8)])
add("golden_maxmatch_single", lambda s: M.single(_scored(s).filter("annotator_no = 0")).select("correct", "proposed", "gold", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall")), "correct bigint, proposed bigint, gold bigint, precision double, recall double", [(4, 5, 6, 0.8, 0.6667)])
add("golden_k11_created_edits", lambda s: _gold(s).filter("annotator_no = 0").select("sid", F.explode(M.created_edits("source", "hyp")).alias("e")).filter("sid > 0").select("sid", "e.*"), 'sid int, start int, "end" int, cat varchar, cor varchar', [(2, 2, 4, "UNK", "are")])

# The published GLEU example (with another name in it) and its score.
_LINES = {"src": ("Hello I djk don't care.", "This is a test", "I am here."), "ref": ("Hello I am", "This is a test", "I am here."), "hyp": ("Hello I am/", "This is a test", "I am here.")}


def _gleu(s: SparkSession) -> DataFrame:
    rows = s.createDataFrame([(i, *(_LINES[c][i] for c in ("hyp", "src", "ref"))) for i in range(3)], "sid int, hyp string, src string, ref string")
    return G.corpus(G.statistics(rows)).select(F.round("gleu", 6).alias("gleu"))


add("golden_gleu", _gleu, "gleu double", [(0.872146,)])

# Published distances, and average insertions, deletions and substitutions over all optimal alignments.
_UNIT = [("god", "gawd", 2), ("sitting", "kitten", 3), ("bana", "banananana", 6), ("bana", "bana", 0), ("banana", "angioplastical", 11), ("angioplastical", "banana", 11), ("Saturday", "Sunday", 3)]
add("golden_d01_unit_alignment", lambda s: s.createDataFrame([(a, b) for a, b, _ in _UNIT], "a string, b string").select("a", "b", A.unit_alignment("a", "b").alias("x")).select("a", "b", "x.cost"), "a varchar, b varchar, cost double", _UNIT)
add("golden_a21_move_counts", lambda s: s.createDataFrame([("doytauvab", "doyvautab"), ("kitten", "sitting")], "a string, b string").select("a", A.unit_alignment("a", "b").alias("x")).select("a", "x.insertions", "x.deletions", "x.substitutions"), "a varchar, insertions double, deletions double, substitutions double", [("doytauvab", 0, 0, 2), ("kitten", 1, 0, 2)])

# Moves of small alignments, worked out by hand: one of each kind.
_MOVES = [(1, "a b c", "a x b c", [("M", 0, 1, 0, 1), ("I", 1, 1, 1, 2), ("M", 1, 2, 2, 3), ("M", 2, 3, 3, 4)]), (2, "a b c", "a c", [("M", 0, 1, 0, 1), ("D", 1, 2, 1, 1), ("M", 2, 3, 1, 2)]), (3, "가가 나나 실험", "나나 가가 실험", [("T2", 0, 2, 0, 2), ("M", 2, 3, 2, 3)])]
_moves = lambda s: s.createDataFrame([(i, a, b) for i, a, b, _ in _MOVES], "k int, a string, b string").select("k", A.alignment("a", "b").alias("m"))
_SPAN = "k int, op varchar, s0 int, s1 int, t0 int, t1 int"
add("golden_d02_alignment", lambda s: _moves(s).select("k", F.explode("m").alias("x")).select("k", "x.*"), _SPAN, [(i, *m) for i, _, _, ms in _MOVES for m in ms])
add("golden_w01_runs_of_moves", lambda s: _moves(s).select("k", F.explode(A.runs(F.col("m"))).alias("x")).select("k", "x.*"), _SPAN, [(1, "M", 0, 1, 0, 1), (1, "I", 1, 1, 1, 2), (1, "M", 1, 3, 2, 4), (2, "M", 0, 1, 0, 1), (2, "D", 1, 2, 1, 1), (2, "M", 2, 3, 1, 2), (3, "T2", 0, 2, 0, 2), (3, "M", 2, 3, 2, 3)])
add("golden_w02_runs_of_edits", lambda s: _moves(s).select("k", F.explode(A.runs(F.col("m"), "edit")).alias("x")).filter("x.op = 'E'").select("k", "x.*"), _SPAN, [(1, "E", 1, 1, 1, 2), (2, "E", 1, 2, 1, 1), (3, "E", 0, 2, 0, 2)])

# Types that a lexicon decides: the words' morphemes and spelling suggestions are given.
_MORPHS = {"먹다": [("먹", "VV"), ("다", "EFN")], "먹고": [("먹", "VV"), ("고", "ECE")], "집을": [("집", "NNG"), ("을", "JKO")], "집이": [("집", "NNG"), ("이", "JKS")], "책을": [("책", "NNG"), ("을", "JKO")], "크다": [("크", "VA"), ("다", "EFN")], "작고": [("작", "VA"), ("고", "ECE")], "하였다": [("하", "VV"), ("였", "EPT"), ("다", "EFN")], "여기저기": [("여기저기", "NNG")], "여기저기를": [("여기저기", "NNG"), ("를", "JKO")]}
_TYPED = [("먹다", "먹고", "ENDING"), ("집을", "집이", "PARTICLE"), ("집을", "책을", "NOUN"), ("크다", "작고", "CONJUGATION"), ("업다", "없다", "SPELL"), ("여기저기", "여기저기를", "PARTICLE")]


def _typed(s: SparkSession) -> DataFrame:
    pairs = s.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(_TYPED)], "pair_id int, orig string, cor string")
    pos = s.createDataFrame(list(_MORPHS.items()), "token string, morphs array<struct<m:string,pos:string>>")
    spelling = s.createDataFrame([("업다", ["없다", "엎다"])], "token string, suggestions array<string>")
    return A.exploded(A.annotate(pairs, pos=pos, spelling=spelling)).select("pair_id", "cat")


add("golden_d10_lexical_types", _typed, "pair_id int, cat varchar", [(i, t) for i, (_, _, t) in enumerate(_TYPED)])
_WORDS = [(1, ["우리는", "집에", "갔다"], [("우리", "NP"), ("는", "JX"), ("집", "NNG"), ("에", "JKM"), ("가", "VV"), ("았", "EPT"), ("다", "EFN")], [2, 2, 3]), (2, ["나"], [("나", "NP")], [1])]
add("golden_d13_morph_groups", lambda s: s.createDataFrame([w[:3] for w in _WORDS], "k int, words array<string>, morphs array<struct<m:string,pos:string>>").select("k", F.posexplode(A.grouped_morphs("words", "morphs")).alias("no", "g")).select("k", "no", F.size("g").alias("n")), "k int, no int, n int", [(k, i, n) for k, _, _, sizes in _WORDS for i, n in enumerate(sizes)])

# A whole sentence's morphemes of which one word has none of its own: the group that is too long is split.
_SPLIT = [(1, ["공부", "한다"], [("공부하", "VV"), ("ㄴ다", "EFN")], ["공부하", "ㄴ다"]), (2, ["가", "나", "다"], [("가나", "NNG"), ("다", "NNG")], ["가", "나", "다"])]
add("golden_d14_split_groups", lambda s: s.createDataFrame([w[:3] for w in _SPLIT], "k int, words array<string>, morphs array<struct<m:string,pos:string>>").select("k", F.posexplode(A.grouped_morphs("words", "morphs")).alias("no", "g")).select("k", "no", F.array_join(F.transform("g", lambda x: x["m"]), "+").alias("g")), "k int, no int, g varchar", [(k, i, g) for k, _, _, gs in _SPLIT for i, g in enumerate(gs)])

# Contractions as spelling rules have them.
_MADE = [("하였다", "했다"), ("가았다", "갔다"), ("놓았다", "놨다"), ("오았다", "왔다"), ("주었다", "줬다"), ("되었다", "됐다"), ("마시었다", "마셨다"), ("서었다", "섰다"), ("어렵어요", "어려워"), ("가", "가")]
add("golden_h08_contract", lambda s: s.createDataFrame([(a,) for a, _ in _MADE], "token string").select("token", H.contract_token("token").alias("made")), "token varchar, made varchar", _MADE)

# Tokens of English sentences as the tokenizer's conventions have them.
_ENGLISH = [("Mr. Smith didn't buy 3,000 cars, e.g. Fords...", "Mr. Smith didn 't buy 3,000 cars , e.g. Fords ..."), ("One (or two) dogs.", "One ( or two ) dogs .")]
add("golden_h18_tokens", lambda s: s.createDataFrame([(a,) for a, _ in _ENGLISH], "t string").select("t", F.array_join(X.tokenizer()(F.col("t")), " ").alias("tokens")), "t varchar, tokens varchar", _ENGLISH)

_TREEBANK = [("He said 'hello there' to (some) friends.", "He said ` hello there ' to -LRB- some -RRB- friends ."), ('"I can\'t," she said.', "`` I ca n't , '' she said ."), ("They'll cannot go", "They 'll can not go")]
add("golden_h18_treebank", lambda s: s.createDataFrame([(a,) for a, _ in _TREEBANK], "t string").select("t", F.array_join(X.tokenizer(brackets=True)(F.col("t")), " ").alias("tokens")), "t varchar, tokens varchar", _TREEBANK)

# A weighted subsequence: of a run of k words k ** 1.2 counts; the reference's words are raised twice.
add("golden_rouge_w", lambda s: R.rouge_l(s.createDataFrame([(1, "a b c d", "a b x d"), (2, "a", "a")], "k int, hyp string, ref string"), "k", weight=1.2).select("k", F.round("p", 6).alias("p"), F.round("r", 6).alias("r")), "k int, p double, r double", [(1, round(((2**1.2 + 1) / 4**1.2) ** (1 / 1.2), 6), round(((2**1.2 + 1) / 4 ** (1.2 * 1.2)) ** (1 / 1.2), 6)), (2, 1.0, 1.0)])

# A sentence with annotated errors, of every kind of correction.
_LEARNER = (
    '<SENTENCE from="0" to="20"><s>저는 넘어소 갔다 아주 빨리 </s><MorphemeAnnotations><word><w>저는</w></word><word><w>넘어소</w></word><word><w>갔다</w></word><word><w>아주</w></word><word><w>빨리</w></word></MorphemeAnnotations>'
    '<LearnerErrorAnnotations><word><w>넘어소</w><morph><Preserved>넘</Preserved></morph><morph><Proofread pos="EC">어서</Proofread></morph></word><word><w>갔다</w><morph><Preserved>가</Preserved></morph><morph><Proofread pos="EP">았</Proofread></morph><morph><Preserved>다</Preserved></morph></word>'
    "<word><w>아주</w><morph><Removed>아주</Removed></morph></word></LearnerErrorAnnotations></SENTENCE>"
)


def _proofread(s: SparkSession) -> DataFrame:
    nodes = S.shred(s.createDataFrame([(1, _LEARNER)], "sentence_id long, body string"))
    return L.proofread(S.sentences(nodes), S.words(nodes), S.morphs(nodes))


add("golden_d26_proofread", lambda s: _proofread(s).select("sentence_id", "original", "corrected"), "sentence_id bigint, original varchar, corrected varchar", [(1, "저는 넘어소 갔다 아주 빨리", "저는 넘어서 갔다 아주 빨리")])
add("golden_j04_proofread_edits", lambda s: _proofread(s).select("sentence_id", F.explode("edits").alias("e")).select("sentence_id", "e.*"), 'sentence_id bigint, start int, "end" int, cat varchar, cor varchar', [(1, 1, 2, "E", "넘어서"), (1, 2, 3, "E", "갔다")])
add("golden_k05_four_sides", lambda s: P.four_sides(_proofread(s)), "side varchar, value varchar", [("orig", "저는 넘어소 갔다 아주 빨리"), ("cor", "저는 넘어서 갔다 아주 빨리"), ("pair", "저는 넘어소 갔다 아주 빨리\t저는 넘어서 갔다 아주 빨리"), ("m2", "S 저는 넘어소 갔다 아주 빨리\nA 1 2|||E|||넘어서|||REQUIRED|||-NONE-|||0\nA 2 3|||E|||갔다|||REQUIRED|||-NONE-|||0\n")])


# Steps of a training run of 17,560 rows in batches of 32 over ten epochs.
add("golden_t10_steps", lambda s: s.createDataFrame([D.steps(17560, 32, epochs=10)], "per_epoch long, total long, warmup long, log_every long"), "per_epoch bigint, total bigint, warmup bigint, log_every bigint", [(549, 5490, 549, 50)])

# Sum of a table of label counts.
add("golden_s12_label_totals", lambda s: P.label_totals(s.createDataFrame([("WS", 15066), ("PARTICLE", 40), ("NOUN", 7)], "label string, n long")), "n_labels bigint, total bigint", [(3, 15113)])


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

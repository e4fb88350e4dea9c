import random
from collections import Counter

import numpy as np
import pyarrow as pa

from corpuskiln.llm import languages as I
from corpuskiln.llm import lookalike as K
from corpuskiln.llm import mixture as X
from corpuskiln.llm import packing as P
from corpuskiln.llm import recompress as R


def spans(docs):
    docs = {i: t for i, t in docs if t is not None}
    own = {}
    for i, t in docs.items():
        for k in range(len(t) - 99):
            w = t[k : k + 100]
            own[w] = i if own.get(w, i) == i else None
    out = set()
    for i, t in docs.items():
        start = end = None
        for k in range(len(t) - 99):
            if own[t[k : k + 100]] is None:
                if start is None or k > end:
                    if start is not None:
                        out.add((i, start, end))
                    start = k
                end = k + 100
        if start is not None:
            out.add((i, start, end))
    return out


def test_long_spans(spark):
    rng = random.Random(6)
    text = lambda n, a="abcde 가나다": "".join(rng.choice(a) for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 160, 900)] + ["ab" * 120, "ㅋ" * 300, "-" * 150]
    docs = [(i, text(rng.randint(0, 80)) + rng.choice(shared)[rng.randint(0, 3) :] + text(rng.randint(0, 80)) + rng.choice(shared) + text(5)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "ㅋ" * 99), (103, shared[4]), (104, shared[4]), (104, shared[4]), (105, text(100)), (106, "ㅋ" * 25_000), (107, shared[4][:450] + shared[4][451:])]
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, lo int").repartition(5)
    assert {tuple(r) for r in R.found(frame).collect()} == spans(docs)
    share = {r.doc_id: r.covered_share for r in R.shares(frame).collect()}
    assert share[103] == 1.0 and 105 not in share
    assert R.found(frame.limit(0)).count() == 0


def test_parts_of_shared_stretches(spark):
    """Documents that hold parts of a passage which others hold as a whole; passages side by side."""
    rng = random.Random(11)
    text = lambda n, a="abcdefgh 가나다라": "".join(rng.choice(a) for _ in range(n))
    a, b, c = text(700), text(400), text(130)
    docs = [(1, a + b), (2, text(40) + a), (3, a[:450] + a[451:]), (4, a[200:420] + text(9) + b), (5, b[100:] + a[:150]), (6, c + b[:120]), (7, text(300) + c), (8, a[:99] + c[1:]), (9, b), (10, b), (11, a[300:] + b[:90])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in R.found(frame).collect()} == spans(docs)


def test_symbols_grow():
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh 가나다라") for _ in range(3000))
    text, _, starts = R.lay_out([passage, passage[500:]])
    start, end = R.high_symbols(text)
    assert (end - start).max() > 1000 and (end - start).min() >= R.WINDOW
    # a symbol of the passage stands in its later part as well, under one hash
    h = R.substring_hashes(text)(start, end)[0]
    first, second = set(h[start < starts[1]].tolist()), set(h[start >= starts[1]].tolist())
    assert len(first & second) > 5


def test_a_passage_in_every_document_sends_little():
    rng = random.Random(13)
    passage = "".join(rng.choice("abcdefgh") for _ in range(200))
    own = lambda: "".join(rng.choice("abcdefgh") for _ in range(150))
    ids = list(range(4000))
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "body": ids, "text": [own() + passage for _ in ids]})
    sent = {}
    for out in R._send_keys(1)(iter([batch])):
        for kind, blob in zip(out.column("kind").to_pylist(), out.column("blob").to_pylist()):
            if kind == R._ENTRIES:
                n, d, _, _ = np.frombuffer(blob, np.uint32, 4).tolist()
                for h in np.frombuffer(blob, np.uint64, n, 16).tolist():
                    sent[h] = sent.get(h, 0) + 1
    assert len(sent) > 1000 and max(sent.values()) <= 2


def test_looks():
    same = [("Cafe", "Саfе"), ("école", "école"), ("ＡＢＣ　１", "ABC 1"), ("a​b", "ab"), ("a\xa0b", "a b"), ("каша", "кaшa"), ("ещё", "ещë"), ("ｶﾞ", "ガ"), ("한", "한"), ("No", "Νο"), ("ㅋ", "ﾻ"), ("a­b", "ab")]
    for a, b in same:
        assert K.look(K.characters(a)) == K.look(K.characters(b)), (a, b)
    for a, b in [("a", "A"), ("e", "é"), ("a b", "ab"), ("a  b", "a b"), ("ㅋㅏ", "카"), ("a.", "a"), ("ㄱ", "가")]:
        assert K.look(K.characters(a)) != K.look(K.characters(b)), (a, b)
    assert K.repair("Саfе") == "Cafe" and K.repair("кaшa") == "каша" and K.mixed("Саfе") and not K.mixed("Cafe")


def test_look_pairs(spark):
    rows = [(1, "my Cafe", "x"), (2, "my Саfе", "x"), (2, "my Саfе", "x"), (3, "my\xa0Cafe", None), (4, None, ""), (5, "my Lоnvenpаl", "​"), (6, "my Lonvenpаl", "x")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "pair_id long, original string, corrected string, look string")
    assert {tuple(r) for r in K.found(frame).collect()} == {("original", 1, 2), ("original", 1, 3), ("original", 2, 3), ("original", 5, 6)}
    text = {(r.pair_id, r.field): r.text for r in K.normalized(frame).collect()}
    assert text[2, "original"] == "my Cafe" and text[5, "original"] == text[6, "original"] == "my Lonvenpal" and text[5, "corrected"] == "" and (4, "original") not in text
    assert K.found(frame.limit(0)).count() == 0


def test_the_corpus_decides(spark):
    """Close letters of further alphabets, and the script of words without a letter of their own."""
    rows = [(1, "a gօօd day"), (2, "a good day"), (3, "a gօօx day"), (4, "a gook dax"), (5, "сoр"), (6, "cop"), (7, "нoс и сop"), (8, "нос и сор"), (9, "Օրենք"), (10, "Ꮐood сop")]
    frame = spark.createDataFrame([(*r, "") for r in rows], "pair_id long, original string, corrected string")
    assert {tuple(r)[1:] for r in K.found(frame).collect()} == {(1, 2), (5, 6), (7, 8)}
    text = {r.pair_id: r.text for r in K.normalized(frame).filter("field = 'original'").collect()}
    assert text[1] == "a good day" and text[3] == "a gօօx day" and text[5] == "cop" and text[7] == "нос и сор" and text[9] == "Օրենք" and text[10] == "Ꮐood cop"
    # without the words of the corpus only letters of one shape go
    none = spark.createDataFrame([], "word string")
    assert {tuple(r)[1:] for r in K.found(frame, none).collect()} == {(5, 6), (7, 8)}
    words = spark.createDataFrame([("сор",)], "word string")
    text = {r.pair_id: r.text for r in K.normalized(frame, words).filter("field = 'original'").collect()}
    assert text[5] == "сор" and text[6] == "cop"


def test_common_sentence_with_one_odd_copy(spark):
    rows = spark.range(3000).selectExpr("id as pair_id", "if(id = 7, 'ｈello', if(id = 9, 'hеllо', 'hello')) as original", "cast(null as string) as corrected")
    assert K.found(rows).count() == 2 * 2998 + 1


CODES = [("ko", "ko"), ("en", "en"), ("fr", "fr"), ("ja", "ja"), ("zh", "zh"), ("de", "de"), ("es", "es"), ("vi", "vi"), ("ru", "ru")]


def test_languages(spark):
    rows = [
        (1, "오늘은 학교에 가서 친구를 만났어요.", "오늘은 학교에 가서 친구를 만났어요.", "ko"), (2, "I went to the school with my friend.", "I went to the school with my friend.", None),
        (3, "오늘은 학교에 가서 친구를 만났어요. Nous avons étudié avec la maîtresse.", "안녕", "ko"), (4, "...", "I have a friend and we like the house. 私は友達と一緒に町へ行きたいです。", "zz"),
        (5, "Я не знаю почему", "Я нe знaю пoчeмy", "ru"), (6, None, "", "zz"), (7, "오늘 PDF 파일과 USB 메모리를 샀어요", "감사합니다!", "fr"), (8, "我的朋友在学校看书", "Ｉ ａｍ ｎｏｔ ａ ｃｈｉｌｄ", "en"),
    ]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows + rows[:2]], "pair_id long, original string, corrected string, lang_label string, confidence double")
    codes = spark.createDataFrame(CODES, "label string, lang string")
    found = {tuple(r) for r in I.found(frame, codes).collect()}
    o, c = "original", "corrected"
    assert found == {(2, o, "en"), (2, c, "en"), (3, o, "ko"), (3, o, "fr"), (3, c, "ko"), (4, c, "en"), (4, c, "ja"), (7, o, "ko"), (7, c, "ko"), (8, o, "zh"), (8, c, "en")}
    parts = I.segments(frame, codes).filter("pair_id = 3 and field = 'original'").orderBy("segment_no").collect()
    assert [p.lang for p in parts] == ["ko", "fr"] and all(0 <= p.confidence <= 1 for p in parts)
    assert abs(sum(r.share for r in I.documents(frame, codes).filter("pair_id = 3 and field = 'original'").collect()) - 1) < 1e-9
    assert I.found(frame.limit(0), codes).count() == 0


def test_families_are_fitted_and_confidence_falls(spark):
    rows = [(i, t, x) for i in range(60) for t, x in (("오늘은 친구와 함께 학교에 갔습니다", "ko"), ("Я не знаю почему мы здесь живём", "ru"), ("I would like to know why it is so", "en"), ("私は毎日友達と学校へ行きます", "ja"))]
    rows += [(900 + i, "오늘은 친구와 함께 학교에 갔습니다", "en") for i in range(20)]  # wrong labels
    codes = spark.createDataFrame(CODES, "label string, lang string")
    fitted = I.train(spark.createDataFrame(rows, "pair_id long, original string, lang_label string"), codes)
    assert fitted.scripts.of == {f: f for f in I.FAMILIES} and all(0.6 < c <= 1 for c in fitted.scripts.confidence.values())
    sure = lambda t: fitted.segments(t)[0]
    russian, ukrainian = sure("Я не знаю почему мы здесь"), sure("Я їхав її є ще їжа її")
    assert russian.lang == ukrainian.lang == "ru" and ukrainian.confidence < 0.8 < russian.confidence
    assert not russian.fitted and sure("I would like to know why").fitted


def test_held_out_accuracy(spark):
    """Machines fitted on some sentences know the language of others."""
    names = {"en": "I would like to know why the {} from {} is so quiet", "de": "Wir möchten mit {} das Buch und den {} sehen", "fr": "Nous avons perdu avec {} le pont et la {}", "es": "No sé por qué el {} de {} es muy triste", "vi": "Tôi không biết tại sao cái {} của {} lại rất buồn"}
    rng = random.Random(1)
    name = lambda: "".join(rng.choice(["ka", "lu", "mi", "ro", "ze", "pon"]) for _ in range(3))
    rows = [(i, names[x].format(name(), name()), x) for i in range(200) for x in names]
    codes = spark.createDataFrame(CODES, "label string, lang string")
    fitted = I.train(spark.createDataFrame([(i, t, x) for i, t, x in rows if i < 100], "pair_id long, original string, lang_label string"), codes)
    right = [fitted.languages(t) == [x] for i, t, x in rows if i >= 100]
    assert sum(right) / len(right) > 0.98


def test_plans():
    rng = random.Random(2)
    for capacity, n in ((10, 40), (100, 500), (2048, 3000)):
        sizes = [rng.randint(1, capacity) for _ in range(n)]
        plan = sum(P.plan({s: sizes.count(s) for s in set(sizes)}, capacity), [])
        used = {}
        for p in plan:
            assert sum(s * k for s, k in p.items.items()) <= capacity
            for s, k in p.items.items():
                used[s] = used.get(s, 0) + k * p.times
        assert used == {s: sizes.count(s) for s in set(sizes)}
        first_fit = []
        for s in sorted(sizes, reverse=True):
            for i, room in enumerate(first_fit):
                if room >= s:
                    first_fit[i] -= s
                    break
            else:
                first_fit.append(capacity - s)
        assert sum(p.times for p in plan) <= len(first_fit)
    assert P.plan({}) == ([], [])


def fewest(sizes, capacity):
    """The least number of containers, by trying all."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(sizes) or len(rooms) > best:
            return
        if i == len(sizes):
            best = min(best, len(rooms))
            return
        for room in sorted(set(rooms)):
            if room >= sizes[i]:
                rest = list(rooms)
                rest[rest.index(room)] -= sizes[i]
                put(i + 1, rest)
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best


def test_reduction_keeps_the_optimum():
    """What the reduction fixes is part of a best packing; sets of two and three that leave space are fixed."""
    rng = random.Random(8)
    loose = Counter()
    for _ in range(300):
        capacity = rng.choice((20, 50, 100))
        low = rng.choice((1, capacity // 5, capacity // 4))
        sizes = [rng.randint(low, capacity * 3 // 5) for _ in range(rng.randint(1, 9))]
        counts = Counter(sizes)
        fixed = P.reduce(counts, capacity)
        n = sum(p.times for p in fixed)
        assert all(sum(s * k for s, k in p.items.items()) <= capacity for p in fixed)
        assert n + fewest(list(counts.elements()), capacity) == fewest(sizes, capacity)
        for p in fixed:
            if sum(s * k for s, k in p.items.items()) < capacity:
                loose[sum(p.items.values())] += 1
    assert loose[2] > 50 and loose[3] > 20
    # 50 with 30 and 19: no single partner is above 30, and no pair has a second item above 19
    assert set(P.dominating(Counter([50, 30, 19, 17, 90]), 50, 100)) == {30, 19}
    # many equal items are fixed at once
    many = Counter({60: 10**9, 35: 10**9, 30: 10**9})
    assert sum(p.times for p in P.reduce(many, 100)) >= 10**9


def test_containers(spark):
    docs = [(1, "가 " * 4000), (2, None), (3, ""), (4, " "), (5, "hello world"), (6, "x")] + [(10 + i, "hello " * (i % 7)) for i in range(80)]
    frame = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, rank int")
    rows = P.containers(frame, 64).collect()
    load, pieces = {}, {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.n_tokens))
    assert max(load.values()) <= 64 and {2, 3}.isdisjoint(pieces)
    from corpuskiln.llm.tokens import VOCABULARY, encoder

    for doc, text in docs:
        if text:
            n, at = len(encoder(VOCABULARY).encode_ordinary(text)), 0
            for k, (no, start, size) in enumerate(sorted(pieces[doc])):
                assert no == k + 1 and start == at
                at += size
            assert at == n and (len(pieces[doc]) == 1 or n > 64)
    assert P.containers(frame.limit(0), 64).count() == 0


def test_permutation():
    for n in (1, 2, 7, 100, 1000):
        assert sorted(X.permute(np.arange(n), n, 5).tolist()) == list(range(n))


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, "word " * rng.randint(0, 300), rng.choice(["a", "a", "a", "b", "c", None, "other"])) for i in range(600)] + [(9001, None, "a"), (9002, "", "b")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, slot int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 2)], "source string, weight double, max_repeats int")
    rows = X.mixture(frame, targets).collect()
    assert len({(r.shard, r.slot, r.doc_id, r.token_start) for r in rows}) == len(rows)
    uses = {}
    for r in rows:
        for block_token in (r.token_start, r.token_end - 1):
            uses[r.doc_id, block_token] = uses.get((r.doc_id, block_token), 0) + 1
    source = {i: s for i, _, s in docs}
    cap = {"a": 1, "b": 3, "c": 2}
    assert all(r.round < cap[r.source] and source[r.doc_id] == r.source for r in rows)
    share = {r.source: r for r in X.shares(frame, targets).collect()}
    assert abs(share["a"].actual_share - 0.5 / 0.9) < 0.03 and abs(share["b"].actual_share - 0.3 / 0.9) < 0.03 and share["gone"].n_tokens == 0
    assert X.mixture(frame.limit(0), targets).count() == 0 and X.mixture(frame, targets.limit(0)).count() == 0

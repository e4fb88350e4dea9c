"""Languages of texts and of the stretches of mixed texts, by hierarchical discrimination (p4).

A linear machine predicts the family of each word from the scripts of its letters, taken as what they
look like.  Within a family of several languages, linear support vector machines separate each pair of
languages (one versus one); the language that wins most pairs is taken.  A word's features add up, so the
machines score single words once and a stretch by the sum of its words.

The confidence of a stretch is that of its family, of its language within the family, and the part of its
letters that the labelled texts of the language have.
"""

from __future__ import annotations

import math
import re as plain_re
import unicodedata as ud
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.lookalike import characters, look

#: Families by script, and their languages.
FAMILIES = {"hangul": ("ko",), "cyrillic": ("ru",), "latin": ("de", "en", "es", "fr", "vi"), "han": ("ja", "zh")}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
#: Words, or characters of the han family, from which a clause counts.
LEAST = {"hangul": 4, "cyrillic": 4, "latin": 4, "han": 8}
#: The machines are fitted on at most so many labelled rows.
SAMPLE = 2400
DIMENSIONS = 1 << 13
#: A stretch goes with the main language of its family unless its own one is so much better.
MARGIN = 0.25
#: A stretch without any mark is cut in two only where both parts are so clearly of their own language.
CLEAR = 1.0

#: A language with fewer labelled stretches than this in the sample also gets the text below.
FEW = 20
#: A little of each language for such tables.
SEED = {
    "ko": "오늘은 날씨가 아주 좋아서 친구와 함께 공원에 가서 책을 읽고 사진도 많이 찍었습니다. 그래서 정말 기뻤어요.",
    "ru": "Это дом, и у нас не много времени. Я хотел бы пойти с женщиной в город, потому что там очень красиво, ещё тихо и есть объявления.",
    "de": "Das ist ein Haus und wir haben nicht viel Zeit. Ich möchte mit der Frau in die Stadt gehen, weil es sehr schön ist.",
    "en": "This is a house and we do not have much time. I would like to go to the town with the woman, because it is very nice.",
    "es": "Esta es una casa y no tenemos mucho tiempo. Me gustaría ir a la ciudad con la mujer, porque es muy bonito para los niños.",
    "fr": "C'est une maison et nous n'avons pas beaucoup de temps. J'ai aimé aller en ville avec la femme, parce que c'est très beau.",
    "vi": "Đây là một ngôi nhà và chúng tôi không có nhiều thời gian. Tôi muốn đi đến thành phố với người phụ nữ, vì nó rất đẹp.",
    "ja": "これは家です。私たちはあまり時間がありません。とてもきれいなので、友達と一緒に町へ行きたいです。",
    "zh": "这是一座房子，我们没有很多时间。因为那里很漂亮，所以我想和朋友一起去城市。他们说了什么？",
}

_LETTERS = re.compile(
    r"(?P<hangul>\p{Hangul}+)|(?P<latin>\p{Latin}[\p{Latin}\p{M}]*(?:['’]\p{Latin}[\p{Latin}\p{M}]*)*)|(?P<cyrillic>\p{Cyrillic}[\p{Cyrillic}\p{M}]*)|(?P<han>[\p{Han}\p{Hiragana}\p{Katakana}ー々]+)"
)
_CLAUSE = re.compile(r"[.!?。！？…\n()\[\]{}«»<>\"“”]+|\s[/|\-–—]+\s|^[/|\-–—]+\s|[;；:：]\s")
_KANA = re.compile(r"[\p{Hiragana}\p{Katakana}]")
_HAN_RUN = re.compile(r"[\p{Han}，,、：:“”0-9]{8,}")
_HAN = re.compile(r"\p{Han}")
# Korean in plain characters, and the Latin words that may make it more than that
_PLAIN = plain_re.compile("[ -~\n가-힣ㄱ-ㅎㅏ-ㅣ‘’“”…·]*")
_LATIN_WORD = plain_re.compile("[A-Za-z]+")
_LATIN = plain_re.compile("[A-Za-z'’]")
_HANGUL = plain_re.compile("[가-힣ㄱ-ㅣ]")


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) & (DIMENSIONS - 1)


@lru_cache(200_000)
def features(word: str, family: str) -> np.ndarray:
    """Buckets of a word's substrings of up to three letters and of the word, or of a character."""
    if family == "han":
        kind = "kana" if _KANA.match(word) else "han"
        return np.array([_bucket(word), _bucket(f"={kind}")])
    w = f"^{word.lower()}$"
    return np.array([_bucket(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)] + [_bucket(w)])


@dataclass
class Machines:
    """The one-versus-one machines of a family: a weight row and a bias for each pair."""

    family: str
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray
    memo: dict = field(default_factory=dict)

    def word(self, word: str) -> np.ndarray:
        score = self.memo.get(word)
        if score is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            score = self.memo[word] = self.weights[:, features(word, self.family)].mean(axis=1)
        return score

    def __post_init__(self) -> None:
        self.langs = FAMILIES[self.family]
        place = {x: i for i, x in enumerate(self.langs)}
        self.first, self.second = (np.array([place[p[k]] for p in self.pairs]) for k in (0, 1))
        self.wins, self.losses = (np.eye(len(self.langs))[x] for x in (self.first, self.second))
        # the pair of two languages, and whether its margin is that of the first of them
        self.pair, self.sign = np.zeros((len(self.langs),) * 2, np.int64), np.zeros((len(self.langs),) * 2)
        for i, (x, y) in enumerate(zip(self.first, self.second)):
            self.pair[x, y] = self.pair[y, x] = i
            self.sign[x, y], self.sign[y, x] = 1, -1

    def margins(self, words: list[str]) -> np.ndarray:
        return np.sum([self.word(w) for w in words], axis=0) / len(words) + self.bias

    def best(self, margins: np.ndarray) -> np.ndarray:
        """The place of the language that wins most pairs, for each row; the margins of its pairs decide ties."""
        vote = 1 + 0.4 * np.tanh(np.abs(margins))
        ahead = margins > 0
        return np.argmax((vote * ahead) @ self.wins + (vote * ~ahead) @ self.losses, axis=1)

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """The language that wins most pairs, and its confidence: that of its closest pair."""
        i = int(self.best(margins[None])[0])
        own = (margins[self.pair[i]] * self.sign[i])[np.arange(len(self.langs)) != i]
        return self.langs[i], float(1 / (1 + math.exp(-3 * own.min())))

    def against(self, margins: np.ndarray, a: str, b: str) -> float:
        """The margin of a over b."""
        i, j = self.langs.index(a), self.langs.index(b)
        return float(margins[self.pair[i, j]] * self.sign[i, j])


def fit(family: str, examples: list[tuple[str, list[str]]], rounds: int = 40, penalty: float = 1e-3) -> Machines:
    """Fit the machines of a family on (language, words); labels that they contradict are then left out."""
    pairs = list(combinations(FAMILIES[family], 2))
    weights, bias = np.zeros((len(pairs), DIMENSIONS), np.float32), np.zeros(len(pairs), np.float32)
    parts = [[features(w, family) for w in words] for _, words in examples]
    index = np.concatenate([b for p in parts for b in p])
    value = np.concatenate([np.full(len(b), 1 / len(b) / len(p), np.float32) for p in parts for b in p])
    row = np.repeat(np.arange(len(parts)), [sum(map(len, p)) for p in parts])
    label = np.array([lang for lang, _ in examples])
    for k, (a, b) in enumerate(pairs):
        trusted = np.isin(label, (a, b))
        for again in range(2):
            use = np.flatnonzero(trusted)
            keep = trusted[row]
            ix, vx = index[keep], value[keep]
            rx = np.searchsorted(use, row[keep])
            y = np.where(label[use] == a, 1.0, -1.0)
            if not len(use):
                break
            weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
            w, c, speed = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS)
            for i in range(rounds):
                score = np.bincount(rx, weights=w[ix] * vx, minlength=len(use)) + c
                push = np.where(y * score < 1, y * weight, 0.0)
                step = 20.0 / (1 + 0.05 * i)
                speed = 0.8 * speed + np.bincount(ix, weights=push[rx] * vx, minlength=DIMENSIONS) - penalty * w
                w += step * speed
                c += 0.2 * push.sum()
            weights[k], bias[k] = w, c
            wrong = y * (np.bincount(rx, weights=w[ix] * vx, minlength=len(use)) + c) < 0
            trusted = trusted.copy()
            trusted[use[wrong]] = False
    return Machines(family, pairs, weights, bias)


SCRIPTS = ("hangul", "cyrillic", "latin", "han")


@dataclass
class Families:
    """The machine of the families: a weight row for each family over the shares of scripts."""

    weights: np.ndarray  # (families, scripts)

    def __post_init__(self) -> None:
        names = list(FAMILIES)
        # a word has letters of one script, so its family and that family's confidence are the script's
        odds = np.exp(self.weights - self.weights.max(axis=0))
        self.of = {script: names[int(i)] for script, i in zip(SCRIPTS, self.weights.argmax(axis=0))}
        self.confidence = dict(zip(SCRIPTS, (odds.max(axis=0) / odds.sum(axis=0)).tolist()))


def fit_families(examples: list[tuple[str, np.ndarray]], rounds: int = 60) -> Families:
    """One hinge machine for each family against the rest, on (family, shares of scripts).

    Examples whose label the machines contradict are left out of a second fit, as labels may be wrong.
    """
    names = list(FAMILIES)
    shares = np.array([x for _, x in examples])
    label = np.array([names.index(f) for f, _ in examples])
    use = np.ones(len(label), bool)
    for _ in range(2):
        weights = np.zeros((len(names), len(SCRIPTS)))
        for i in range(len(names)):
            y = np.where(label == i, 1.0, -1.0)
            for r in range(rounds):
                push = use & (y * (shares @ weights[i]) < 1)
                side = [np.sum(use & (y == v)) or 1 for v in (1.0, -1.0)]
                weight = np.where(y > 0, 1 / side[0], 1 / side[1]) * push
                weights[i] += 4.0 / (1 + 0.1 * r) * ((y * weight) @ shares)
        use = (shares @ weights.T).argmax(axis=1) == label
    return Families(4 * weights)


@dataclass
class Segment:
    start: int
    end: int
    script: str
    words: list[str]
    family: str = ""
    lang: str = ""
    confidence: float = 1.0
    fitted: bool = False  # whether machines chose among languages


def alphabet(word: str) -> list[str]:
    """The letters of a word: those that syllables are made of; of Han and kana only the kind."""
    if _HAN.search(word) or _KANA.search(word):
        return ["kana" if _KANA.match(c) else "han" for c in word]
    return [c for c in ud.normalize("NFD", word.lower()) if c.isalpha() or ud.combining(c)]


def _units(family: str, words: list[str]) -> list[str]:
    return [c for w in words for c in w] if family == "han" else words


def clauses(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for cut in _CLAUSE.finditer(text):
        if cut.start() > at:
            yield at, cut.start()
        at = cut.end()
    if at < len(text):
        yield at, len(text)


def families(text: str) -> tuple[list[Segment], Segment | None]:
    """(the stretches of one script that count, all the words of the text's main script)."""
    segments: list[Segment] = []
    total: dict[str, list] = {}
    for a, b in clauses(text):
        runs: list[Segment] = []
        size: Counter = Counter()
        for m in _LETTERS.finditer(text, a, b):
            family = m.lastgroup
            n = len(m[0]) if family == "han" else 1
            size[family] += n
            total.setdefault(family, []).append(m[0])
            if runs and runs[-1].script == family:
                runs[-1].end = m.end()
                runs[-1].words.append(m[0])
            else:
                runs.append(Segment(m.start(), m.end(), family, [m[0]]))
        if not runs:
            continue
        # a clause belongs to the family that most of it is of; others in it need a run of their own
        share = {f: size[f] / LEAST[f] for f in size}
        main = max(sorted(share), key=lambda f: share[f])
        if share[main] >= 1:
            own = [r for r in runs if r.script == main]
            segments.append(Segment(own[0].start, own[-1].end, main, [w for r in own for w in r.words]))
        for r in runs:
            if r.script != main and (sum(map(len, r.words)) if r.script == "han" else len(r.words)) >= LEAST[r.script]:
                segments.append(r)
    if not total:
        return [], None
    letters = {f: sum(map(len, w)) * (2 if f in ("hangul", "han") else 1) for f, w in total.items()}
    main = max(sorted(letters), key=lambda f: letters[f])
    return segments, Segment(0, len(text), main, total[main])


def _apart(segment: Segment, text: str) -> list[Segment]:
    """Stretches of Han characters without kana stand apart from Japanese."""
    body = text[segment.start : segment.end]
    if segment.script != "han" or not _KANA.search(body):
        return [segment]
    out, at = [], 0
    for m in _HAN_RUN.finditer(body):
        if len(_HAN.findall(m[0])) >= LEAST["han"]:
            out += [(at, m.start()), (m.start(), m.end())]
            at = m.end()
    out.append((at, len(body)))
    made = [Segment(segment.start + a, segment.start + b, "han", [m[0] for m in _LETTERS.finditer(body, a, b) if m.lastgroup == "han"], segment.family) for a, b in out if b > a]
    made = [s for s in made if sum(map(len, s.words)) >= LEAST["han"]]
    return made or [segment]


def _latin_clause(text: str) -> bool:
    """Whether a clause of a plain text has as many Latin words, over all its runs, as count."""
    least = LEAST["latin"]
    return len(_LATIN_WORD.findall(text)) >= least and any(len(_LATIN_WORD.findall(text, a, b)) >= least for a, b in clauses(text))


class Identifier:
    """Finds the languages of texts with fitted machines."""

    def __init__(self, machines: dict[str, Machines], scripts: Families, letters: dict[str, frozenset]) -> None:
        self.machines, self.scripts, self.letters = machines, scripts, letters

    def _sure(self, segment: Segment) -> float:
        """Confidence of a stretch's family, and the part of its letters that its language is known to have."""
        seen = self.letters.get(segment.lang, frozenset())
        own = [x for w in segment.words for x in alphabet(w)]
        return self.scripts.confidence[segment.script] * (sum(x in seen for x in own) + 0.5) / (len(own) + 1)

    def _split(self, segment: Segment, text: str) -> list[Segment]:
        """Cut a stretch of words in two where two languages explain it much better than one."""
        least = LEAST[segment.script]
        machine = self.machines[segment.family]
        words = segment.words
        if segment.script == "han" or len(words) < 2 * least:
            return [segment]
        upto = np.cumsum([machine.word(w) for w in words], axis=0)
        n = len(words)
        whole = int(machine.best(upto[-1:] / n + machine.bias)[0])
        i = np.arange(least, n - least + 1)
        left, right = upto[i - 1] / i[:, None] + machine.bias, (upto[-1] - upto[i - 1]) / (n - i)[:, None] + machine.bias
        a, b = machine.best(left), machine.best(right)
        pair, sign, at = machine.pair[a, b], machine.sign[a, b], np.arange(len(i))
        gain = np.where((a != b) & ((a == whole) | (b == whole)), np.minimum(left[at, pair] * sign, -right[at, pair] * sign), 0)
        best = int(i[gain.argmax()]) if gain.max() > CLEAR else None
        if best is None:
            return [segment]
        spots = [m for m in _LETTERS.finditer(text, segment.start, segment.end) if m.lastgroup == segment.script]
        return [Segment(segment.start, spots[best - 1].end(), segment.script, words[:best], segment.family), Segment(spots[best].start(), segment.end, segment.script, words[best:], segment.family)]

    def segments(self, text: str, sure: bool = True) -> list[Segment]:
        """The stretches of a text that count, each with its language and, if asked for, its confidence; one
        for a text without a clause."""
        found, main = families(text)
        if main is None:
            return []
        for s in (*found, main):
            s.family = self.scripts.of[s.script]
        if not found:
            found = [main]
        else:
            found = [p for s in found for q in _apart(s, text) for p in self._split_if(q, text)]
        for family, machine in self.machines.items():
            own = [s for s in found if s.family == family]
            if not own:
                continue
            scores = [machine.margins(_units(family, s.words)) for s in own]
            sizes = np.array([len(_units(family, s.words)) for s in own], float)
            chief = machine.decide(np.average(scores, axis=0, weights=sizes))[0] if len(own) > 1 else None
            for s, m in zip(own, scores):
                s.fitted = True
                s.lang, s.confidence = machine.decide(m)
                if chief and s.lang != chief and machine.against(m, s.lang, chief) < MARGIN:
                    s.lang, s.confidence = chief, 0.5
        for s in found:
            s.lang = s.lang or FAMILIES[s.family][0]
            if sure:
                s.confidence *= self._sure(s)
        return found

    def _split_if(self, segment: Segment, text: str) -> list[Segment]:
        return self._split(segment, text) if segment.family in self.machines else [segment]

    def languages(self, text: str) -> list[str]:
        if _HANGUL.search(text) and _PLAIN.fullmatch(text) and not _latin_clause(text) and len(_LATIN.findall(text)) < 2 * len(_HANGUL.findall(text)):
            return ["ko"]
        return sorted({s.lang for s in self.segments(prepared(text), sure=False)})


def prepared(text: str) -> str:
    """The text with its letters as what they look like."""
    return look(characters(text))


def train(rows: DataFrame, codes: DataFrame, sample: int = SAMPLE) -> Identifier:
    """Fit the machines on labelled rows, chosen by a hash of their id: at most ``sample`` of the languages
    that share a family, and a tenth of it of each other language."""
    labelled = rows.select("pair_id", "original", "lang_label").join(F.broadcast(codes.select(F.col("label").alias("lang_label"), "lang").distinct()), "lang_label").filter("original is not null")
    several = [x for f in FAMILIES.values() if len(f) > 1 for x in f]
    first = lambda langs, n: labelled.filter(F.col("lang").isin(langs)).orderBy(F.xxhash64("pair_id"), "original").limit(n).select("lang", "original")
    chosen = first(several, sample)
    for lang in sorted({*LANGUAGES} - {*several}):
        chosen = chosen.union(first([lang], max(1, sample // 10)))
    texts = [(r["lang"], r["original"]) for r in chosen.collect()]
    family_of = {x: f for f, langs in FAMILIES.items() for x in langs}
    examples: dict[str, list[tuple[str, list[str]]]] = {f: [] for f, langs in FAMILIES.items() if len(langs) > 1}
    shares, letters, usable = [], {lang: Counter() for lang in LANGUAGES}, Counter()

    def learn(lang: str, text: str) -> None:
        found, main = families(prepared(text))
        if main is None:
            return
        size = Counter({main.script: sum(map(len, main.words))})
        for s in found:
            size[s.script] = max(size[s.script], sum(map(len, s.words)))
        shares.append((family_of[lang], np.array([size[x] for x in SCRIPTS]) / sum(size.values())))
        for s in found:
            if lang in FAMILIES[s.script]:
                usable[lang] += 1
                letters[lang].update(x for w in s.words for x in alphabet(w))
                if s.script in examples:
                    examples[s.script].append((lang, _units(s.script, s.words)))

    for lang, text in texts:
        if lang in family_of:
            learn(lang, text)
    for lang, text in SEED.items():
        if usable[lang] < FEW:
            learn(lang, text)
    known = {lang: frozenset(c) for lang, c in letters.items()}
    return Identifier({f: fit(f, x) for f, x in examples.items()}, fit_families(shares), known)


_FIELDS = ("original", "corrected")


def _languages(identifier: Identifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("pair_id"), batch.column("lang_label")]
            for name in _FIELDS:
                columns.append(pa.array([identifier.languages(t) if t else [] for t in batch.column(name).to_pylist()], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=["pair_id", "lang_label", *_FIELDS])

    return run


def _segments(identifier: Identifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for name in _FIELDS:
                for pair, raw in zip(batch.column("pair_id").to_pylist(), batch.column(name).to_pylist()):
                    text = prepared(raw) if raw else ""
                    for i, s in enumerate(sorted(identifier.segments(text), key=lambda s: s.start) if text else ()):
                        for column, value in zip(out, (pair, name, i + 1, text[s.start : s.end], s.lang, float(s.confidence), s.fitted)):
                            column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["pair_id", "field", "segment_no", "segment", "lang", "confidence", "fitted"])

    return run


def segments(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Each stretch of each field with its language and confidence, and whether machines chose among the
    languages of its family (``fitted``); null and letterless fields have none."""
    identifier = train(rows, codes)
    return rows.select("pair_id", *_FIELDS).distinct().mapInArrow(_segments(identifier), "pair_id long, field string, segment_no int, segment string, lang string, confidence double, fitted boolean")


def documents(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Each language of each field with its share of the stretches' length, its mean confidence, and the part
    of it that machines chose among several languages."""
    parts = segments(rows, codes).withColumn("n", F.char_length("segment"))
    per = parts.groupBy("pair_id", "field", "lang").agg(F.sum("n").alias("chars"), (F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("confidence"), (F.sum(F.when(F.col("fitted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("fitted_share"))
    total = parts.groupBy("pair_id", "field").agg(F.sum("n").alias("total"))
    return per.join(total, ["pair_id", "field"]).select("pair_id", "field", "lang", (F.col("chars") / F.col("total")).alias("share"), "confidence", "fitted_share")


def found(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Languages (``pair_id``, ``field``, ``lang``) of pairs whose label is missing or wrong or that mix.

    A label counts as missing if ``codes`` does not have it.  If ``original`` has no letters its label is
    not looked at.  Null, empty and letterless fields have no row.  Repeated rows give their rows once.
    """
    identifier = train(rows, codes)
    named = rows.select("pair_id", "lang_label", *_FIELDS).mapInArrow(_languages(identifier), "pair_id long, lang_label string, original array<string>, corrected array<string>")
    # the codes are a fixed table of some dozens of spellings
    marked = named.join(F.broadcast(codes.select(F.col("label").alias("lang_label"), F.col("lang").alias("named"))), "lang_label", "left")
    wrong = (F.size("original") > 0) & ~F.array_contains("original", F.coalesce("named", F.lit("")))
    counted = marked.filter(wrong | (F.size("original") > 1) | (F.size("corrected") > 1))
    both = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("langs")) for f in _FIELDS))).alias("f")
    return counted.select("pair_id", both).select("pair_id", "f.field", F.explode("f.langs").alias("lang")).distinct()

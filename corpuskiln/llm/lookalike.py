"""One consistent form for texts that look the same, and the texts that do (p5).

Characters first: compatibility, width and composition forms become one, invisible characters go, kinds
of space become one.  Then tokens of alphabetic letters.  Each token has a dominant script, that of its
letters which exist in one alphabet only; a token without such letters follows its text.  Look-alikes of
other alphabets are replaced by the letters of that script, or of the next one, whose result is a word of
the corpus: a clean copy of a text, if there is one, decides how the others are written.  Where no result
is a word of the corpus, letters of the same shape in Latin, Cyrillic and Greek go to the first of these
scripts, as they cannot be told apart; letters of other alphabets, whose shapes are only close, stay.
"""

from __future__ import annotations

import re as plain_re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm.setjoin import members
from corpuskiln.util import cut

# Letters of the same shape, Latin with Cyrillic and Latin with Greek.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜаеорсухѕіјһԁԛԝ", "ABESIJKMHOPCTYXYQWaeopcyxsijhdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονραικυχϲϳ", "ABEZHIKMNOPTYXovpaikuxcj"))

TO_LATIN = str.maketrans(CYRILLIC | GREEK)
#: For each alphabet, the letter that stands for a Latin one; the first of two wins.
FROM_LATIN = {"L": {}, "C": str.maketrans({v: k for k, v in reversed(CYRILLIC.items())}), "G": str.maketrans({v: k for k, v in reversed(GREEK.items())})}
#: Latin letters that another alphabet has as well.
SHARED = set(CYRILLIC.values()) | set(GREEK.values())

_INVISIBLE = re.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️\U000e0100-\U000e01ef]+")
_SPACE = re.compile(r"[\p{Zs}\t]")
_BREAK = re.compile("\r\n?|[\x0b\x0c\x85  ]")
_WORD = re.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}][\p{Latin}\p{Cyrillic}\p{Greek}\p{M}]*")
_NEEDS = re.compile(r"[\p{Cf}\p{Zs}\t\r\x0b\x0c\x85  ͏ᅟᅠ឴឵᠋-᠏ㄱ-ㆎㅤﾠ-ￜ︀-️ᄀ-ᇿ\U000e0100-\U000e01ef--\ ]", re.V1)
_JAMO = re.compile("[ᄀ-ᇿㄱ-ㆎﾡ-ￜ]")

# single Hangul letters stay single: kept from composing, then all brought to one kind
_HALF = {cp: ud.normalize("NFKD", chr(cp)) for cp in range(0xFFA1, 0xFFDD) if ud.name(chr(cp), "")}
_HALF = {cp: int(ud.decomposition(chr(cp)).split()[1], 16) for cp in _HALF}
_HIDE = {cp: cp + 0xF0000 for cp in range(0x3131, 0x318F)}
_SHOW = {v: k for k, v in _HIDE.items()}
_SINGLE = {ord(ud.normalize("NFKC", chr(cp))): cp for cp in range(0x318E, 0x3130, -1) if len(ud.normalize("NFKC", chr(cp))) == 1}


# characters that every step leaves alone
_PLAIN = plain_re.compile("[ -~\n가-힣ぁ-ゖァ-ヺー一-鿿、。「」‘’“”·¡¿À-ÖØ-öø-ÿА-яЁё]*")
_COULD_BE_OTHER = plain_re.compile("[Ͱ-\u052fἀ-\u1fffᲀ-᲏ⷠ-ⷿꙀ-ꚟ]")

_COULD_BE_WORD = plain_re.compile("[A-Za-z\u00c0-\u052f\u1e00-\u1fffＡ-ｚ]")
#: Alphabets of which only letters with a close Latin shape matter: Armenian, Cherokee, Coptic, Lisu.
FURTHER = ((0x530, 0x58F), (0x13A0, 0x13FF), (0x2C80, 0x2CFF), (0xA4D0, 0xA4FF), (0xAB70, 0xABBF))
_FURTHER = "".join(f"{chr(a)}-{chr(b)}" for a, b in FURTHER)
_FOREIGN = plain_re.compile(_COULD_BE_OTHER.pattern[:-1] + _FURTHER + "]")
_TOKEN = re.compile(_WORD.pattern.replace("]", _FURTHER + "]"))


def characters(text: str) -> str:
    """The text with one form of each character, no invisible ones, and one kind of space."""
    if _PLAIN.fullmatch(text):
        return text
    if text.isascii():
        return _BREAK.sub("\n", text).replace("\t", " ") if "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text else text
    if not _NEEDS.search(text) and ud.is_normalized("NFKC", text):
        return text
    text = _INVISIBLE.sub("", text)
    if _JAMO.search(text):
        text = ud.normalize("NFKC", text.translate(_HALF).translate(_HIDE)).translate(_SINGLE).translate(_SHOW)
    else:
        text = ud.normalize("NFKC", text)
    text = _INVISIBLE.sub("", text)
    return _BREAK.sub("\n", _SPACE.sub(" ", text))


def script(letter: str) -> str:
    cp = ord(letter)
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return "G"
    if 0x400 <= cp < 0x530 or 0x1C80 <= cp < 0x1C90 or 0x2DE0 <= cp < 0x2E00 or 0xA640 <= cp < 0xA6A0:
        return "C"
    return "L" if letter.isalpha() else ""


def _letters(word: str) -> tuple[str, str]:
    """(decomposed word, the same with all look-alikes as Latin letters)."""
    apart = ud.normalize("NFD", word)
    return apart, apart.translate(TO_LATIN)


def dominant(folded: str) -> str:
    """The script of the letters that one alphabet alone has; '' if there are none or of several."""
    own = {script(c) for c in folded if c not in SHARED} - {""}
    return own.pop() if len(own) == 1 else ""


def mixed(word: str) -> bool:
    return len({script(c) for c in ud.normalize("NFD", word)} - {""}) > 1


def in_script(folded: str, to: str) -> str:
    return ud.normalize("NFC", folded.translate(FROM_LATIN.get(to) or {}))


def repair(word: str) -> str:
    """The word with its look-alikes in its dominant script (the commonest one, where none is its own)."""
    apart, folded = _letters(word)
    to = dominant(folded)
    if not to:
        seen = Counter(script(c) for c in apart)
        seen.pop("", None)
        to = max(sorted(seen), key=lambda s: seen[s])
    return in_script(folded, to)


def look(text: str) -> str:
    """A form that is equal for texts of the same look: all words in the script that theirs implies."""
    if not _COULD_BE_OTHER.search(text):
        return text
    folded = {w: _letters(w)[1] for w in set(_WORD.findall(text))}
    own = Counter(script(c) for w in folded.values() for c in w if c not in SHARED)
    whole = max("LCG", key=lambda s: own[s])  # what words without a letter of their own follow

    def one(match: re.Match) -> str:
        word = folded[match[0]]
        scripts = {script(c) for c in word if c not in SHARED} - {""}
        return in_script(word, scripts.pop() if len(scripts) == 1 else whole if not scripts else "L")

    return _WORD.sub(one, text)


def close_letters(spark: SparkSession) -> dict[int, str]:
    """Letters of further alphabets with the Latin letter whose shape they come close to.

    Taken from Unicode's confusables data, as the ICU library that Spark itself uses holds them.
    """
    letters = [chr(c) for a, b in FURTHER for c in range(a, b + 1) if chr(c).isalpha()]
    latin = [*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    shapes = checker.getSkeleton("\n".join(latin + letters)).split("\n")
    of = {}
    for letter, shape in zip(latin, shapes):
        of.setdefault(shape, []).append(letter)
    # a shape that two Latin letters have (I and l) goes to the one of the same case
    best = lambda c, found: max(found, key=lambda x: x.islower() == c.islower())
    return {ord(c): best(c, of[shape]) for c, shape in zip(letters, shapes[len(latin) :]) if shape in of}


def choices(text: str, close: dict[int, str]) -> list[tuple[str, list[str], bool]]:
    """(token, forms in order of preference, whether the first may stand without the corpus).

    Only tokens that are not of their first form; depends on the text's look alone, so texts of one look
    ask the same.
    """
    own: Counter = Counter()
    apart: dict[str, tuple[str, bool]] = {}
    for token in set(_TOKEN.findall(text)):
        plain = ud.normalize("NFD", token)
        further = [c for c in plain if FURTHER[0][0] <= ord(c) and any(a <= ord(c) <= b for a, b in FURTHER)]
        if further and (len(further) == sum(c.isalpha() for c in plain) or any(ord(c) not in close for c in further)):
            continue  # a word of its own alphabet
        folded = plain.translate(close).translate(TO_LATIN)
        apart[token] = folded, not further
        if not further:
            own.update(script(c) for c in folded if c not in SHARED)
    whole = max("LCG", key=lambda s: own[s])
    out = []
    for token, (folded, sure) in apart.items():
        scripts = {script(c) for c in folded if c not in SHARED} - {""}
        order = scripts if len(scripts) == 1 else "L" if scripts else dict.fromkeys(whole + "LCG")
        forms = [f for f in (in_script(folded, s) for s in order) if len(scripts) > 1 or not mixed(f)]
        if forms and (forms[0] != token or not sure):
            out.append((token, forms, sure))
    return sorted(out)


_FIELDS = ("original", "corrected")
_ASKED = pa.list_(pa.struct([("token", pa.string()), ("forms", pa.list_(pa.string())), ("sure", pa.bool_())]))
_BASE = "pair_id long, field string, raw string, text string, asked array<struct<token: string, forms: array<string>, sure: boolean>>"


def _base(close: dict[int, str]):
    """Each field with its characters made one, and the tokens that the corpus is asked about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in _FIELDS:
                raw = batch.column(field).cast(pa.string())
                kept = raw.is_valid()
                raw = raw.filter(kept)
                texts = [characters(x) for x in raw.to_pylist()]
                asked = [[dict(zip(("token", "forms", "sure"), c)) for c in choices(t, close)] or None if _FOREIGN.search(t) else None for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("pair_id").filter(kept), pa.array([field] * len(texts), pa.string()), raw, pa.array(texts, pa.string()), pa.array(asked, _ASKED)], names=["pair_id", "field", "raw", "text", "asked"])

    return run


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of one script in each batch, each once."""
    for batch in batches:
        seen: set[str] = set()
        for field in _FIELDS:
            for text in batch.column(field).to_pylist():
                if text and _COULD_BE_WORD.search(text):
                    seen.update(_TOKEN.findall(characters(text)))
        words = [w for w in seen if w.isascii() or not mixed(w)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the first form that the corpus knows in place of each token, or the first where that is sure."""
    for batch in batches:
        texts = []
        for text, answers in zip(batch.column("text").to_pylist(), batch.column("answers").to_pylist()):
            to: dict[str, tuple] = {}
            for x in answers:
                rank = (0, x["at"]) if x["known"] else (1, x["at"]) if x["sure"] and x["at"] == 0 else None
                if rank and (x["token"] not in to or rank < to[x["token"]][0]):
                    to[x["token"]] = rank, x["form"]
            texts.append(_TOKEN.sub(lambda m, to=to: to[m[0]][1] if m[0] in to else m[0], text) if to else text)
        yield pa.RecordBatch.from_arrays([batch.column("pair_id"), batch.column("field"), batch.column("raw"), pa.array(texts, pa.string())], names=["pair_id", "field", "raw", "text"])


def normalized(rows: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``pair_id``, ``field``, the ``raw`` text and its consistent ``text`` for each non-null field.

    ``vocabulary`` (``word``) stands for the words of the corpus, else those of ``rows`` do.  Empty texts
    stay empty.  Repeated rows with a token in question are kept once; other columns are ignored.
    """
    texts = rows.select("pair_id", *_FIELDS)
    base = texts.mapInArrow(_base(close_letters(rows.sparkSession)), _BASE)
    # few texts have tokens in question; they are cut, as they are read twice
    asked = cut(base.filter("asked is not null").select("pair_id", "field", "raw", "text", F.explode("asked").alias("a")))
    forms = asked.select("pair_id", "field", "raw", "text", "a.token", "a.sure", F.posexplode("a.forms").alias("at", "form"))
    words = vocabulary if vocabulary is not None else texts.mapInArrow(_vocabulary, "word string").distinct()
    known = forms.select("form").distinct().join(words.withColumnRenamed("word", "form"), "form", "left_semi").withColumn("known", F.lit(True))
    answered = forms.join(known, "form", "left").groupBy("pair_id", "field", "raw", "text").agg(F.collect_set(F.struct("token", "sure", "at", "form", F.coalesce("known", F.lit(False)).alias("known"))).alias("answers"))
    repaired = answered.mapInArrow(_replace, "pair_id long, field string, raw string, text string")
    return base.filter("asked is null").select("pair_id", "field", "raw", "text").union(repaired)


def found(rows: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Pairs of rows (``id_a`` < ``id_b``) whose ``field`` looks the same but is not the same string.

    Consistent texts are compared.  Rows of one string are a class; classes of one text are linked, and
    members are paired only then, in cells, so that a common sentence with one odd copy costs no more
    than its pairs.  Texts and strings are named by 128 bits.  Null and empty texts take no part.
    """
    name = lambda c: (F.xxhash64(c).alias(f"{c}1"), F.xxhash64(F.lit("second"), c).alias(f"{c}2"))
    # the one pass over all texts is cut, as it is read twice
    named = cut(normalized(rows, vocabulary).filter("raw <> ''").select("pair_id", "field", *name("text"), *name("raw")))
    look, string = ["field", "text1", "text2"], ["field", "raw1", "raw2"]
    several = named.groupBy(*look).agg(F.min(F.struct("raw1", "raw2")).alias("least"), F.max(F.struct("raw1", "raw2")).alias("most")).filter("least <> most").select(*look)
    held = named.join(several, look, "left_semi")
    classes = held.groupBy("field", "text1", "text2", "raw1", "raw2").agg(F.count("*").alias("n"))
    side = lambda x: classes.select(*look, *(F.col(c).alias(f"{c}_{x}") for c in ("raw1", "raw2", "n")))
    links = side("a").join(side("b"), look).filter("raw1_a < raw1_b or raw1_a = raw1_b and raw2_a < raw2_b").withColumns({"field_a": F.col("field"), "field_b": F.col("field")})
    both = members(links, held, held, string, keep=("field_a",)).filter("x <> y")
    return both.select(F.col("field_a").alias("field"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

"""Cleaning and tokenising of texts as Column functions; regular expressions are shared with the SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes of the cleaning steps.
FOREIGN = r"[\x{3000}-\x{303f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ff00}-\x{ff9f}\x{4e00}-\x{9faf}\x{3400}-\x{4dbf}]"
LATIN = r"[a-zA-Z]+"
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ALLOWED = r"""[^ ㄱ-ㅎㅏ-ㅣ가-힣0-9a-zA-Z@#$%&(){|}\[\]/\-><=_:;.,?!~^"（）'‘’]"""
HANGUL = r"[ㄱ-ㅎㅏ-ㅣ가-힣]"
PUNCTUATION = r"""([!"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~])"""
SPLIT_PUNCTUATION = r"""([\-=+,#/\\?:^$.@*"※~&%ㆍ!』‘|()\[\]<>`'…》])"""
STRIP_PUNCTUATION = r"""[\-=+,#/?:^$.@*"※~&%ㆍ!』‘|()\[\]<>`'…》]"""
ROUGE_DROP = r"[^A-Za-z0-9가-힣]"
#: Repeats and bracketed parts, in the order in which they go.
REPEATS = (r"( .)(?=\1)", r"( !)(?=\1)", r"( ?)(?=\1)", r"(ㅜ)(?=\1)", r"(ㅠ)(?=\1)", r"( ;)(?=\1)", r"( >)(?=\1)", r"(ㄱ)(?=\1)", r"(~)(?=\1)", r"\([^)]*\)", r"(\d+ )\)", r"<.*?>", r"\[.*?\]", r"( )(?=\1)")


def strip_foreign(c: Column) -> Column:
    """Delete CJK, kana and full-width characters, then runs of Latin letters."""
    return F.regexp_replace(F.regexp_replace(c, FOREIGN, ""), LATIN, "")


def strip(c: Column) -> Column:
    """Trim white space of every kind from both ends."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def allowed(c: Column) -> Column:
    return ~c.rlike(ALLOWED)


def has_hangul(c: Column) -> Column:
    return c.rlike(HANGUL)


def tokens(c: Column) -> Column:
    """Tokens between runs of white space, none of them empty."""
    return F.filter(F.split(c, f"{WHITE}+"), lambda t: t != "")


def split_tokens(c: Column) -> Column:
    """Tokens between single spaces, empty ones included."""
    return F.split(c, " ", -1)


def longest_token(c: Column) -> Column:
    return F.array_max(F.transform(split_tokens(c), F.length))


def pad_punctuation(c: Column) -> Column:
    """Set ASCII punctuation (but the backslash) off by spaces, then collapse spaces."""
    return F.regexp_replace(F.regexp_replace(c, PUNCTUATION, " $1 "), " +", " ")


def split_punctuation(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, SPLIT_PUNCTUATION, " $1 "), " +", " "))


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, STRIP_PUNCTUATION, ""), " +", " ")


def drop_repeats(c: Column) -> Column:
    """Delete carets, doubled marks and bracketed parts, and trim."""
    c = F.replace(c, F.lit("^"), F.lit(""))
    for pattern in REPEATS:
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def rouge_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), ROUGE_DROP, " ")


def ignoring_space_and_case(a: Column, b: Column) -> Column:
    bare = lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("")))
    return bare(a) == bare(b)


def ascii_only(c: Column) -> Column:
    """The printable ASCII characters of a text."""
    return F.regexp_replace(c, "[^ -~]", "")


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7f]")


# What the code points 128 to 159 stand for in the Windows encoding.
_WINDOWS = {i: bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def repair_windows(c: Column) -> Column:
    """Control characters that were Windows punctuation become that punctuation."""
    return F.translate(c, "".join(map(chr, _WINDOWS)), "".join(_WINDOWS.values()))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, each an array; none if there are fewer than n words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i, n))


def grams(words: Column, n: int) -> Column:
    """The n-grams of an array of words as texts."""
    return F.transform(ngrams(words, n), lambda g: F.array_join(g, " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, also where lambdas within ``use`` ask for it again and again."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def numbered(items: Column) -> Column:
    """The sorted items, each with its number among its equals, so that a multiset becomes a set."""
    return let(F.array_sort(items), lambda ordered: F.transform(ordered, lambda x, i: F.struct(x.alias("item"), (i - F.array_position(ordered, x)).alias("number"))))


def common_count(a: Column, b: Column) -> Column:
    """How many items two arrays have in common, counted with their copies."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def lacking_count(a: Column, b: Column) -> Column:
    """How many items of the first array, counted with their copies, the second has none of."""
    return let(b, lambda others: F.size(F.filter(a, lambda x: ~F.array_contains(others, x))))


def kept_items(a: Column, b: Column) -> Column:
    """The items of the first array that the second has too, with their copies and in their order."""
    return let(b, lambda others: F.filter(a, lambda x: F.array_contains(others, x)))


def item_counts(items: Column) -> Column:
    """Structs (item, cnt) of the distinct items of an array."""

    def counted(ordered: Column, kinds: Column) -> Column:
        starts = F.transform(kinds, lambda x: F.array_position(ordered, x).cast("int"))
        return let(F.array_append(starts, F.size(ordered) + 1), lambda at: F.transform(kinds, lambda x, i: F.struct(x.alias("item"), (F.get(at, i + 1) - F.get(at, i)).cast("long").alias("cnt"))))

    return let(F.array_sort(items), lambda ordered: let(F.array_distinct(ordered), lambda kinds: counted(ordered, kinds)))


def word_pairs(words: Column, overlapping: bool = True) -> Column:
    """Neighbouring words as pairs, each word twice or once."""
    pairs = ngrams(words, 2)
    return pairs if overlapping else F.filter(pairs, lambda _, i: i % 2 == 0)


def limit_words(sentences: Column, most: int) -> Column:
    """The first ``most`` words of a list of sentences, kept as sentences."""
    per = F.transform(sentences, tokens)
    used = lambda i: F.aggregate(F.slice(per, F.lit(1), i), F.lit(0), lambda s, w: s + F.size(w))
    cut = F.transform(per, lambda w, i: F.array_join(F.slice(w, F.lit(1), F.greatest(F.lit(0), F.least(F.size(w), F.lit(most) - used(i)))), " "))
    return F.filter(cut, lambda s: s != "")


def token_offsets(sentences: Column) -> Column:
    """How many tokens stand before each sentence of a list."""
    sizes = F.transform(sentences, lambda s: F.size(tokens(s)))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")), lambda a: a["out"])


def limit_characters(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


# Abbreviations that keep their full stop, always or before a number.
_PREFIXES = set("Adj Adm Adv Asst Bart Bldg Brig Bros Capt Cmdr Col Comdr Con Corp Cpl DR Dr Drs Ens Gen Gov Hon Hr Hosp Insp Lt MM MR MRS MS Maj Messrs Mlle Mme Mr Mrs Ms Msgr Op Ord Pfc Ph Prof Pvt Rep Reps Res Rev Rt Sen Sens Sfc Sgt Sr St Supt Surg v vs i.e rev e.g Nos Nr A B C D E F G H I J K L M N O P Q R S T U V W X Y Z".split())
_NUMERIC = set("No Art pp".split())


def _apostrophes(text: str, language: str) -> str:
    if language == "fr":
        text = re.sub(r"(?<=[a-zA-Z])'(?=[a-zA-Z])", "' ", text)
        return re.sub(r"(?<![a-zA-Z])'|'(?![a-zA-Z ])", " ' ", text)
    text = re.sub(r"(?<=[a-zA-Z])'(?=[a-zA-Z])", " \0", text)
    text = re.sub(r"(?<=\d)'(?=s)", " \0", text)
    return text.replace("'", " ' ").replace("\0", "'")


def tokenize(text: str, language: str = "en", brackets: bool = False) -> list[str]:
    """Words, numbers and marks of a text: dots and dashes stay together in runs, commas stay in numbers,
    full stops stay with abbreviations, and clitics come apart.  ``brackets`` writes brackets and quotes in
    the treebank's way (an opening single quote is a backtick) and splits contractions."""
    text = f" {text.strip()} "
    text = re.sub(r"([^\w\s.'`,\-\"|/])", r" \1 ", text).replace("|", " -PIPE- ")
    text = re.sub(r"(?<=\S)/(?=\S)", " / ", text)
    if brackets:
        for mark, name in zip("()[]{}", ("-LRB-", "-RRB-", "-LSB-", "-RSB-", "-LCB-", "-RCB-")):
            text = text.replace(mark, f" {name} ")
        text = re.sub(r"(?<=\S)\"|\"(?=\s*$)", " '' ", text)
        text = text.replace('"', " `` ").replace("''", "\3")
        text = re.sub(r"(?<=\s)'(?=\S)", " ` ", text)
        text = re.sub(r"'(ll|re|ve|LL|RE|VE)", " \4\\1", text)
        text = re.sub(r"(n)'(t)|(N)'(T)", lambda m: " " + (m[1] or m[3]) + "\4" + (m[2] or m[4]), text)
        text = re.sub(r"([Cc])annot", r"\1an not", text)
    runs: list[str] = []

    def hold(m: re.Match) -> str:
        runs.append(m[0])
        return f" \1{len(runs) - 1}\2 "

    text = re.sub(r"\.{2,}|-{2,}", hold, text)
    text = re.sub(r"(?<!\d),|,(?!\d)", " , ", text)
    text = _apostrophes(text, language)
    words = " ".join(text.split()).replace("' '", "''").split()  # two single quotes are one mark
    out: list[str] = []
    for i, word in enumerate(words):
        if len(word) > 1 and word.endswith("."):
            stem, follows = word[:-1], i + 1 < len(words) and words[i + 1][0].isdigit()
            known = "." in stem and re.search("[a-zA-Z]", stem) or stem in _PREFIXES or follows
            if not known:
                out += [stem, "."]
                continue
        out.append(word)
    out = " ".join(out).replace("' '", "''").split()
    return [re.sub("\1(\\d+)\2", lambda m: runs[int(m[1])], w).replace("\4", "'").replace("\3", "''") for w in out]


def tokenizer(language: str = "en", brackets: bool = False):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokenize(t, language, brackets) if isinstance(t, str) else None)

    return run

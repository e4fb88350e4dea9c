"""Hangul syllables: Column functions where arithmetic does, Arrow functions for contraction and distance."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskiln.functions.text import let

# Initial, medial and final letters in the order of the syllable block; ' ' is no final.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
FIRST, LAST = 0xAC00, 0xD7A3
CONSONANTS, VOWELS = (12593, 12622), (12623, 12643)


# ---- Column functions -------------------------------------------------------------------------------


def code_point(c: Column) -> Column:
    return F.ascii(c)


def character(cp: Column) -> Column:
    """The character of a code point below 65,536 (``char`` only knows 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 4, "0")), "UTF-16BE")


def _letter(letters: str, index: Column) -> Column:
    return F.substring(F.lit(letters), index + 1, F.lit(1))


def is_syllable(c: Column) -> Column:
    return code_point(c).between(FIRST, LAST)


def is_korean(c: Column) -> Column:
    """A syllable or a single letter."""
    return is_syllable(c) | code_point(c).between(CONSONANTS[0], VOWELS[1])


def is_consonant(c: Column) -> Column:
    return code_point(c).between(*CONSONANTS)


def decompose(c: Column) -> Column:
    """Struct (cho, jung, jong) of a character; '' three times where it is not Korean."""
    n = code_point(c) - FIRST
    syllable = F.struct(_letter(INITIALS, F.floor(n / 588)).alias("cho"), _letter(MEDIALS, F.floor(n / 28) % 21).alias("jung"), _letter(FINALS, n % 28).alias("jong"))
    three = lambda a, b, d: F.struct(a.alias("cho"), b.alias("jung"), d.alias("jong"))
    blank, none = F.lit(" "), F.lit("")
    return F.when(is_syllable(c), syllable).when(is_consonant(c), three(c, blank, blank)).when(code_point(c).between(*VOWELS), three(blank, c, blank)).otherwise(three(none, none, none))


def compose(cho: Column, jung: Column, jong: Column) -> Column:
    """The syllable of three letters; null where one of them cannot stand in its place."""
    at = lambda letters, c: F.when(F.instr(F.lit(letters), c) > 0, F.instr(F.lit(letters), c) - 1)
    return character(FIRST + at(INITIALS, cho) * 588 + at(MEDIALS, jung) * 28 + at(FINALS, jong))


def to_letters(text: Column) -> Column:
    """A text with each syllable broken down into its letters."""
    def one(c: Column) -> Column:
        three = lambda x: F.replace(F.concat(x["cho"], x["jung"], x["jong"]), F.lit(" "), F.lit(""))
        return F.when(is_syllable(c), let(decompose(c), three)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


# ---- plain kernels ----------------------------------------------------------------------------------


@lru_cache(1 << 16)
def parts(c: str) -> tuple[str, str, str]:
    cp = ord(c)
    if FIRST <= cp <= LAST:
        n = cp - FIRST
        return INITIALS[n // 588], MEDIALS[n // 28 % 21], FINALS[n % 28]
    if CONSONANTS[0] <= cp <= CONSONANTS[1]:
        return c, " ", " "
    if VOWELS[0] <= cp <= VOWELS[1]:
        return " ", c, " "
    return "", "", ""


def syllable(cho: str, jung: str, jong: str) -> str | None:
    if cho in ("", " ") or jung in ("", " ") or jong == "" or cho not in INITIALS or jung not in MEDIALS or jong not in FINALS:
        return None
    return chr(FIRST + INITIALS.index(cho) * 588 + MEDIALS.index(jung) * 28 + FINALS.index(jong))


def consonant(c: str) -> bool:
    return CONSONANTS[0] <= ord(c) <= CONSONANTS[1]


def with_final(c: str, letter: str) -> str | None:
    """A character with its final replaced by a letter, if that gives a syllable."""
    cho, jung, _ = parts(c)
    return syllable(cho, jung, letter)


def absorb(token: str) -> str:
    """Fold each consonant letter that follows a syllable into it as its final.

    Letters that cannot be a final, or that follow no syllable, stay.
    """
    out: list[str] = []
    for c in token:
        made = with_final(out[-1], c) if out and consonant(c) else None
        if made:
            out[-1] = made
        else:
            out.append(c)
    return "".join(out)


def join_tokens(left: str, right: str) -> tuple[str, str | None]:
    """Fold a consonant that begins ``right`` into the end of ``left``; (both, None) if that is possible."""
    made = with_final(left[-1], right[0]) if left and right and consonant(right[0]) else None
    return (left[:-1] + made + right[1:], None) if made else (left, right)


# A token spelled out: three places for each character, a syllable as initial, medial and final letter.
NO_FINAL, NO_LETTER = "-", "·"
_OPEN = "[ㅏㅓㅕㅐㅔ]-"

#: Contractions as (pattern over the spelled token, what it becomes); each is made once, at the last place.
CONTRACTIONS: dict[str, list[tuple[str, str]]] = {
    "34": [(f"ㅎ{_OPEN}ㅇ[ㅕㅏ](.)", "ㅎㅐ{1}"), (f"(?=.{_OPEN})(..)-ㅇ[ㅏㅓㅕㅐㅔ](.)", "{1}{2}")],
    "35": [("ㄴㅗㅎㅇ[ㅏㅓ]ㅆ", "ㄴㅘㅆ"), ("(.)ㅗ-ㅇㅏㅆ", "{1}ㅘㅆ"), ("(.)ㅜ-ㅇㅓㅆ", "{1}ㅝㅆ"), ("(.)ㅚ-ㅇㅓㅆ", "{1}ㅙㅆ")],
    "36": [("(.)ㅣ-ㅇㅓㅆ", "{1}ㅕㅆ")],
}
#: A stem in ㅂ that softens, at the first place; what follows the vowel goes or stays.
SOFTENED = ("ㄹ([ㅕㅓ])ㅂㅇㅓ-", "ㄹ{1}-ㅇㅝ-")
# Vowels that contract, and what they become.
_PAIRS = {"ㅗㅏ": "ㅘ", "ㅜㅓ": "ㅝ", "ㅚㅓ": "ㅙ"}


def spell(token: str) -> str:
    out = []
    for c in token:
        three = parts(c)
        out.append("".join(three).replace(" ", NO_FINAL) if FIRST <= ord(c) <= LAST else c + NO_LETTER * 2)
    return "".join(out)


def unspell(spelled: str) -> str:
    units = (spelled[i : i + 3] for i in range(0, len(spelled), 3))
    return "".join(u[0] if u[1] == NO_LETTER else syllable(u[0], u[1], u[2].replace(NO_FINAL, " ")) or "" for u in units)


@lru_cache(None)
def _compiled(name: str) -> tuple[re.Pattern, list[tuple[re.Pattern, str]]]:
    place = "|".join(re.sub(r"\((?![?])", "(?:", p) for p, _ in CONTRACTIONS[name])
    return re.compile(f"(?s)((?:...)*)(?={place})"), [(re.compile(f"(?s){p}"), re.sub(r"{(.)}", r"\\\1", r)) for p, r in CONTRACTIONS[name]]


def contract_once(spelled: str, name: str) -> str:
    """One contraction of a spelled token, at the last place that it fits."""
    place, rules = _compiled(name)
    if found := place.match(spelled):
        at = found.end()
        for pattern, made in rules:
            if hit := pattern.match(spelled, at):
                return spelled[:at] + hit.expand(made) + spelled[hit.end() :]
    return spelled


_SOFT = re.compile(f"(?s)((?:...)*?){SOFTENED[0]}(.*)")


def soften(spelled: str, keep_rest: bool) -> str:
    found = _SOFT.fullmatch(spelled)
    return found.expand(r"\1" + SOFTENED[1].replace("{1}", r"\2") + (r"\3" if keep_rest else "")) if found else spelled


def contract(token: str, keep_rest: bool = False) -> str:
    """All contractions, again and again until nothing changes."""
    spelled, before = spell(token), None
    while spelled != before:
        before = spelled
        for name in CONTRACTIONS:
            spelled = contract_once(spelled, name)
        spelled = soften(spelled, keep_rest)
    return unspell(spelled)


@lru_cache(1 << 16)
def _letter_cost(a: str, b: str) -> int:
    """Distance of two characters: of their letters if both are Korean, else 0 or 1."""
    x, y = parts(a), parts(b)
    if not x[0] or not y[0]:
        return int(a != b)
    return int(distance(list(x), list(y)))


def distance(a, b, cost: dict | None = None) -> float:
    """Levenshtein distance of two sequences, with substitution costs for some pairs."""
    if len(a) < len(b):  # costs are looked up with the longer one first
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            swap = corner + (0 if x == y else (cost or {}).get((x, y), 1))
            corner = row[j]
            row[j] = min(row[j] + 1, row[j - 1] + 1, swap)
    return row[-1]


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Two texts without the beginning and end they share; with insertions and deletions of cost 1 the distance stays."""
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    j = next((k for k in range(n - i) if a[-1 - k] != b[-1 - k]), n - i)
    return a[i : len(a) - j], b[i : len(b) - j]


def letter_distances(first: list[str], second: list[str], scale: float = 1.0) -> np.ndarray:
    """Levenshtein distances of pairs of texts whose substitutions cost the distance of their letters.

    All pairs advance together, cell by cell, sorted by length so that few cells are idle.
    """
    out = np.zeros(len(first))
    first, second = map(list, zip(*map(trimmed, first, second))) if len(first) else ([], [])
    order = sorted(range(len(first)), key=lambda i: (len(first[i]), len(second[i])))
    for at in range(0, len(order), 512):
        some = order[at : at + 512]
        chars = sorted({c for i in some for c in first[i]} | {c for i in some for c in second[i]})
        number = {c: k for k, c in enumerate(chars)}
        three = np.array([[ord(x) if x else -1 for x in parts(c)] for c in chars] or [[0, 0, 0]])
        cost = (three[:, None, :] != three[None, :, :]).sum(axis=2).astype(np.float32)
        korean = three[:, 0] >= 0
        both = korean[:, None] & korean[None, :]
        cost = np.where(both, cost * scale, 1.0)
        single = [k for k, c in enumerate(chars) if korean[k] and not FIRST <= ord(c) <= LAST]
        for k in single:  # single letters may match each other out of place
            for m in np.flatnonzero(korean):
                cost[k, m] = cost[m, k] = _letter_cost(chars[k], chars[m]) * scale
        np.fill_diagonal(cost, 0)
        la, lb = np.array([len(first[i]) for i in some]), np.array([len(second[i]) for i in some])
        a, b = np.zeros((len(some), max(1, la.max())), np.int32), np.zeros((len(some), max(1, lb.max())), np.int32)
        for r, i in enumerate(some):
            a[r, : la[r]] = [number[c] for c in first[i]]
            b[r, : lb[r]] = [number[c] for c in second[i]]
        row = np.repeat(np.arange(lb.max() + 1, dtype=np.float32)[:, None], len(some), axis=1)
        done = np.where(la == 0, lb, 0.0).astype(np.float64)
        for i in range(int(la.max(initial=0))):
            corner, row[0] = row[0].copy(), i + 1
            swap = cost[a[:, i][:, None], b].T  # (columns, pairs)
            for j in range(1, len(row)):
                up = row[j].copy()
                row[j] = np.minimum(np.minimum(up, row[j - 1]) + 1, corner + swap[j - 1])
                corner = up
            ended = la == i + 1
            done[ended] = row[lb[ended], np.flatnonzero(ended)]
        out[some] = done
    return out


# ---- Arrow functions --------------------------------------------------------------------------------


def _udf(kernel: Callable[[str], str]):
    @F.pandas_udf(T.StringType())
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: kernel(t) if t else t)

    return run


contract_token = _udf(contract)


# ---- the same over spelled tokens, as Columns ----------------------------------------------------------


def spelled(token: Column) -> Column:
    """A token spelled out, three places for each character."""
    three = lambda x: F.replace(F.concat(x["cho"], x["jung"], x["jong"]), F.lit(" "), F.lit(NO_FINAL))
    one = lambda c: F.when(is_syllable(c), let(decompose(c), three)).otherwise(F.concat(c, F.lit(NO_LETTER * 2)))
    return F.array_join(F.transform(F.split(token, ""), one), "")


def unspelled(letters: Column) -> Column:
    def one(unit: Column) -> Column:
        at = lambda i: F.substring(unit, i, 1)
        return F.when(at(2) == NO_LETTER, at(1)).otherwise(compose(at(1), at(2), F.when(at(3) == NO_FINAL, " ").otherwise(at(3))))

    return F.array_join(F.transform(F.regexp_extract_all(letters, F.lit("(?s)..."), 0), one), "")


def _spelled_rule(token: Column, change: Callable[[Column], Column]) -> Column:
    return F.when(token == "", token).otherwise(unspelled(let(spelled(token), change)))


def contracted(token: Column, name: str) -> Column:
    """One contraction of a token, at the last place that one of its patterns fits."""
    rules = CONTRACTIONS[name]
    places = [f"(?s)^((?:...)*){p}" for p, _ in rules]

    def change(letters: Column) -> Column:
        # of the patterns that fit, the one furthest on; the first of equals
        head = [F.when(letters.rlike(p), F.length(F.regexp_extract(letters, p, 1))).otherwise(-1) for p in places]
        furthest = F.greatest(*head, F.lit(-1)) if len(head) > 1 else head[0]
        out = letters
        for p, (_, made), at in reversed(list(zip(places, rules, head))):
            become = "$1" + made.replace("{2}", "$3").replace("{1}", "$2")
            out = F.when((at == furthest) & (at >= 0), F.regexp_replace(letters, p, become)).otherwise(out)
        return out

    return _spelled_rule(token, change)


def softened(token: Column) -> Column:
    """A token whose stem in ㅂ softens before a vowel; the rest of the token goes."""
    return _spelled_rule(token, lambda x: F.regexp_replace(x, f"(?s)^((?:...)*?){SOFTENED[0]}.*", "$1" + SOFTENED[1].replace("{1}", "$2")))


def absorbed(token: Column) -> Column:
    """Consonant letters that follow a syllable become its final, the last of several."""
    finals = FINALS.strip()
    pattern = f"([{INITIALS}][{MEDIALS}])[{finals}{NO_FINAL}](?:[{finals}]{NO_LETTER * 2})*([{finals}]){NO_LETTER * 2}"
    return _spelled_rule(token, lambda x: F.regexp_replace(x, pattern, "$1$2"))


def joined(left: Column, right: Column) -> Column:
    """Struct (head, tail): a consonant that begins ``right`` folded into the end of ``left``, if possible."""
    last, first = F.right(left, F.lit(1)), F.substring(right, 1, 1)
    made = F.when(is_consonant(first) & is_syllable(last), compose(decompose(last)["cho"], decompose(last)["jung"], first))
    whole = F.concat(F.substring(left, F.lit(1), F.length(left) - 1), made, F.substring(right, F.lit(2), F.length(right)))
    return F.struct(F.coalesce(whole, left).alias("head"), F.when(made.isNull(), right).alias("tail"))


@F.pandas_udf(T.DoubleType())
def letter_distance(first: pd.Series, second: pd.Series) -> pd.Series:
    """Distance in letters; null if either text is."""
    known = first.notna() & second.notna()
    out = np.full(len(first), np.nan)
    out[known.to_numpy()] = letter_distances(first[known].tolist(), second[known].tolist())
    return pd.Series(out).astype(object).where(known.reset_index(drop=True), None)


def weighted_distance(cost: dict[tuple[str, str], float]):
    """An Arrow function for the distance of characters with own substitution costs."""

    @F.pandas_udf(T.DoubleType())
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([float(distance(a, b, cost)) if isinstance(a, str) and isinstance(b, str) else None for a, b in zip(first, second)], dtype=object)

    return run


def compose_vowels(a: Column, b: Column) -> Column:
    """The vowel that two contract to, or null."""
    pairs = F.create_map(*(F.lit(x) for kv in {**_PAIRS, "ㅣㅓ": "ㅕ"}.items() for x in kv))
    return F.try_element_at(pairs, F.concat(a, b))

"""Corrected sentences and edits from annotated learner sentences."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions.hangul import absorb, consonant, contract, join_tokens
from corpuskiln.operators.shred import annotated_records


def proof(morph: dict) -> tuple[str | None, str | None]:
    """(type, corrected text) of one annotated morpheme."""
    if morph.get("preserved"):
        return "", morph["preserved"]
    if morph.get("removed"):
        return None, None
    text, tag = morph.get("proofread"), morph.get("proofread_pos")
    kind = tag[:1] if tag else "UNK"
    if text == "ADD":
        return kind, None
    if not text:
        return (kind, None) if tag else (None, None)
    return kind, text


def correct(words: list[str], annotated: list[tuple[str, list[dict]]]) -> tuple[str, list[tuple[int, int, str, str]]]:
    """(corrected sentence, edits) of a sentence's words and of its annotated words.

    Each annotated word is applied to every word of the same surface.  Pieces of a correction are put
    together, loose consonants folded in and vowels contracted; a correction that begins with a
    consonant goes into the word before it.
    """
    by_word = defaultdict(list)
    for w, morphs in annotated:
        by_word[w].append(morphs)
    out: list[str] = []
    edits: list[tuple[int, int, str, str]] = []
    for i, word in enumerate(words):
        hit = False
        for morphs in by_word.get(word, ()):
            found = [proof(m) for m in morphs]
            kinds = [k for k, _ in found if k]
            text = contract(absorb("".join(t for _, t in found if t)))
            if text:
                out.append(text)
                hit = True
            if len(morphs) > 1 or kinds:
                edits.append((i, i + 1, "::".join(kinds), text))
                hit = True
        if not hit:
            out.append(word)
    for i in range(len(out) - 1, 0, -1):
        if out[i] and consonant(out[i][0]):
            left, right = join_tokens(out[i - 1], out[i])
            out[i - 1], out[i] = left, right or ""
    return " ".join(x for x in out if x), edits


_OUT = "sentence_id long, body_key long, original string, corrected string, edits array<struct<start int, end int, cat string, cor string>>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cat", pa.string()), ("cor", pa.string())]))
    for batch in batches:
        corrected, edits = [], []
        for words, annotated in zip(batch.column("words").to_pylist(), batch.column("annotated").to_pylist()):
            text, changes = correct([w["w"] or "" for w in words or ()], [(a["w"] or "", a["morphs"] or []) for a in annotated or ()])
            corrected.append(text)
            edits.append([dict(zip(("start", "end", "cat", "cor"), e)) for e in changes])
        yield pa.RecordBatch.from_arrays([batch.column("sentence_id"), batch.column("body_key"), batch.column("original"), pa.array(corrected, pa.string()), pa.array(edits, kind)], names=["sentence_id", "body_key", "original", "corrected", "edits"])


def proofread(sentences: DataFrame, words: DataFrame, morphs: DataFrame) -> DataFrame:
    """Corrected text and edits of each sentence of the flat tables that shredding gives.

    A sentence's words and morphemes are gathered in their order; sentences are small.  Sentences
    without annotations come out as their words.
    """
    key = ["sentence_id", "body_key"]
    plain = words.filter("section = 'M'").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("word_no", "w"))).alias("words"))
    held = morphs.filter("section = 'E'").groupBy(*key, "word_no").agg(F.array_sort(F.collect_list(F.struct("morph_no", "preserved", "removed", "proofread", "proofread_pos"))).alias("morphs"))
    wrong = words.filter("section = 'E'").join(held, [*key, "word_no"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("word_no", "w", "morphs"))).alias("annotated"))
    rows = sentences.select(*key, F.rtrim("text").alias("original")).join(plain, key, "left").join(wrong, key, "left")
    return rows.mapInArrow(_run, _OUT)


def proofread_records(shredded: DataFrame) -> DataFrame:
    """The same of shredded records, gathered within each record, so that nothing is joined or moved."""
    return annotated_records(shredded).mapInArrow(_run, _OUT)

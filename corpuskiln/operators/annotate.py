"""Pairs to typed edits: align, merge, classify; lexicons come as DataFrames of tokens."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskiln.functions.text import split_tokens
from corpuskiln.operators import kernels as K

EDIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cat", T.StringType()), T.StructField("cor", T.StringType()), T.StructField("cor_start", T.IntegerType()), T.StructField("cor_end", T.IntegerType())])
MOVE = T.StructType([T.StructField("op", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("s0", "s1", "t0", "t1"))])
_LEX = "array<struct<token string, form string, tag string, morphs array<struct<m:string, pos:string>>, suggestions array<string>>>"


def _lexicon(rows, spelled: bool) -> K.Lexicon:
    if rows is None:
        return K.NEUTRAL
    lemma = {r["token"]: (r["form"], r["tag"]) for r in rows if r["form"] is not None}
    morphs = {r["token"]: [(m["m"], m["pos"]) for m in r["morphs"]] for r in rows if r["morphs"] is not None}
    return K.Lexicon(lemma, morphs, {r["token"]: list(r["suggestions"]) for r in rows if r["suggestions"] is not None} if spelled else None)


def edits_of(how: str = "rules", spelled: bool = False):
    """Arrow function (orig, cor, lexicon rows) -> edits; marked so that it is planned once."""

    @F.pandas_udf(T.ArrayType(EDIT))
    def run(orig: pd.Series, cor: pd.Series, lex: pd.Series) -> pd.Series:
        return pd.Series([None if not isinstance(o, str) or not isinstance(c, str) else [dict(zip(EDIT.names, e)) for e in K.edits(o.split(" "), c.split(" "), _lexicon(x, spelled), how)] for o, c, x in zip(orig, cor, lex)], dtype=object)

    return run.asNondeterministic()


@F.pandas_udf(T.ArrayType(MOVE))
def alignment(orig: pd.Series, cor: pd.Series) -> pd.Series:
    """The moves of the alignment of two texts' tokens, without a lexicon."""
    return pd.Series([None if not isinstance(o, str) or not isinstance(c, str) else [dict(zip(MOVE.names, m)) for m in K.align(o.split(" "), c.split(" "))] for o, c in zip(orig, cor)], dtype=object)


alignment = alignment.asNondeterministic()  # so that it is planned once


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("cost", "insertions", "deletions", "substitutions")]))
def unit_alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Unit-cost distance of characters and the average number of moves over all optimal alignments."""
    out = []
    for x, y in zip(a, b):
        grid = K.Grid(x, y)
        out.append((grid.distance, *grid.counts()))
    return pd.DataFrame(out, columns=["cost", "insertions", "deletions", "substitutions"], dtype=float)


@F.pandas_udf(T.IntegerType())
def common_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([K.common_length(list(x), list(y)) for x, y in zip(a, b)])


@F.pandas_udf(T.StructType([T.StructField("front", T.IntegerType()), T.StructField("orig", T.ArrayType(T.StringType())), T.StructField("cor", T.ArrayType(T.StringType()))]))
def shrunk(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([K.shrink(list(x), list(y)) for x, y in zip(a, b)], columns=["front", "orig", "cor"])


def insert_delete_distance(a: Column, b: Column) -> Column:
    """Distance with insertions and deletions only: both sizes less twice the common subsequence."""
    return F.size(a) + F.size(b) - 2 * common_tokens(a, b)


def annotate(pairs: DataFrame, lemma: DataFrame | None = None, pos: DataFrame | None = None, spelling: DataFrame | None = None, how: str = "rules") -> DataFrame:
    """Add ``edits`` to ``pair_id``, ``orig``, ``cor``.

    Lexicons: ``lemma`` (token, form, tag), ``pos`` (token, morphs), ``spelling`` (token, suggestions).
    Each is joined on the distinct tokens of the pairs, so it may be of any size; where one is not given
    or lacks a token, the neutral costs hold, and without a spelling lexicon no edit is of type SPELL.
    Null sides give null edits.
    """
    given = [x for x in (lemma, pos, spelling) if x is not None]
    if not given:
        return pairs.withColumn("edits", edits_of(how)("orig", "cor", F.lit(None).cast(_LEX)))
    words = pairs.select("pair_id", F.explode(F.array_distinct(F.concat(split_tokens(F.col("orig")), split_tokens(F.col("cor"))))).alias("token"))
    known = words.select("token").distinct()
    empty = {"form": "string", "tag": "string", "morphs": "array<struct<m:string, pos:string>>", "suggestions": "array<string>"}
    for x in given:
        known = known.join(x.dropDuplicates(["token"]), "token", "left")
    for c, kind in empty.items():
        known = known if c in known.columns else known.withColumn(c, F.lit(None).cast(kind))
    lex = words.join(known, "token").groupBy("pair_id").agg(F.collect_list(F.struct("token", *empty)).alias("lex"))
    return pairs.join(lex, "pair_id", "left").withColumn("edits", edits_of(how, spelling is not None)("orig", "cor", F.col("lex").cast(_LEX))).drop("lex")


def applied(tokens: Column, edits: Column, correction: Callable[[Column], Column] = lambda e: e["cor"]) -> Column:
    """The text of an array of tokens with each edit (``start``, ``end``) put in, in their order; edits of
    an empty correction leave nothing."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def put(state: Column, e: Column) -> Column:
        kept = F.slice(tokens, state["at"] + 1, F.greatest(e["start"] - state["at"], F.lit(0)))
        made = F.when(correction(e) == "", none).otherwise(F.array(correction(e)))
        return F.struct(e["end"].alias("at"), F.concat(state["out"], kept, made).alias("out"))

    rest = lambda state: F.array_join(F.concat(state["out"], F.slice(tokens, state["at"] + 1, F.greatest(F.size(tokens) - state["at"], F.lit(0)))), " ")
    return F.aggregate(edits, start, put, rest)


def exploded(annotated: DataFrame) -> DataFrame:
    """One row for each edit."""
    return annotated.select("pair_id", F.posexplode("edits").alias("edit_no", "e")).select("pair_id", "edit_no", "e.*")


def histogram(annotated: DataFrame) -> DataFrame:
    return exploded(annotated).groupBy("cat").agg(F.count("*").alias("n"))


def coarse_class(tag: Column) -> Column:
    """Coarse class of a part-of-speech tag."""
    table = F.create_map(*(F.lit(x) for kv in K.COARSE.items() for x in kv))
    return F.coalesce(F.try_element_at(table, tag), F.lit("UNCLASSIFIED"))


def composite_type(kinds: Column) -> Column:
    """One type for the sorted distinct classes of an edit's morphemes."""
    has = lambda k: F.array_contains(kinds, k)
    two = F.size(kinds) == 2
    return (
        F.when(F.size(kinds) == 1, F.element_at(kinds, 1))
        .when(two & has("ENDING") & (has("VERB") | has("ADJECTIVE")), "CONJUGATION")
        .when(has("NOUN"), "UNCLASSIFIED")
        .when(has("VERB") != has("ADJECTIVE"), "CONJUGATION")
        .otherwise("UNCLASSIFIED")
    )


def runs(moves: Column, same: str = "op") -> Column:
    """Runs of neighbouring moves, of one kind (``op``) or of edits (``edit``), as structs of spans."""
    kind = lambda m: m["op"] if same == "op" else F.when(m["op"] == "M", "M").otherwise("E")
    start = F.filter(F.sequence(F.lit(1), F.size(moves)), lambda i: (i == 1) | (kind(F.element_at(moves, i)) != kind(F.element_at(moves, F.greatest(i - 1, F.lit(1))))))
    ends = lambda k: F.when(k < F.size(start), F.element_at(start, F.least(k + 1, F.size(start))) - 1).otherwise(F.size(moves))
    return F.when(F.size(moves) > 0, F.transform(start, lambda i, k: F.struct(kind(F.element_at(moves, i)).alias("op"), F.element_at(moves, i)["s0"].alias("s0"), F.element_at(moves, ends(k + 1))["s1"].alias("s1"), F.element_at(moves, i)["t0"].alias("t0"), F.element_at(moves, ends(k + 1))["t1"].alias("t1"))))


_MORPHS = T.ArrayType(T.StructType([T.StructField("m", T.StringType()), T.StructField("pos", T.StringType())]))


@F.pandas_udf(T.ArrayType(_MORPHS))
def grouped_morphs(words: pd.Series, morphs: pd.Series) -> pd.Series:
    """The morphemes of a sentence (structs m, pos) by its words, one group for each word."""
    return pd.Series([[[{"m": m, "pos": p} for m, p in g] for g in K.morph_groups([w or "" for w in ws], [(x["m"] or "", x["pos"]) for x in ms])] for ws, ms in zip(words, morphs)], dtype=object)

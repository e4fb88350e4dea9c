"""Annotated learner corpora: SENTENCE elements of XML files, and older SGML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
_from LONG, _to LONG, s STRING,
MorphemeAnnotations STRUCT<word: ARRAY<STRUCT<w: STRING, morph: ARRAY<STRUCT<_VALUE: STRING, _analyzedType: STRING, _from: LONG, _to: LONG, _pos: STRING, _subsequence: LONG>>>>>,
LearnerErrorAnnotations STRUCT<word: ARRAY<STRUCT<w: STRING, morph: ARRAY<STRUCT<_from: LONG, _to: LONG, _subsequence: LONG, _wordStart: STRING, Preserved: STRING, Removed: STRING,
  Proofread: STRUCT<_VALUE: STRING, _pos: STRING>, ErrorArea: STRUCT<_type: STRING>, ErrorPattern: STRUCT<_type: STRING>, ErrorLevel: STRUCT<_type: STRING>>>>>>
"""


def read(spark: SparkSession, path: str, written_only: bool = False, pattern: str = "*.xml") -> DataFrame:
    """SENTENCE rows of all files below a folder, of those with 문어 in their path if asked."""
    options = {"rowTag": "SENTENCE", "recursiveFileLookup": "true", "pathGlobFilter": pattern}
    rows = spark.read.format("xml").options(**options).schema(SCHEMA).load(path)
    return rows.filter(F.input_file_name().contains("문어") | F.input_file_name().contains("%EB%AC%B8%EC%96%B4")) if written_only else rows


def with_errors(sentences: DataFrame) -> DataFrame:
    return sentences.filter(F.size("LearnerErrorAnnotations.word") > 0)


def from_text(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Sentences of XML text in a column, as ``sentence``, by the same schema."""
    return bodies.withColumn("sentence", F.from_xml(column, SCHEMA.replace("\n", " ")))


def read_sgml(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs and mistakes of SGML essays: ``nid``, ``paragraphs``, ``mistakes`` of each DOC element."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<DOC\b.*?</DOC>"), 0)).alias("doc"))
    return parse_sgml(docs)


def parse_sgml(docs: DataFrame) -> DataFrame:
    at = lambda m, name: F.regexp_extract(m, rf"(?i)\b{name}=\"?([^\"\s>]*)", 1)
    tag = lambda m, name: F.trim(F.regexp_extract(m, rf"(?is)<{name}>(.*?)</{name}>", 1))
    mistake = lambda m: F.struct(*(at(m, f"{e}_{o}").cast("int").alias(f"{e}_{o}") for e in ("start", "end") for o in ("par", "off")), tag(m, "TYPE").alias("type"), tag(m, "CORRECTION").alias("correction"))
    return docs.select(
        at(F.col("doc"), "nid").alias("nid"),
        F.transform(F.regexp_extract_all("doc", F.lit(r"(?is)<P>(.*?)</P>"), 1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")).alias("paragraphs"),
        F.transform(F.regexp_extract_all("doc", F.lit(r"(?is)<MISTAKE\b.*?</MISTAKE>"), 0), mistake).alias("mistakes"),
    )

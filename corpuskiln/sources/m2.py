"""M2 files: blocks of a source line and its annotated edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions.text import tokens

#: What stands for no edit, and for an empty correction.
NOOP = "A -1 -1|||noop||||||REQUIRED|||-NONE-|||0"
_EDIT = r"^A (-?\d+) (-?\d+)\|\|\|(.*?)\|\|\|(.*?)\|\|\|(.*?)\|\|\|(.*?)\|\|\|(\d+)\s*$"


def edit_line(e: Column) -> Column:
    return F.concat(F.lit("A "), F.concat_ws("|||", F.concat_ws(" ", e["start"].cast("string"), e["end"].cast("string")), e["cat"], e["cor"], F.lit("REQUIRED"), F.lit("-NONE-"), F.lit("0")))


def block(source: Column, edits: Column) -> Column:
    """The block of a source and its edits; one without edits says so."""
    lines = F.when(F.size(edits) > 0, F.transform(edits, edit_line)).otherwise(F.array(F.lit(NOOP)))
    return F.concat(F.lit("S "), source, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))


def write(annotated: DataFrame, path: str) -> None:
    annotated.select(block(F.col("orig"), F.col("edits"))).write.mode("overwrite").text(path)


def with_types(annotated: DataFrame, *types: str) -> DataFrame:
    """Sentences that have an edit of one of the types, with all their edits."""
    return annotated.filter(F.exists("edits", lambda e: e["cat"].isin(*types)))


def parse(blocks: DataFrame) -> DataFrame:
    """``source`` and ``edits`` (start, end, type, corrections, annotator, original) of each ``block``.

    Several source lines of a block are one source; offsets count over all.  Corrections are alternatives
    between double bars, ``-NONE-`` is an empty one.  An annotator without edits has one of type ``noop``.
    """
    lines = F.split("block", "\n")
    source = F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("S ")), lambda x: F.substring(x, 3, 1 << 30)), " ")
    words = tokens(F.col("source"))

    def edit(line: Column) -> Column:
        g = lambda i: F.regexp_extract(line, _EDIT, i)
        start, end = g(1).cast("int"), g(2).cast("int")
        alternatives = F.transform(F.split(g(4), r"\|\|"), lambda c: F.when(c == "-NONE-", "").otherwise(c))
        original = F.when((start >= 0) & (end > start), F.array_join(F.slice(words, start + 1, end - start), " ")).otherwise("")
        return F.struct(start.alias("start"), end.alias("end"), g(3).alias("cat"), alternatives.alias("corrections"), g(5).alias("required"), g(6).alias("comment"), g(7).cast("int").alias("annotator"), original.alias("original"))

    rows = blocks.withColumn("lines", lines).withColumn("source", source)
    return rows.withColumn("edits", F.transform(F.filter("lines", lambda x: x.rlike(_EDIT)), edit)).drop("lines", "block")


def read(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", r"^\n+|\n+$", "").alias("block"))
    return parse(blocks.filter("block <> ''"))


def gold(parsed: DataFrame) -> DataFrame:
    """The edits of each annotator (``annotator``, ``annotator_no`` in order of appearance, ``gold``).

    Edits that say nothing is wrong are dropped, their annotator stays; a block without edits has one.
    """
    e = F.col("edits")
    who = F.when(F.size(e) > 0, F.array_distinct(F.transform(e, lambda x: x["annotator"]))).otherwise(F.array(F.lit(0)))
    rows = parsed.select("*", F.posexplode(who).alias("annotator_no", "annotator"))
    words = F.size(tokens(F.col("source")))
    own = F.filter(e, lambda x: (x["annotator"] == F.col("annotator")) & (x["start"] >= 0) & (x["end"] <= words))
    return rows.withColumn("gold", F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["original"].alias("original"), x["corrections"].alias("corrections")))).drop("edits")


def reorder(probe: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks in the order of ``probe`` (``pos``, ``source``), sorted over all; of blocks with one source the last counts.

    ``found`` is false where no block has the source.  ``blocks`` has ``pos``, ``source`` and ``block``.
    """
    last = blocks.groupBy(F.trim("source").alias("source")).agg(F.max_by("block", "pos").alias("block"))
    return probe.withColumn("source", F.trim("source")).join(last, "source", "left").select("pos", "source", "block", F.col("block").isNotNull().alias("found")).orderBy("pos")


def token_offset(source: Column, offset: Column) -> Column:
    """The token at a character offset: how many tokens end before it."""
    return F.size(tokens(F.substring(source, F.lit(1), offset)))

"""Reading and writing sentence pairs, parallel files and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskiln.functions.text import strip, tokens


def two_fields(lines: DataFrame, keep_empty: bool = True) -> DataFrame:
    """``orig`` and ``cor`` of tab-separated ``value`` lines with exactly two fields, empty ones kept or not."""
    fields = F.split("value", "\t", -1)
    pairs = lines.filter(F.size(fields) == 2).select("*", fields[0].alias("orig"), fields[1].alias("cor")).drop("value")
    return pairs if keep_empty else pairs.filter("orig <> '' and cor <> ''")


def read_pairs(spark: SparkSession, path: str, keep_empty: bool = True) -> DataFrame:
    """Pairs of a text file (gz too) of tab-separated lines; quotes are text."""
    return two_fields(spark.read.text(path), keep_empty)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``pos`` (from 0) and ``value`` of the lines of each file, which may be split over tasks.

    Lines are numbered within the stretch of a file that one task reads, after the lines of the stretches
    before, so that no task holds a whole file.
    """
    block = ["file", "_start"]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    within = lines.withColumn("_within", F.row_number().over(Window.partitionBy(*block).orderBy("_id")) - 1)
    before = lines.groupBy(*block).agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(before.drop("_n"), block).select("file", (F.col("_before") + F.col("_within")).alias("pos"), "value")


def zip_lines(orig: DataFrame, cor: DataFrame) -> DataFrame:
    """Lines of two files by place, up to the end of the shorter; those empty on both sides are skipped."""
    left, right = orig.select("pos", F.col("value").alias("orig")), cor.select("pos", F.col("value").alias("cor"))
    return left.join(right, "pos").filter("not (orig = '' and cor = '')")


def zip_three(hyp: DataFrame, src: DataFrame, ref: DataFrame) -> DataFrame:
    """Lines of three files by place; rows that one of them lacks fail, as the files must be of equal length."""
    sides = [d.select("pos", F.col("value").alias(n)) for d, n in ((hyp, "hyp"), (src, "src"), (ref, "ref"))]
    joined = sides[0].join(sides[1], "pos", "full").join(sides[2], "pos", "full")
    whole = F.when(F.col("hyp").isNull() | F.col("src").isNull() | F.col("ref").isNull(), F.raise_error(F.lit("files of different length"))).otherwise(F.col("hyp"))
    return joined.select("pos", whole.alias("hyp"), "src", "ref")


def write_pairs(pairs: DataFrame, path: str, compression: str = "none") -> None:
    pairs.select(F.concat_ws("\t", "orig", "cor")).write.mode("overwrite").text(path, compression=compression)


def write_with_header(pairs: DataFrame, path: str) -> None:
    """Pairs that differ, as ``src`` and ``tgt`` with a header."""
    pairs.filter("orig <> cor").select(F.col("orig").alias("src"), F.col("cor").alias("tgt")).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def split_sides(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return pairs.select(strip(F.col("orig")).alias("value")), pairs.select(strip(F.col("cor")).alias("value"))


def write_sides(pairs: DataFrame, path: str) -> None:
    for side, name in zip(split_sides(pairs), ("original", "corrected")):
        side.write.mode("overwrite").text(f"{path}_{name}")


def four_sides(proofread: DataFrame) -> DataFrame:
    """What the four files of a proof-read corpus hold, as ``side`` and ``value``: originals, corrections,
    both with a tab between, and M2 blocks."""
    from corpuskiln.sources.m2 import block

    sides = {"orig": F.col("original"), "cor": F.col("corrected"), "pair": F.concat_ws("\t", "original", "corrected"), "m2": block(F.col("original"), F.col("edits"))}
    return proofread.select(F.explode(F.array(*(F.struct(F.lit(k).alias("side"), v.alias("value")) for k, v in sides.items()))).alias("x")).select("x.*")


def write_four(proofread: DataFrame, path: str) -> None:
    """The four files of a proof-read corpus, a folder for each side, in one pass."""
    four_sides(proofread).write.mode("overwrite").partitionBy("side").text(path)


def append_score(score: DataFrame, path: str) -> None:
    """Add rows (``epoch``, ``mode``, ``gleu``) to the table of results."""
    score.select("epoch", "mode", "gleu").write.mode("append").parquet(path)


def label_totals(counts: DataFrame) -> DataFrame:
    """Rows and the sum of a table of ``label`` and ``n``."""
    return counts.agg(F.count("*").alias("n_labels"), F.sum("n").alias("total"))


def write_generations(outputs: DataFrame, path: str) -> None:
    """hyp, ref and src lines of each epoch and mode, one folder each."""
    for c in ("hyp", "ref", "src"):
        outputs.select("epoch", "mode", F.replace(c, F.lit("\n"), F.lit("")).alias("value")).write.mode("overwrite").partitionBy("epoch", "mode").text(f"{path}/{c}")


def read_label_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="label string, n long")


def paragraphs(text: DataFrame) -> DataFrame:
    """Blocks of each ``value`` between blank lines; empty ones are dropped."""
    return text.select("*", F.explode(F.split("value", "\n[ \t]*\n+")).alias("block")).withColumn("block", F.regexp_replace("block", r"^\n+|\n+$", "")).filter("block <> ''")


def keep_order(rows: DataFrame, *by: str) -> DataFrame:
    """The first of equal rows, by ``pos``."""
    return rows.groupBy(*by).agg(F.min("pos").alias("pos")).orderBy("pos")


def suggestions_report(suggestions: DataFrame) -> DataFrame:
    """One line for each token: the token in 15 places, and its suggestions."""
    return suggestions.select(F.concat(F.rpad("token", 15, " "), F.lit(" "), F.array_join("suggestions", ", ")).alias("value"))


def spacing_report(pairs: DataFrame) -> DataFrame:
    """Originals whose words between spaces are not as many as their tokens."""
    n_words = F.length("orig") - F.length(F.replace("orig", F.lit(" "), F.lit(""))) + 1
    return pairs.select("pair_id", "orig", n_words.alias("n_words"), F.size(tokens(F.col("orig"))).alias("n_groups")).filter("n_words <> n_groups")

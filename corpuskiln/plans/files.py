"""Sinks and sources against each other: whole tables written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions.text import strip
from corpuskiln.operators import annotate as A
from corpuskiln.plans.corpus import sql_strip
from corpuskiln.plans.general import _P2
from corpuskiln.sources import learner_xml as XML
from corpuskiln.sources import m2 as M2
from corpuskiln.sources import pairs as P
from corpuskiln.util import ensure_checkpoint_dir, partitions, table


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs in which no text has a tab or a line end, as files of lines need them."""
    line = lambda c: F.regexp_replace(c, "[\t\n\r]", " ").alias(c)
    return table(s, d, "kor_lang8").filter("src is not null and tgt is not null").select("pair_id", line("src"), line("tgt")).withColumnsRenamed({"src": "orig", "tgt": "cor"})


_LINE = lambda c: f"regexp_replace({c}, '[\\t\\n\\r]', ' ', 'g')"
_PAIRS = f"SELECT pair_id, {_LINE('src')} AS orig, {_LINE('tgt')} AS cor FROM kor_lang8 WHERE src IS NOT NULL AND tgt IS NOT NULL"


def _written_pairs(s, d) -> DataFrame:
    path = _folder(s)
    P.write_pairs(_pairs(s, d), path, compression="gzip")
    return P.read_pairs(s, path)


def _header(s, d) -> DataFrame:
    path = _folder(s)
    P.write_with_header(_pairs(s, d), path)
    return s.read.csv(path, sep="\t", header=True, quote="", schema="src string, tgt string")


def _sides(s, d) -> DataFrame:
    """Both sides as files of one part, numbered and zipped again."""
    path = _folder(s)
    rows = _pairs(s, d).filter((strip(F.col("orig")) != "") & (strip(F.col("cor")) != "")).repartitionByRange(1, "pair_id").sortWithinPartitions("pair_id")  # a text file has one order
    P.write_sides(rows, path)
    return P.zip_lines(*(P.numbered_lines(s, f"{path}_{side}").select("pos", "value") for side in ("original", "corrected"))).select("pos", "orig", "cor")


def _generations(s, d) -> DataFrame:
    path = _folder(s)
    rows = table(s, d, "kor_lang8").filter("src is not null and tgt is not null and split is not null").select(F.lit(1).alias("epoch"), F.col("split").alias("mode"), F.col("src").alias("hyp"), F.col("tgt").alias("ref"), F.col("src"))
    P.write_generations(rows, path)
    return s.read.text(f"{path}/ref").groupBy("epoch", "mode").agg(F.count("*").alias("n_lines"))


def _results(s, d) -> DataFrame:
    path = _folder(s)
    for epoch in (1, 2):
        score = table(s, d, "kor_lang8").groupBy(F.lit(epoch).alias("epoch"), F.coalesce("split", F.lit("none")).alias("mode")).agg((F.count("*") * 1.0).alias("gleu"))
        P.append_score(score, path)
    return s.read.parquet(path)


def _m2(s, d) -> DataFrame:
    path = _folder(s)
    M2.write(A.annotate(_pairs(s, d).select("pair_id", *(F.trim(F.regexp_replace(c, " +", " ")).alias(c) for c in ("orig", "cor"))).filter("orig <> ''").repartition(partitions(s))), path)
    read = M2.read(s, path)
    return read.select("source", A.applied(F.split("source", " "), F.filter("edits", lambda e: e["start"] >= 0), lambda e: e["corrections"][0]).alias("made"))


def _xml(s, d) -> DataFrame:
    """XML sentences as files in two folders, of which one has 문어 in its name."""
    path = _folder(s)
    rows = table(s, d, "learner_sentences").filter("fmt = 'xml' and body is not null").select("sentence_id", "body").distinct()
    # some sentences to a file, each file a document with one root
    files = rows.groupBy((F.col("sentence_id") % 2).alias("odd"), F.floor(F.col("sentence_id") / 200).alias("part")).agg(F.array_join(F.collect_list("body"), "\n").alias("bodies"))
    for name, odd in (("문어", 0), ("구어", 1)):
        files.filter(F.col("odd") == odd).select(F.concat(F.lit("<SENTENCES>"), "bodies", F.lit("</SENTENCES>"))).write.option("maxRecordsPerFile", 1).text(f"{path}/{name}")
    lines = XML.read(s, path, written_only=True, pattern="*.txt")
    return lines.select(F.size("MorphemeAnnotations.word").alias("n_words")).groupBy("n_words").agg(F.count("*").alias("n"))


def _totals(s, d) -> DataFrame:
    path = _folder(s)
    table(s, d, "lang8_raw").groupBy(F.coalesce("lang_label", F.lit("none")).alias("label")).agg(F.count("*").alias("n")).write.csv(path, sep="\t")
    return P.label_totals(P.read_label_counts(s, path))


QUERIES = {
    "k03_pairs_written": _written_pairs,
    "k04_pairs_with_header": _header,
    "s03_sides_zipped": _sides,
    "k07_generations": _generations,
    "k08_results_appended": _results,
    "s04_m2_file": _m2,
    "s09_xml_files": _xml,
    "s12_label_totals": _totals,
}
ORACLE = {
    "k03_pairs_written": f"SELECT orig, cor FROM ({_PAIRS})",
    "k04_pairs_with_header": f"SELECT nullif(orig, '') AS src, nullif(cor, '') AS tgt FROM ({_PAIRS}) WHERE orig <> cor",
    "s03_sides_zipped": f"SELECT CAST(row_number() OVER (ORDER BY pair_id) - 1 AS BIGINT) AS pos, orig, cor FROM (SELECT pair_id, {sql_strip('orig')} AS orig, {sql_strip('cor')} AS cor FROM ({_PAIRS})) WHERE orig <> '' AND cor <> ''",
    "k07_generations": "SELECT 1 AS epoch, split AS mode, count(*) AS n_lines FROM kor_lang8 WHERE src IS NOT NULL AND tgt IS NOT NULL AND split IS NOT NULL GROUP BY 2",
    "k08_results_appended": "SELECT e AS epoch, coalesce(split, 'none') AS mode, count(*) * 1.0::DOUBLE AS gleu FROM kor_lang8, (VALUES (1), (2)) AS v(e) GROUP BY 1, 2",
    "s04_m2_file": f"SELECT trim(regexp_replace(orig, ' +', ' ', 'g'), ' ') AS source, trim(regexp_replace(cor, ' +', ' ', 'g'), ' ') AS made FROM ({_PAIRS}) WHERE trim(orig, ' ') <> ''",
    "s09_xml_files": f"{_P2} SELECT nullif(CAST(len(w) AS INT), 0) AS n_words, count(*) AS n FROM xs WHERE section = 'M' AND sentence_id % 2 = 0 GROUP BY 1",
    "s12_label_totals": "SELECT count(DISTINCT coalesce(lang_label, 'none')) AS n_labels, count(*) AS total FROM lang8_raw",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

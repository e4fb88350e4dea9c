"""Queries of the corpus operators over whole tables, with the SQL that DuckDB can run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import hangul as H
from corpuskiln.functions import text as X
from corpuskiln.operators import annotate as A
from corpuskiln.operators import clean as C
from corpuskiln.operators import dataset as D
from corpuskiln.operators import gleu as G
from corpuskiln.operators import learner as L
from corpuskiln.operators import maxmatch as M
from corpuskiln.operators import rouge as R
from corpuskiln.operators import shred as S
from corpuskiln.operators.kernels import CLASSES
from corpuskiln.plans.general import _P2, _inside
from corpuskiln.plans.general import ORACLE as GENERAL
from corpuskiln.sources import learner_xml as XML
from corpuskiln.sources import m2 as M2
from corpuskiln.sources import pairs as P
from corpuskiln.util import partitions, table

# ---- inputs -----------------------------------------------------------------------------------------


def raw(s, d) -> DataFrame:
    return table(s, d, "lang8_raw").select("pair_id", F.col("original").alias("o"), F.col("corrected").alias("c"))


def pairs(s, d) -> DataFrame:
    return table(s, d, "kor_lang8").filter("src is not null and tgt is not null").select("pair_id", F.col("src").alias("orig"), F.col("tgt").alias("cor"), "split", "source")


def spread(s, d) -> DataFrame:
    """The pairs over all cores, for kernels that cost far more than moving a row."""
    return pairs(s, d).repartition(partitions(s))


def raw_pairs(s, d) -> DataFrame:
    return table(s, d, "lang8_raw").filter("original is not null and corrected is not null").select(F.col("original").alias("orig"), F.col("corrected").alias("cor"))


def triples(s, d) -> DataFrame:
    """Source, reference and a made-up system output: the source with one particle put for another."""
    return pairs(s, d).repartition(partitions(s)).select(F.col("pair_id").alias("sid"), F.col("orig").alias("src"), F.col("cor").alias("ref"), F.replace("orig", F.lit("을"), F.lit("를")).alias("hyp"), "source")


_RAW = "SELECT pair_id, original AS o, corrected AS c FROM lang8_raw"
_PAIRS = "SELECT pair_id, src AS orig, tgt AS cor, split, source FROM kor_lang8 WHERE src IS NOT NULL AND tgt IS NOT NULL"
_TRIPLES = f"SELECT pair_id AS sid, orig AS src, cor AS ref, replace(orig, '을', '를') AS hyp, source FROM ({_PAIRS})"


def q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {q(X.WHITE + '+')}), lambda t: t <> '')"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^{X.WHITE}+|{X.WHITE}+$')}, '', 'g')"


def sql_sub(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def sql_pad(c: str, pattern: str) -> str:
    return sql_sub(sql_sub(c, pattern, r" \1 "), " +", " ")


def sql_grid(rows: str, key: str, swap: str, common: bool = False) -> str:
    """WITH clauses that end in ``dp`` (key, a, b, v): the distance of the lists a and b of ``rows``, or the
    length of their longest common subsequence.  One recursion step is one diagonal of the grid."""
    first, edge = ("0.0", "0.0") if common else ("0.0", "CAST(d + 1 AS DOUBLE)")
    inner = "CASE WHEN a[i] = b[d + 1 - i] THEN p2[i] + 1 ELSE greatest(p1[i], p1[i + 1]) END" if common else f"least(p1[i] + 1, p1[i + 1] + 1, p2[i] + {swap})"
    return f"""grid({key}, a, b, d, p2, p1) AS (
  SELECT {key}, a, b, 0, list_transform(range(0, len(a) + 1), lambda i: NULL::DOUBLE), list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 THEN {first}::DOUBLE END) FROM ({rows})
  UNION ALL SELECT {key}, a, b, d + 1, p1, list_transform(range(0, len(a) + 1), lambda i: CASE WHEN d + 1 - i < 0 OR d + 1 - i > len(b) THEN NULL WHEN i = 0 OR i = d + 1 THEN {edge} ELSE {inner} END) FROM grid WHERE d < len(a) + len(b)),
dp AS (SELECT {key}, a, b, p1[len(a) + 1] AS v FROM grid WHERE d = len(a) + len(b))"""


UNIT = "CASE WHEN a[i] = b[d + 1 - i] THEN 0 ELSE 1 END"


def sql_letters(x: str, y: str) -> str:
    """Cost of putting one character for another: letters that differ, if both are syllables or letters."""
    u, v = f"(unicode({x}) - 44032)", f"(unicode({y}) - 44032)"
    both = f"{u} BETWEEN 0 AND 11171 AND {v} BETWEEN 0 AND 11171"

    def three(c: str) -> list[str]:
        n, cp = f"(unicode({c}) - 44032)", f"unicode({c})"
        syllable = f"{n} BETWEEN 0 AND 11171"
        return [f"CASE WHEN {syllable} THEN {q(H.INITIALS)}[{n} // 588 + 1] WHEN {cp} BETWEEN 12593 AND 12622 THEN {c} ELSE ' ' END", f"CASE WHEN {syllable} THEN {q(H.MEDIALS)}[{n} // 28 % 21 + 1] WHEN {cp} BETWEEN 12623 AND 12643 THEN {c} ELSE ' ' END", f"CASE WHEN {syllable} THEN {q(H.FINALS)}[{n} % 28 + 1] ELSE ' ' END"]

    korean = lambda c: f"({c} BETWEEN '가' AND '힣' OR {c} BETWEEN 'ㄱ' AND 'ㅣ')"
    single = " + ".join(f"CASE WHEN {i} <> {j} THEN 1 ELSE 0 END" for i, j in zip(three(x), three(y)))
    return f"CASE WHEN {x} = {y} THEN 0 WHEN {both} THEN (CASE WHEN {u} // 588 <> {v} // 588 THEN 1 ELSE 0 END + CASE WHEN {u} // 28 % 21 <> {v} // 28 % 21 THEN 1 ELSE 0 END + CASE WHEN {u} % 28 <> {v} % 28 THEN 1 ELSE 0 END) WHEN {korean(x)} AND {korean(y)} THEN {single} ELSE 1 END"


def sql_repeats(c: str) -> str:
    """Without carets, doubled marks and bracketed parts; runs stand for what a look-ahead would find."""
    twice = "t[i] = ' ' AND t[i + 1] <> ' ' AND NOT regexp_matches(t[i + 1], '[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') AND t[i + 2] = ' ' AND t[i + 3] = t[i + 1]"
    marked = "list_transform(range(1, len(t) + 1), lambda i: " + twice.replace("{{", "{").replace("}}", "}") + ")"
    kept = f"list_transform([string_split(replace({c}, '^', ''), '')], lambda t: list_transform([{marked}], lambda m: array_to_string(list_filter(t, lambda x, i: NOT coalesce(m[i], false) AND NOT coalesce(m[i - 1], false)), ''))[1])[1]"
    for pattern, to in ((r"(?: !)+", " !"), (r" +", " "), (r"ㅜ+", "ㅜ"), (r"ㅠ+", "ㅠ"), (r"(?: ;)+", " ;"), (r"(?: >)+", " >"), (r"ㄱ+", "ㄱ"), (r"~+", "~"), (r"\([^)]*\)", ""), (r"(\d+ )\)", ""), (r"<.*?>", ""), (r"\[.*?\]", ""), (r" +", " ")):
        kept = sql_sub(kept, pattern, to)
    return sql_strip(kept)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


# ---- projections: one function on both sides of every raw pair ---------------------------------------

_FUNCTIONS = {
    "f01_strip_foreign": (X.strip_foreign, lambda c: sql_sub(sql_sub(c, X.FOREIGN), X.LATIN)),
    "f02_strip": (X.strip, sql_strip),
    "f04_allowed_charset": (X.allowed, lambda c: f"NOT regexp_matches({c}, {q(X.ALLOWED)})"),
    "f05_has_hangul": (X.has_hangul, lambda c: f"regexp_matches({c}, {q(X.HANGUL)})"),
    "f08_token_count": (lambda c: F.size(X.tokens(c)), lambda c: f"len({sql_tokens(c)})"),
    "f10_longest_token": (X.longest_token, lambda c: f"list_max(list_transform(string_split({c}, ' '), lambda t: length(t)))"),
    "f11_pad_punctuation": (X.pad_punctuation, lambda c: sql_pad(c, X.PUNCTUATION)),
    "f13_drop_repeats": (X.drop_repeats, sql_repeats),
    "f17_split_punctuation": (X.split_punctuation, lambda c: sql_strip(sql_pad(c, X.SPLIT_PUNCTUATION))),
    "f18_strip_punctuation": (X.strip_punctuation, lambda c: sql_sub(sql_sub(c, X.STRIP_PUNCTUATION), " +", " ")),
    "f23_drop_newlines": (lambda c: F.replace(c, F.lit("\n"), F.lit("")), lambda c: f"replace({c}, chr(10), '')"),
    "f24_rouge_text": (X.rouge_text, lambda c: sql_sub(f"lower({c})", X.ROUGE_DROP, " ")),
    "h16_letters": (H.to_letters, lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN unicode(x) BETWEEN 44032 AND 55203 THEN {q(H.INITIALS)}[(unicode(x) - 44032) // 588 + 1] || {q(H.MEDIALS)}[(unicode(x) - 44032) // 28 % 21 + 1] || trim({q(H.FINALS)}[(unicode(x) - 44032) % 28 + 1]) ELSE x END), '')"),
    "h18_treebank_tokens": (lambda c: F.array_join(X.tokenizer()(c), " "), None),
    "h21_windows_repair": (X.repair_windows, lambda c: f"translate({c}, {' || '.join(f'chr({i})' for i in X._WINDOWS)}, {q(''.join(X._WINDOWS.values()))})"),
    "h22_ascii_only": (X.ascii_only, lambda c: sql_sub(c, "[^ -~]")),
    "h22_is_ascii": (X.is_ascii, lambda c: f"NOT regexp_matches({c}, {q(chr(91) + '^' + chr(92) + 'x00-' + chr(92) + 'x7f' + chr(93))})"),
    "h25_limit_characters": (lambda c: X.limit_characters(c, 20), lambda c: f"{c}[1:20]"),
}
for _name, (_f, _sql) in _FUNCTIONS.items():
    add(_name, lambda s, d, f=_f: raw(s, d).select("pair_id", f(F.col("o")).alias("o"), f(F.col("c")).alias("c")), f"SELECT pair_id, {_sql('o')} AS o, {_sql('c')} AS c FROM ({_RAW})" if _sql else None)

# ---- filters: the pairs that stay --------------------------------------------------------------------

_both = lambda f: lambda o, c: f(o) & f(c)
_FILTERS = {
    "f03_min_length": (lambda o, c: (F.length(o) > 2) & (F.length(c) > 2), "length(o) > 2 AND length(c) > 2"),
    "f06_token_ratio": (C.token_ratio, f"len({sql_tokens('c')}) / nullif(len({sql_tokens('o')}), 0) > 0.25 AND len({sql_tokens('c')}) / nullif(len({sql_tokens('o')}), 0) < 4"),
    "f07_char_ratio": (C.char_ratio, "length(c) / nullif(length(o), 0) > 0.5 AND length(c) / nullif(length(o), 0) < 1.25"),
    "f09_blocklist": (lambda o, c: ~c.contains("or") & ~c.contains("good"), "NOT contains(c, 'or') AND NOT contains(c, 'good')"),
    "f12_no_slash": (lambda o, c: ~o.contains("/") & ~c.contains("/"), "NOT contains(o, '/') AND NOT contains(c, '/')"),
    "f14_different": (lambda o, c: o != c, "o <> c"),
    "f15_final": (lambda o, c: ~o.contains("\t") & ~c.contains("\t") & (F.length(o) >= 2) & (F.length(c) >= 2), "NOT contains(o, chr(9)) AND NOT contains(c, chr(9)) AND length(o) >= 2 AND length(c) >= 2"),
    "f19_not_empty": (lambda o, c: (o != "") & (c != ""), "o <> '' AND c <> ''"),
    "f22_same_but_space_and_case": (X.ignoring_space_and_case, "lower(replace(o, ' ', '')) = lower(replace(c, ' ', ''))"),
}
for _name, (_f, _sql) in _FILTERS.items():
    add(_name, lambda s, d, f=_f: raw(s, d).filter(f(F.col("o"), F.col("c"))).select("pair_id"), f"SELECT pair_id FROM ({_RAW}) WHERE {_sql}")
_CHARS = f"SELECT pair_id, string_split(orig, '') AS a, string_split(cor, '') AS b FROM ({_PAIRS})"
_LETTER_GRID = f"WITH RECURSIVE {sql_grid(_CHARS, 'pair_id', sql_letters('a[i]', 'b[d + 1 - i]'))}"
add("f16_letter_distance", lambda s, d: pairs(s, d).select("pair_id", H.letter_distance("orig", "cor").alias("distance")), f"{_LETTER_GRID} SELECT pair_id, v AS distance FROM dp")

# ---- sources and the funnel ------------------------------------------------------------------------------

_joined_raw = lambda s, d: raw(s, d).select("pair_id", F.concat(F.coalesce("o", F.lit("")), F.lit("\t"), F.coalesce("c", F.lit(""))).alias("value"))
add("s01_pair_lines", lambda s, d: P.two_fields(_joined_raw(s, d)), f"SELECT pair_id, f[1] AS orig, f[2] AS cor FROM (SELECT pair_id, string_split(coalesce(o, '') || chr(9) || coalesce(c, ''), chr(9)) AS f FROM ({_RAW})) WHERE len(f) = 2")
add("s02_pair_lines_not_empty", lambda s, d: P.two_fields(pairs(s, d).select("pair_id", F.concat_ws("\t", "orig", "cor").alias("value")), keep_empty=False), f"SELECT pair_id, orig, cor FROM ({_PAIRS}) WHERE orig <> '' AND cor <> '' AND NOT contains(orig, chr(9)) AND NOT contains(cor, chr(9))")
add("s05_paragraphs", lambda s, d: P.paragraphs(table(s, d, "documents").select("doc_id", F.col("text").alias("value"))).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("block")).alias("n_chars")),
    "SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(b)) AS BIGINT) AS n_chars FROM (SELECT doc_id, regexp_replace(unnest(string_split_regex(text, '\\n[ \\t]*\\n+')), '^\\n+|\\n+$', '', 'g') AS b FROM documents) WHERE b <> '' GROUP BY doc_id")
add("s07_xml_sentences", lambda s, d: XML.from_text(table(s, d, "learner_sentences").filter("fmt = 'xml'")).select("sentence_id", F.col("sentence.s").alias("s"), F.size("sentence.MorphemeAnnotations.word").alias("n_words")).distinct(),
    f"{_P2} SELECT DISTINCT sentence_id, nullif(trim({_inside('x.t', 's')}, ' ' || chr(10)), '') AS s, nullif(len(w), 0) AS n_words FROM x JOIN xs USING (sentence_id, body) WHERE section = 'M'")
add("s08_xml_with_errors", lambda s, d: XML.with_errors(XML.from_text(table(s, d, "learner_sentences").filter("fmt = 'xml'")).select("sentence_id", "sentence.*")).select("sentence_id", F.size("LearnerErrorAnnotations.word").alias("n_errors")).distinct(),
    f"{_P2} SELECT DISTINCT sentence_id, len(w) AS n_errors FROM xs WHERE section = 'E' AND len(w) > 0")
_xml = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _essays(s, d) -> DataFrame:
    """Whole documents as SGML, a paragraph for each line and a mistake at the first word of the text."""
    lines = F.transform(F.split("text", "\n"), lambda p: F.concat(F.lit("<P>"), _xml(p), F.lit("</P>")))
    mistake = F.concat(F.lit('<MISTAKE start_par="0" start_off="0" end_par="0" end_off="'), F.length(F.split("text", " ")[0]).cast("string"), F.lit('"><TYPE>Sp</TYPE><CORRECTION>'), _xml(F.coalesce("title", F.lit(""))), F.lit("</CORRECTION></MISTAKE>"))
    return table(s, d, "documents").filter("text is not null").select(F.concat(F.lit('<DOC nid="'), F.col("doc_id").cast("string"), F.lit('"><TEXT>'), F.array_join(lines, ""), F.lit("</TEXT><ANNOTATION>"), mistake, F.lit("</ANNOTATION></DOC>")).alias("doc"))


def _plain_sql(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


add("s11_sgml", lambda s, d: XML.parse_sgml(_essays(s, d)).select(F.col("nid").cast("long").alias("doc_id"), F.size("paragraphs").alias("n_paragraphs"), F.aggregate("paragraphs", F.lit(0), lambda n, p: n + F.length(p)).alias("chars"), F.col("mistakes")[0]["end_off"].alias("end_off"), F.col("mistakes")[0]["type"].alias("type"), F.col("mistakes")[0]["correction"].alias("correction")), f"""
SELECT doc_id, len(p) AS n_paragraphs, CAST(list_sum(list_transform(p, lambda x: length(regexp_replace({_plain_sql('x')}, '^\\s+|\\s+$', '', 'g')))) AS INT) AS chars, CAST(length(string_split(text, ' ')[1]) AS INT) AS end_off, 'Sp' AS type, trim({_plain_sql("coalesce(title, '')")}, ' ') AS correction
FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)""")
add("j01_zip_lines", lambda s, d: P.zip_lines(table(s, d, "kor_lang8").select(F.col("pair_id").alias("pos"), F.col("src").alias("value")).filter("value is not null"), table(s, d, "kor_lang8").select(F.col("pair_id").alias("pos"), F.col("tgt").alias("value")).filter("value is not null")),
    f"SELECT pair_id AS pos, orig, cor FROM ({_PAIRS}) WHERE NOT (orig = '' AND cor = '')")
add("j02_zip_three", lambda s, d: P.zip_three(*(triples(s, d).select(F.col("sid").alias("pos"), F.col(c).alias("value")) for c in ("hyp", "src", "ref"))), f"SELECT sid AS pos, hyp, src, ref FROM ({_TRIPLES})")
add("a18_first_of_equals", lambda s, d: P.keep_order(pairs(s, d).withColumnRenamed("pair_id", "pos"), "orig"), f"SELECT orig, min(pair_id) AS pos FROM ({_PAIRS}) GROUP BY orig")
add("clean_pairs", lambda s, d: C.clean(raw_pairs(s, d), "far_apart"))
add("clean_funnel", lambda s, d: C.funnel(raw_pairs(s, d)))
add("clean_far_apart", lambda s, d: C.far_apart(pairs(s, d).select("pair_id", "orig", "cor")).select("pair_id"))

_STRIPPED = {c: sql_strip(sql_sub(sql_sub(c, X.FOREIGN), X.LATIN)) for c in ("orig", "cor")}
_STEP3 = f"""
WITH a AS (SELECT {_STRIPPED['orig']} AS orig, {_STRIPPED['cor']} AS cor FROM (SELECT original AS orig, corrected AS cor FROM lang8_raw WHERE original IS NOT NULL AND corrected IS NOT NULL)),
b AS (SELECT * FROM a WHERE length(orig) > 2 AND length(cor) > 2),
c AS (SELECT * FROM b WHERE NOT regexp_matches(orig, {q(X.ALLOWED)}) AND NOT regexp_matches(cor, {q(X.ALLOWED)}) AND regexp_matches(orig, {q(X.HANGUL)}) AND regexp_matches(cor, {q(X.HANGUL)})),
e AS (SELECT *, len({sql_tokens('orig')}) AS n, len({sql_tokens('cor')}) AS m FROM c),
g AS (SELECT orig, cor FROM e WHERE m / n > 0.25 AND m / n < 4 AND length(cor) / length(orig) > 0.5 AND length(cor) / length(orig) < 1.25 AND least(n, m) > 5 AND NOT contains(cor, 'or') AND NOT contains(cor, 'good')
  AND list_max(list_transform(string_split(orig, ' '), lambda t: length(t))) <= 20 AND list_max(list_transform(string_split(cor, ' '), lambda t: length(t))) <= 20),
h AS (SELECT {sql_pad('orig', X.PUNCTUATION)} AS orig, {sql_pad('cor', X.PUNCTUATION)} AS cor FROM g)
"""
add("clean_until_distinct", lambda s, d: C.clean(raw_pairs(s, d), "distinct"), _STEP3 + "SELECT DISTINCT orig, cor FROM h WHERE NOT contains(orig, '/') AND NOT contains(cor, '/')")
_FINAL = f"""{_STEP3.replace("WITH a AS", "WITH RECURSIVE a AS")}, i AS (SELECT DISTINCT orig, cor FROM h WHERE NOT contains(orig, '/') AND NOT contains(cor, '/')),
k AS (SELECT {sql_repeats('orig')} AS orig, {sql_repeats('cor')} AS cor FROM i),
l AS (SELECT orig, cor, string_split(orig, '.') AS o, string_split(cor, '.') AS c FROM k),
m AS (SELECT o[i] || ' .' AS orig, c[i] || ' .' AS cor FROM (SELECT o, c, unnest(range(1, len(o))) AS i FROM l WHERE len(o) > 2 AND len(o) = len(c)) WHERE o[i] <> c[i] AND least(length(o[i]), length(c[i])) > 4 UNION ALL SELECT orig, cor FROM l WHERE len(o) <= 2),
n AS (SELECT row_number() OVER () AS pair_id, orig, cor FROM m WHERE orig <> cor),
f AS (SELECT * FROM n WHERE NOT contains(orig, chr(9)) AND NOT contains(cor, chr(9)) AND length(orig) >= 2 AND length(cor) >= 2),
{sql_grid("SELECT pair_id, string_split(orig, '') AS a, string_split(cor, '') AS b FROM f", "pair_id", sql_letters("a[i]", "b[d + 1 - i]"))}
"""
ORACLE["clean_pairs"] = f"{_FINAL} SELECT orig, cor FROM f JOIN dp USING (pair_id) WHERE v > 10"
ORACLE["clean_funnel"] = f"{_FINAL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS step_no, '{name}' AS step, (SELECT count(*) FROM {rel}) AS n_pairs" for i, (name, rel) in enumerate((
    ("loaded", "lang8_raw WHERE original IS NOT NULL AND corrected IS NOT NULL"), ("foreign", "a"), ("short", "b"), ("charset", "c"), ("ratios", "g"), ("punctuation", "h WHERE NOT contains(orig, '/') AND NOT contains(cor, '/')"), ("distinct", "i"), ("repeats", "k"), ("sentences", "m"), ("different", "n"), ("final", "f"), ("far_apart", "dp WHERE v > 10")))) + ")"
ORACLE["clean_far_apart"] = f"{_LETTER_GRID} SELECT pair_id FROM dp WHERE v > 10"
add("e01_split_sentences", lambda s, d: C.split_sentences(pairs(s, d).select("pair_id", "orig", "cor")), f"""
WITH a AS (SELECT pair_id, orig, cor, string_split(orig, '.') AS o, string_split(cor, '.') AS c FROM ({_PAIRS})),
b AS (SELECT pair_id, o, c, unnest(range(1, len(o))) AS i FROM a WHERE len(o) > 2 AND len(o) = len(c))
SELECT pair_id, o[i] || ' .' AS orig, c[i] || ' .' AS cor FROM b WHERE o[i] <> c[i] AND least(length(o[i]), length(c[i])) > 4
UNION ALL SELECT pair_id, orig, cor FROM a WHERE len(o) <= 2""")

# ---- counts and n-grams ------------------------------------------------------------------------------

add("a01_multiplicity", lambda s, d: C.multiplicity(raw_pairs(s, d)), "SELECT original AS orig, corrected AS cor, count(*) AS n FROM lang8_raw WHERE original IS NOT NULL AND corrected IS NOT NULL GROUP BY 1, 2")
add("a02_distinct_pairs", lambda s, d: C.distinct_pairs(raw_pairs(s, d)), "SELECT DISTINCT original AS orig, corrected AS cor FROM lang8_raw WHERE original IS NOT NULL AND corrected IS NOT NULL")
add("a03_label_histogram", lambda s, d: A.histogram(A.annotate(spread(s, d))))
add("a03_source_rollup", lambda s, d: pairs(s, d).rollup("split", "source").agg(F.count("*").alias("n")), f"SELECT split, source, count(*) AS n FROM ({_PAIRS}) GROUP BY ROLLUP (split, source)")
add("a04_edit_counts", lambda s, d: A.annotate(spread(s, d)).agg(F.count("*").alias("n_lines"), F.sum(F.size("edits")).alias("n_edits"), F.count_if(F.size("edits") == 0).alias("n_unchanged")))


def _grams(c: str, table_: str, keys: str) -> str:
    words = f"SELECT {keys}, unnest([1, 2, 3, 4]) AS n, {sql_tokens(c)} AS t FROM ({table_})"
    return f"SELECT {keys}, n, array_to_string(t[i:i+n-1], ' ') AS gram FROM (SELECT {keys}, n, t, unnest(range(1, len(t) - n + 2)) AS i FROM ({words}))"


add("e03_ngram_counts", lambda s, d: G.gram_counts(pairs(s, d).select("pair_id", X.tokens(F.col("orig")).alias("w")), "pair_id", column="w"), f"SELECT pair_id, n, gram, count(*) AS cnt FROM ({_grams('orig', _PAIRS, 'pair_id')}) GROUP BY 1, 2, 3")
add("e04_word_pairs", lambda s, d: pairs(s, d).select("pair_id", F.explode(X.word_pairs(X.tokens(F.col("orig")), overlapping=True)).alias("w")).select("pair_id", F.array_join("w", " ").alias("pair")), f"SELECT pair_id, gram AS pair FROM ({_grams('orig', _PAIRS, 'pair_id')}) WHERE n = 2")
add("a09_document_frequency", lambda s, d: G.document_frequency(pairs(s, d).select(F.col("pair_id").alias("sid"), X.tokens(F.col("cor")).alias("words"))), f"SELECT n, gram, count(DISTINCT pair_id) AS df FROM ({_grams('cor', _PAIRS, 'pair_id')}) GROUP BY 1, 2")
add("a10_normalised_frequency", lambda s, d: G.document_frequency(pairs(s, d).select(F.col("pair_id").alias("sid"), X.tokens(F.col("cor")).alias("words"))).select("n", "gram", (F.col("df") / 2).alias("f")), f"SELECT n, gram, count(DISTINCT pair_id) / 2 AS f FROM ({_grams('cor', _PAIRS, 'pair_id')}) GROUP BY 1, 2")
_refs = lambda s, d: pairs(s, d).select(F.col("pair_id").alias("sid"), F.posexplode(F.array("orig", "cor")).alias("ref_no", "t")).select("sid", "ref_no", X.tokens(F.col("t")).alias("words"))
_counted = f"(SELECT pair_id, n, gram, count(*) AS cnt FROM ({_grams('orig', _PAIRS, 'pair_id')}) GROUP BY ALL UNION ALL SELECT pair_id, n, gram, count(*) AS cnt FROM ({_grams('cor', _PAIRS, 'pair_id')}) GROUP BY ALL)"
add("a11_merged_references", lambda s, d: G.merged_references(_refs(s, d)), f"SELECT pair_id AS sid, n, gram, max(cnt) AS cnt FROM {_counted} GROUP BY 1, 2, 3")


_two = lambda s, d: pairs(s, d).select("pair_id", X.tokens(F.col("orig")).alias("o"), X.tokens(F.col("cor")).alias("c"))
_SIDES = f"o AS (SELECT pair_id, n, gram, count(*) AS cnt FROM ({_grams('orig', _PAIRS, 'pair_id')}) GROUP BY ALL), c AS (SELECT pair_id, n, gram, count(*) AS cnt FROM ({_grams('cor', _PAIRS, 'pair_id')}) GROUP BY ALL)"
add("j05_multiset_intersection", lambda s, d: G.shared_grams(_two(s, d), "pair_id", left="o", right="c"), f"WITH {_SIDES} SELECT pair_id, n, CAST(sum(least(o.cnt, c.cnt)) AS BIGINT) AS common FROM o JOIN c USING (pair_id, n, gram) GROUP BY 1, 2")
add("j06_ngram_anti_join", lambda s, d: G.grams_of_one(_two(s, d), "pair_id", left="o", right="c"), f"WITH {_SIDES} SELECT pair_id, n, CAST(sum(o.cnt) AS BIGINT) AS only_source FROM o ANTI JOIN c USING (pair_id, n, gram) GROUP BY 1, 2")

# ---- GLEU --------------------------------------------------------------------------------------------

_STATS = f"""
WITH t AS (SELECT * FROM ({_TRIPLES})),
g AS (SELECT sid, n, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 'r') AS r FROM (
  SELECT *, 'h' AS side FROM ({_grams('hyp', _TRIPLES, 'sid')}) UNION ALL SELECT *, 's' FROM ({_grams('src', _TRIPLES, 'sid')}) UNION ALL SELECT *, 'r' FROM ({_grams('ref', _TRIPLES, 'sid')})) GROUP BY 1, 2, 3),
x AS (SELECT sid, n, sum(least(h, r) - least(h, CASE WHEN r = 0 THEN s ELSE 0 END)) AS v FROM g GROUP BY 1, 2),
y AS (SELECT sid, source, len({sql_tokens('hyp')}) AS c, len({sql_tokens('ref')}) AS r FROM t),
st AS (SELECT y.sid, any_value(source) AS source, any_value(c) AS c, any_value(r) AS r, {', '.join(f"greatest(coalesce(sum(v) FILTER (n = {n}), 0), 0) AS num{n}, greatest(any_value(c) + 1 - {n}, 0) AS den{n}" for n in (1, 2, 3, 4))} FROM y LEFT JOIN x USING (sid) GROUP BY y.sid)
"""
_GLEU = "CASE WHEN least(c, r, num1, den1, num2, den2, num3, den3, num4, den4) = 0 THEN 0.0 ELSE exp(least(0, 1 - r / c) + (ln(num1 / den1) + ln(num2 / den2) + ln(num3 / den3) + ln(num4 / den4)) / 4) END"
_SMOOTH = "exp(least(0, 1 - one(r) / one(c)) + (ln(one(num1) / one(den1)) + ln(one(num2) / one(den2)) + ln(one(num3) / one(den3)) + ln(one(num4) / one(den4))) / 4)"
for _c in G.names():
    _SMOOTH = _SMOOTH.replace(f"one({_c})", f"(CASE WHEN {_c} = 0 THEN 1 ELSE {_c} END)")
_stats = lambda s, d: G.statistics(triples(s, d))
add("gleu_statistics", _stats, _STATS + f"SELECT sid, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in G.names())} FROM st")
add("gleu_corpus", lambda s, d: G.corpus(_stats(s, d)).select(F.round("gleu", 6).alias("gleu")), _STATS + f"SELECT round({_GLEU}, 6) AS gleu FROM (SELECT {', '.join(f'sum({c}) AS {c}' for c in G.names())} FROM st)")
add("gleu_by_source", lambda s, d: G.corpus(G.statistics(triples(s, d), ("sid", "source")), "source").select("source", F.round("gleu", 6).alias("gleu")), _STATS + f"SELECT source, round({_GLEU}, 6) AS gleu FROM (SELECT source, {', '.join(f'sum({c}) AS {c}' for c in G.names())} FROM st GROUP BY 1)")
add("gleu_sentences", lambda s, d: G.sentences(_stats(s, d)).select("sid", F.round("gleu", 6).alias("gleu")), _STATS + f"SELECT sid, round({_SMOOTH}, 6) AS gleu FROM st")


def _multi_gleu(s, d, iterations: int = G.ITERATIONS) -> DataFrame:
    """Two references for each sentence; the draw of an iteration is a hash of the sentence."""
    rows = triples(s, d).select("sid", "src", "hyp", F.posexplode(F.array("ref", "src")).alias("ref_no", "ref"))
    stats = G.statistics(rows, ("sid", "ref_no"))
    drawn = lambda sid, i: (F.ascii(F.substring(F.md5(F.concat_ws(":", sid, i)), 1, 1)) % 2).cast("int")
    return G.multi_reference(stats, drawn, iterations).select(*(F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")))


_REFS = f"SELECT sid * 2 AS sid, src, ref, hyp, source FROM ({_TRIPLES}) UNION ALL SELECT sid * 2 + 1, src, src, hyp, source FROM ({_TRIPLES})"
add("gleu_multi_reference", _multi_gleu, _STATS.replace(f"({_TRIPLES})", f"({_REFS})") + f"""SELECT round(avg(gleu), 6) AS mean, round(stddev_pop(gleu), 6) AS std, round(avg(gleu) - 1.959963984540054 * stddev_pop(gleu), 6) AS low, round(avg(gleu) + 1.959963984540054 * stddev_pop(gleu), 6) AS high
FROM (SELECT j, {_GLEU} AS gleu FROM (SELECT j, {', '.join(f'sum({c}) AS {c}' for c in G.names())} FROM st, range({G.ITERATIONS}) AS r(j) WHERE sid % 2 = ascii(md5(CAST(sid // 2 AS VARCHAR) || ':' || CAST(j AS VARCHAR))[1]) % 2 GROUP BY 1))""")

# ---- ROUGE -------------------------------------------------------------------------------------------

_hyp_ref = lambda s, d: pairs(s, d).select("pair_id", F.col("orig").alias("hyp"), F.col("cor").alias("ref"))


def _rouge_sql(n: int) -> str:
    side = lambda c: f"SELECT pair_id, array_to_string(t[i:i+{n - 1}], ' ') AS g FROM (SELECT pair_id, t, unnest(range(1, len(t) - {n} + 2)) AS i FROM (SELECT pair_id, {sql_tokens(sql_sub(f'lower({c})', X.ROUGE_DROP, ' '))} AS t FROM ({_PAIRS})))"
    return f"""WITH h AS (SELECT pair_id, g, count(*) AS k FROM ({side('orig')}) GROUP BY ALL), r AS (SELECT pair_id, g, count(*) AS k FROM ({side('cor')}) GROUP BY ALL),
m AS (SELECT pair_id, sum(least(h.k, r.k)) AS m FROM h JOIN r USING (pair_id, g) GROUP BY 1), hn AS (SELECT pair_id, sum(k) AS n FROM h GROUP BY 1), rn AS (SELECT pair_id, sum(k) AS n FROM r GROUP BY 1),
x AS (SELECT p.pair_id, coalesce(m.m, 0) / hn.n AS pp, coalesce(m.m, 0) / rn.n AS rr FROM ({_PAIRS}) p LEFT JOIN m USING (pair_id) LEFT JOIN hn USING (pair_id) LEFT JOIN rn USING (pair_id)),
y AS (SELECT pair_id, coalesce(pp, 0) AS p, coalesce(rr, 0) AS r FROM x)
SELECT pair_id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p = 0 OR r = 0 THEN 0 ELSE p * r / (0.5 * p + 0.5 * r) END, 6) AS f FROM y"""


_rounded = lambda df, *keys: df.select(*keys, *(F.round(c, 6).alias(c) for c in "prf"))
for _n in (1, 2):
    add(f"rouge_{_n}", lambda s, d, n=_n: _rounded(R.rouge_n(_hyp_ref(s, d), n, "pair_id"), "pair_id"), _rouge_sql(_n))
add("rouge_1_average", lambda s, d: _rounded(R.average(R.rouge_n(_hyp_ref(s, d), 1, "pair_id"))), _rouge_sql(1).replace("SELECT pair_id, round(p, 6) AS p", "SELECT round(avg(p), 6) AS p").replace("round(r, 6) AS r, round(CASE", "round(avg(r), 6) AS r, round(avg(CASE").replace("END, 6) AS f", "END), 6) AS f"))
_rouge_words = lambda c: sql_tokens(sql_sub(f"lower({c})", X.ROUGE_DROP, " "))
add("rouge_l", lambda s, d: _rounded(R.rouge_l(_hyp_ref(s, d), "pair_id"), "pair_id"), f"""WITH RECURSIVE {sql_grid(f"SELECT pair_id, {_rouge_words('orig')} AS a, {_rouge_words('cor')} AS b FROM ({_PAIRS})", "pair_id", "", common=True)},
y AS (SELECT pair_id, coalesce(v / nullif(len(a), 0), 0) AS p, coalesce(v / nullif(len(b), 0), 0) AS r FROM dp)
SELECT pair_id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p = 0 OR r = 0 THEN 0 ELSE p * r / (0.5 * p + 0.5 * r) END, 6) AS f FROM y""")
add("rouge_w", lambda s, d: _rounded(R.rouge_l(_hyp_ref(s, d), "pair_id", weight=1.2), "pair_id"))


def _two_refs(s, d) -> DataFrame:
    rows = triples(s, d).select("sid", "hyp", F.posexplode(F.array("ref", "src")).alias("ref_no", "ref"))
    return R.rouge_n(rows, 1, "sid", "ref_no")


_TWO = _rouge_sql(1).replace(f"({_PAIRS})", f"(SELECT sid * 2 AS pair_id, hyp AS orig, ref AS cor FROM ({_TRIPLES}) UNION ALL SELECT sid * 2 + 1, hyp, src FROM ({_TRIPLES}))")
add("rouge_1_best", lambda s, d: _rounded(R.best(_two_refs(s, d), "sid"), "sid"), f"SELECT sid, x.p AS p, x.r AS r, x.f AS f FROM (SELECT pair_id // 2 AS sid, max({{'f': f, 'r': r, 'p': p}}) AS x FROM ({_TWO}) GROUP BY 1)")
add("rouge_1_all", lambda s, d: _rounded(R.listed(_two_refs(s, d), "sid").select("sid", F.posexplode("scores").alias("no", "x")).select("sid", "no", "x.*"), "sid", "no"), f"SELECT pair_id // 2 AS sid, CAST(row_number() OVER (PARTITION BY pair_id // 2 ORDER BY p, r, f) - 1 AS INT) AS no, p, r, f FROM ({_TWO})")

# ---- Hangul ------------------------------------------------------------------------------------------

_syll = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("k"), H.character((44032 + F.col("o_orderkey") % 11172).cast("int")).alias("c"))
_SYLL = "SELECT o_orderkey AS k, CAST(o_orderkey % 11172 AS INT) AS x, chr(CAST(44032 + o_orderkey % 11172 AS INT)) AS c FROM orders"
_dec = lambda s, d: _syll(s, d).select("k", "c", H.decompose(F.col("c")).alias("x")).select("k", "c", "x.*")
_DEC = f"SELECT k, c, {q(H.INITIALS)}[x // 588 + 1] AS cho, {q(H.MEDIALS)}[x // 28 % 21 + 1] AS jung, {q(H.FINALS)}[x % 28 + 1] AS jong FROM ({_SYLL})"
add("h02_decompose", _dec, _DEC)
add("h01_compose", lambda s, d: _dec(s, d).select("k", H.compose(F.col("cho"), F.col("jung"), F.col("jong")).alias("c")), f"SELECT k, c FROM ({_SYLL})")
_chars = lambda s, d: raw(s, d).select("pair_id", F.explode(F.split(F.concat("o", "c"), "")).alias("c")).filter("c <> ''")
_CHAR = f"SELECT pair_id, unnest(string_split(o || c, '')) AS c FROM ({_RAW}) WHERE o || c <> ''"
add("h03_is_korean", lambda s, d: _chars(s, d).groupBy("pair_id").agg(F.count_if(H.is_korean(F.col("c"))).alias("n_korean")), f"SELECT pair_id, count(*) FILTER (unicode(c) BETWEEN 44032 AND 55203 OR unicode(c) BETWEEN 12593 AND 12643) AS n_korean FROM ({_CHAR}) GROUP BY 1")
add("h04_is_consonant", lambda s, d: _chars(s, d).groupBy("pair_id").agg(F.count_if(H.is_consonant(F.col("c"))).alias("n_consonants")), f"SELECT pair_id, count(*) FILTER (unicode(c) BETWEEN 12593 AND 12622) AS n_consonants FROM ({_CHAR}) GROUP BY 1")
_tok = lambda s, d: pairs(s, d).select(F.explode(F.concat(X.tokens(F.col("orig")), X.tokens(F.col("cor")))).alias("token")).distinct()
_TOK = f"SELECT DISTINCT unnest(list_concat({sql_tokens('orig')}, {sql_tokens('cor')})) AS token FROM ({_PAIRS})"
_UNITS = f"WITH t AS (SELECT token, string_split(token, '') AS c FROM ({_TOK})), u AS (SELECT token, c, list_transform(c, lambda x: CASE WHEN unicode(x) BETWEEN 44032 AND 55203 THEN unicode(x) - 44032 END) AS n FROM t)"


def _contraction_sql(*cases: tuple[str, str]) -> str:
    """SQL of a contraction: conditions on the syllables p and v at i - 1 and i, with the medial that comes."""
    p, v = "n[i - 1]", "n[i]"
    names = {"pc": f"({p} // 588)", "pm": f"({p} // 28 % 21)", "pf": f"({p} % 28)", "vc": f"({v} // 588)", "vm": f"({v} // 28 % 21)", "vf": f"({v} % 28)"}

    def put(text: str) -> str:
        for k, x in names.items():
            text = re.sub(rf"\b{k}\b", x, text)
        return text

    made = "CASE " + " ".join(f"WHEN {put(c)} THEN {put(m)}" for c, m in cases) + " END"
    new = f"chr(CAST(44032 + {names['pc']} * 588 + ({made}) * 28 + {names['vf']} AS INT))"
    return f"{_UNITS}, w AS (SELECT token, c, n, list_max(list_filter(range(2, len(c) + 1), lambda i: {names['vc']} = 11 AND ({made}) IS NOT NULL)) AS i FROM u) SELECT token, CASE WHEN i IS NULL THEN token ELSE array_to_string(c[1:i-2], '') || {new} || array_to_string(c[i+1:], '') END AS made FROM w"


_ABSORB = f"list_transform(regexp_extract_all(token, '[가-힣][{H.FINALS.strip()}]+|(?s:.)'), lambda u: CASE WHEN length(u) > 1 THEN chr(CAST(44032 + (unicode(u[1]) - 44032) // 28 * 28 + instr({q(H.FINALS)}, u[-1]) - 1 AS INT)) ELSE u END)"
_RULE_SQL = {
    "h05_absorb_consonants": f"SELECT token, array_to_string({_ABSORB}, '') AS made FROM ({_TOK})",
    "h09_rule_34": _contraction_sql(("pm IN (0, 1, 4, 5, 6) AND pf = 0 AND vm IN (0, 6) AND pc = 18", "1"), ("pm IN (0, 1, 4, 5, 6) AND pf = 0 AND vm IN (0, 1, 4, 5, 6)", "pm")),
    "h10_rule_35": _contraction_sql(("pc = 2 AND pm = 8 AND pf = 27 AND vm IN (0, 4) AND vf = 20", "9"), ("pm = 8 AND pf = 0 AND vm = 0 AND vf = 20", "9"), ("pm = 13 AND pf = 0 AND vm = 4 AND vf = 20", "14"), ("pm = 11 AND pf = 0 AND vm = 4 AND vf = 20", "10")),
    "h11_rule_36": _contraction_sql(("pm = 20 AND pf = 0 AND vm = 4 AND vf = 20", "6")),
    "h12_soften": f"SELECT token, CASE WHEN regexp_matches(token, '[렵럽]어') THEN replace(replace(regexp_extract(token, '^(.*?[렵럽])어', 1, 's'), '렵', '려'), '럽', '러') || '워' ELSE token END AS made FROM ({_TOK})",
}
for _name, _f in {"h05_absorb_consonants": H.absorbed, "h08_contract": H.contract_token, "h09_rule_34": lambda c: H.contracted(c, "34"), "h10_rule_35": lambda c: H.contracted(c, "35"), "h11_rule_36": lambda c: H.contracted(c, "36"), "h12_soften": H.softened}.items():
    add(_name, lambda s, d, f=_f: _tok(s, d).select("token", f(F.col("token")).alias("made")), _RULE_SQL.get(_name))
add("h06_absorb_until_done", lambda s, d: _tok(s, d).select("token", H.absorbed(H.absorbed(F.col("token"))).alias("made")), _RULE_SQL["h05_absorb_consonants"])  # a second pass finds nothing
add("h07_join_tokens", lambda s, d: pairs(s, d).select("pair_id", F.explode(X.word_pairs(X.tokens(F.col("orig")))).alias("w")).select("pair_id", H.joined(F.col("w")[0], F.col("w")[1]).alias("x")).select("pair_id", "x.*"), f"""
WITH w AS (SELECT pair_id, t[i] AS l, t[i + 1] AS r FROM (SELECT pair_id, t, unnest(range(1, len(t))) AS i FROM (SELECT pair_id, {sql_tokens('orig')} AS t FROM ({_PAIRS})))),
x AS (SELECT *, l[-1] BETWEEN '가' AND '힣' AND instr({q(H.FINALS.strip())}, r[1]) > 0 AS fits FROM w)
SELECT pair_id, CASE WHEN fits THEN l[1:-2] || chr(CAST(44032 + (unicode(l[-1]) - 44032) // 28 * 28 + instr({q(H.FINALS)}, r[1]) - 1 AS INT)) || r[2:] ELSE l END AS head, CASE WHEN NOT fits THEN r END AS tail FROM x""")
add("h13_compose_vowels", lambda s, d: _dec(s, d).select("k", F.explode(F.array(F.lit("ㅏ"), F.lit("ㅓ"))).alias("second"), "jung").select("k", "second", H.compose_vowels(F.col("jung"), F.col("second")).alias("v")), f"SELECT k, second, CASE jung || second WHEN 'ㅗㅏ' THEN 'ㅘ' WHEN 'ㅜㅓ' THEN 'ㅝ' WHEN 'ㅚㅓ' THEN 'ㅙ' WHEN 'ㅣㅓ' THEN 'ㅕ' END AS v FROM ({_DEC}), (VALUES ('ㅏ'), ('ㅓ')) AS x(second)")
add("h14_levenshtein", lambda s, d: pairs(s, d).select("pair_id", F.levenshtein("orig", "cor").alias("distance")), f"WITH RECURSIVE {sql_grid(_CHARS, 'pair_id', UNIT)} SELECT pair_id, CAST(v AS INT) AS distance FROM dp")
_SWAP = "CASE WHEN a[i] = b[d + 1 - i] THEN 0 WHEN a[i] || b[d + 1 - i] IN ('을를', '를을') THEN 0.5 ELSE 1 END"
add("h14_weighted_levenshtein", lambda s, d: spread(s, d).select("pair_id", H.weighted_distance({("을", "를"): 0.5, ("를", "을"): 0.5})("orig", "cor").alias("distance")), f"WITH RECURSIVE {sql_grid(_CHARS, 'pair_id', _SWAP)} SELECT pair_id, v AS distance FROM dp")
add("h17_insert_delete_distance", lambda s, d: pairs(s, d).select("pair_id", A.insert_delete_distance(X.tokens(F.col("orig")), X.tokens(F.col("cor"))).alias("distance")), f"""WITH RECURSIVE {sql_grid(f"SELECT pair_id, {sql_tokens('orig')} AS a, {sql_tokens('cor')} AS b FROM ({_PAIRS})", "pair_id", "", common=True)} SELECT pair_id, CAST(len(a) + len(b) - 2 * v AS INT) AS distance FROM dp""")
add("h20_token_offset", lambda s, d: pairs(s, d).select("pair_id", "orig", F.explode(F.sequence(F.lit(0), F.length("orig"))).alias("chars")).select("pair_id", "chars", M2.token_offset(F.col("orig"), F.col("chars")).alias("token")), f"SELECT pair_id, CAST(chars AS INT) AS chars, len({sql_tokens('orig[1:chars]')}) AS token FROM (SELECT pair_id, orig, unnest(range(0, length(orig) + 1)) AS chars FROM ({_PAIRS}))")
add("h23_shrink", lambda s, d: pairs(s, d).select("pair_id", A.shrunk(X.tokens(F.col("orig")), X.tokens(F.col("cor"))).alias("x")).select("pair_id", "x.front", F.array_join("x.orig", " ").alias("orig"), F.array_join("x.cor", " ").alias("cor")), f"""
WITH t AS (SELECT pair_id, {sql_tokens('orig')} AS a, {sql_tokens('cor')} AS b FROM ({_PAIRS})),
f AS (SELECT *, coalesce(list_min(list_filter(range(0, least(len(a), len(b)) + 1), lambda i: i = least(len(a), len(b)) OR a[i + 1] <> b[i + 1])), 0) AS front FROM t),
g AS (SELECT *, list_min(list_filter(range(0, least(len(a), len(b)) - front + 1), lambda i: i = least(len(a), len(b)) - front OR a[len(a) - i] <> b[len(b) - i])) AS back FROM f)
SELECT pair_id, CAST(front AS INT) AS front, array_to_string(a[front + 1:len(a) - back], ' ') AS orig, array_to_string(b[front + 1:len(b) - back], ' ') AS cor FROM g""")
add("h25_limit_words", lambda s, d: pairs(s, d).select("pair_id", F.array_join(X.limit_words(F.array("orig", "cor"), 8), " ").alias("t")), f"SELECT pair_id, array_to_string(list_concat({sql_tokens('orig')}, {sql_tokens('cor')})[1:8], ' ') AS t FROM ({_PAIRS})")

# ---- alignment, edits, M2 ----------------------------------------------------------------------------

_annotated = lambda s, d, how="rules": A.annotate(spread(s, d).select("pair_id", "orig", "cor"), how=how)
add("d01_unit_alignment", lambda s, d: table(s, d, "part").select("p_partkey", A.unit_alignment("p_name", "p_type").alias("x")).select("p_partkey", "x.*"))
add("d02_alignment", lambda s, d: spread(s, d).select("pair_id", A.alignment("orig", "cor").alias("moves")).select("pair_id", F.posexplode("moves").alias("no", "m")).select("pair_id", "no", "m.*"))
add("d06_typed_edits", lambda s, d: A.exploded(_annotated(s, d)))
add("d07_edits_split", lambda s, d: A.exploded(_annotated(s, d, "split")))
add("d07_edits_equal", lambda s, d: A.exploded(_annotated(s, d, "equal")))
add("d07_edits_all", lambda s, d: A.exploded(_annotated(s, d, "all")))
add("w01_runs_of_moves", lambda s, d: spread(s, d).select("pair_id", A.alignment("orig", "cor").alias("m")).select("pair_id", F.explode(A.runs(F.col("m"))).alias("r")).select("pair_id", "r.*"))
add("w02_runs_of_edits", lambda s, d: spread(s, d).select("pair_id", A.alignment("orig", "cor").alias("m")).select("pair_id", F.explode(A.runs(F.col("m"), "edit")).alias("r")).select("pair_id", "r.*"))
add("f20_not_matching", lambda s, d: spread(s, d).select("pair_id", F.size(F.filter(A.alignment("orig", "cor"), lambda m: m["op"] != "M")).alias("n_edits")))


# edits put into the original give the correction, whole tables through
_WHOLE = f"SELECT pair_id, array_to_string({sql_tokens('cor')}, ' ') AS made FROM ({_PAIRS})"
_squeezed = lambda c: F.array_join(X.tokens(c), " ")
for _name, _how in {"d06_edits_applied": "rules", "d07_split_applied": "split", "d07_equal_applied": "equal", "d07_all_applied": "all"}.items():
    add(_name, lambda s, d, how=_how: _annotated(s, d, how).select("pair_id", _squeezed(A.applied(X.split_tokens(F.col("orig")), F.col("edits"))).alias("made")), _WHOLE)
add("a04_unchanged", lambda s, d: _annotated(s, d).agg(F.count("*").alias("n_lines"), F.count_if(F.size("edits") == 0).alias("n_unchanged")), f"SELECT count(*) AS n_lines, count(*) FILTER (orig = cor) AS n_unchanged FROM ({_PAIRS})")
add("f20_differing", lambda s, d: spread(s, d).select("pair_id", F.exists(A.alignment("orig", "cor"), lambda m: m["op"] != "M").alias("differs")), f"SELECT pair_id, orig <> cor AS differs FROM ({_PAIRS})")
add("w01_runs_cover", lambda s, d: spread(s, d).select("pair_id", A.alignment("orig", "cor").alias("m")).select("pair_id", A.runs(F.col("m")).alias("r")).select("pair_id", F.aggregate("r", F.lit(0), lambda n, x: n + x["s1"] - x["s0"]).alias("n_orig"), F.aggregate("r", F.lit(0), lambda n, x: n + x["t1"] - x["t0"]).alias("n_cor")), f"SELECT pair_id, CAST(len(string_split(orig, ' ')) AS INT) AS n_orig, CAST(len(string_split(cor, ' ')) AS INT) AS n_cor FROM ({_PAIRS})")


def _tags(s, d) -> DataFrame:
    return S.morphs(S.shred(table(s, d, "learner_sentences"))).filter("section = 'M'")


_coarse = lambda: A.coarse_class(F.coalesce("pos", F.lit("UN"))).alias("class")
_COARSE_SQL = "CASE " + " ".join(f"WHEN pos IN ({', '.join(map(q, tags.split()))}) THEN '{name}'" for name, tags in CLASSES.items()) + " ELSE 'UNCLASSIFIED' END"
_all_tags = lambda s, d: S.morphs(S.shred(table(s, d, "learner_sentences")))
_MORPHS = GENERAL["p2_morphs"]
add("d11_coarse_class", lambda s, d: _all_tags(s, d).groupBy("pos", _coarse()).agg(F.count("*").alias("n")), f"SELECT pos, {_COARSE_SQL} AS class, count(*) AS n FROM ({_MORPHS}) GROUP BY 1, 2")
add("d12_composite_type", lambda s, d: _all_tags(s, d).groupBy("sentence_id", "section", "word_no").agg(F.array_sort(F.collect_set(_coarse())).alias("kinds")).select("sentence_id", "section", "word_no", A.composite_type(F.col("kinds")).alias("type")), f"""
WITH k AS (SELECT sentence_id, section, word_no, list_distinct(list({_COARSE_SQL})) AS k FROM ({_MORPHS}) GROUP BY 1, 2, 3)
SELECT sentence_id, section, word_no, CASE WHEN len(k) = 1 THEN k[1] WHEN len(k) = 2 AND list_contains(k, 'ENDING') AND (list_contains(k, 'VERB') OR list_contains(k, 'ADJECTIVE')) THEN 'CONJUGATION'
  WHEN list_contains(k, 'NOUN') THEN 'UNCLASSIFIED' WHEN list_contains(k, 'VERB') <> list_contains(k, 'ADJECTIVE') THEN 'CONJUGATION' ELSE 'UNCLASSIFIED' END AS type FROM k""")


def _lexicon(s, d) -> DataFrame:
    """Morphemes of words as the annotated sentences have them: for each surface the least analysis."""
    parts = _tags(s, d).filter("text <> ''").groupBy("sentence_id", "word_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("morph_no", F.col("text").alias("m"), F.coalesce("pos", F.lit("UN")).alias("pos")))), lambda x: F.struct(x["m"].alias("m"), x["pos"].alias("pos"))).alias("morphs"))
    return parts.groupBy(F.array_join(F.transform("morphs", lambda x: x["m"]), "").alias("token")).agg(F.min("morphs").alias("morphs"))


def _morph_groups(s, d) -> DataFrame:
    nodes = S.shred(table(s, d, "learner_sentences"))
    key = ["sentence_id", "body_key"]
    words = S.words(nodes).filter("section = 'M'").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "w"))), lambda x: x["w"]).alias("words"))
    morphs = S.morphs(nodes).filter("section = 'M'").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "morph_no", F.col("text").alias("m"), "pos"))), lambda x: F.struct(x["m"].alias("m"), x["pos"].alias("pos"))).alias("morphs"))
    return words.join(morphs, key).select("sentence_id", F.posexplode(A.grouped_morphs("words", "morphs")).alias("word_no", "g")).select("sentence_id", "word_no", F.size("g").alias("n_morphs"))


add("d13_morph_groups", _morph_groups)
add("j07_lexicon_types", lambda s, d: A.histogram(A.annotate(spread(s, d).select("pair_id", "orig", "cor"), pos=_lexicon(s, d))))
add("d09_spelling_types", lambda s, d: A.histogram(A.annotate(spread(s, d).select("pair_id", "orig", "cor"), spelling=pairs(s, d).select(F.explode(X.split_tokens(F.col("orig"))).alias("token")).distinct().select("token", F.array(F.replace("token", F.lit("에소"), F.lit("에서"))).alias("suggestions")))))

_m2 = lambda s, d: _annotated(s, d).select("pair_id", "orig", F.regexp_replace(M2.block(F.col("orig"), F.col("edits")), "\n$", "").alias("block"))
add("k01_m2_blocks", lambda s, d: _m2(s, d).select("pair_id", "block"))
add("k02_m2_of_types", lambda s, d: M2.with_types(_annotated(s, d), "WS").select("pair_id"))
add("s04_m2_parse", lambda s, d: M2.parse(_m2(s, d).select("pair_id", "block")).select("pair_id", "source", F.size("edits").alias("n_edits")))
add("f21_m2_gold", lambda s, d: M2.gold(M2.parse(_m2(s, d).select("pair_id", "block"))).select("pair_id", "annotator", F.size("gold").alias("n_gold")))
_spaced = lambda s, d: A.annotate(spread(s, d).select("pair_id", *(_squeezed(F.col(c)).alias(c) for c in ("orig", "cor"))))
add("s04_m2_applied", lambda s, d: M2.parse(_spaced(s, d).select("pair_id", M2.block(F.col("orig"), F.col("edits")).alias("block"))).select("pair_id", A.applied(X.tokens(F.col("source")), F.filter("edits", lambda e: e["start"] >= 0), lambda e: e["corrections"][0]).alias("made")), _WHOLE)
add("f21_gold_applied", lambda s, d: M2.gold(M2.parse(_spaced(s, d).select("pair_id", M2.block(F.col("orig"), F.col("edits")).alias("block")))).select("pair_id", A.applied(X.tokens(F.col("source")), F.col("gold"), lambda e: e["corrections"][0]).alias("made")), _WHOLE)
add("k11_created_applied", lambda s, d: spread(s, d).select("pair_id", A.applied(X.tokens(F.col("orig")), M.created_edits("orig", "cor")).alias("made")), _WHOLE)
_probe = lambda s, d: pairs(s, d).select(F.col("pair_id").alias("pos"), F.col("orig").alias("source"), F.col("cor").alias("block"))
add("j03_reorder_m2", lambda s, d: M2.reorder(_probe(s, d).select("pos", "source"), _probe(s, d)), f"""
WITH b AS (SELECT trim(orig, ' ') AS source, max_by(cor, pair_id) AS block FROM ({_PAIRS}) GROUP BY 1)
SELECT pair_id AS pos, trim(orig, ' ') AS source, b.block, true AS found FROM ({_PAIRS}) p JOIN b ON b.source = trim(p.orig, ' ')""")
add("k10_suggestions_report", lambda s, d: P.suggestions_report(table(s, d, "part").select(F.col("p_brand").alias("token"), F.array("p_type", "p_name").alias("suggestions"))), "SELECT rpad(p_brand, 15, ' ') || ' ' || p_type || ', ' || p_name AS value FROM part")
add("k11_created_edits", lambda s, d: triples(s, d).select("sid", M.created_edits("src", "hyp").alias("edits")).select("sid", F.explode("edits").alias("e")).select("sid", "e.*"))
_sides = lambda s, d: [side.select(F.lit(name).alias("side"), "value") for side, name in zip(P.split_sides(pairs(s, d)), ("original", "corrected"))]
add("k06_sides", lambda s, d: _sides(s, d)[0].union(_sides(s, d)[1]), f"SELECT 'original' AS side, {sql_strip('orig')} AS value FROM ({_PAIRS}) UNION ALL SELECT 'corrected', {sql_strip('cor')} FROM ({_PAIRS})")


def _gold(s, d) -> DataFrame:
    edits = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.array_join(F.slice(X.split_tokens(F.col("orig")), e["start"] + 1, e["end"] - e["start"]), " ").alias("original"), F.array(e["cor"]).alias("corrections")))
    rows = _annotated(s, d).select(F.col("pair_id").alias("sid"), F.regexp_replace(X.strip(F.col("orig")), " +", " ").alias("src"), edits.alias("gold"))
    return rows.withColumn("hyp", F.replace("src", F.lit("을"), F.lit("를")))


_scored = lambda s, d: _gold(s, d).select("sid", M.counts()("src", "hyp", "gold").alias("x")).select("sid", "x.*")
add("maxmatch_counts", _scored)
add("maxmatch_single", lambda s, d: M.single(_scored(s, d)))


def _multi(s, d) -> DataFrame:
    rows = _gold(s, d).select("sid", "src", "hyp", F.posexplode(F.array("gold", F.filter("gold", lambda _: F.lit(False)))).alias("annotator_no", "gold"))
    return M.multi(rows.select("sid", "annotator_no", M.counts()("src", "hyp", "gold").alias("x")).select("sid", "annotator_no", "x.*"))


add("maxmatch_multi", _multi)
_numbers = lambda s, d: pairs(s, d).select(F.col("pair_id").alias("sid"), F.size(F.array_intersect(X.tokens(F.col("orig")), X.tokens(F.col("cor")))).alias("correct"), F.size(X.tokens(F.col("orig"))).alias("proposed"), F.size(X.tokens(F.col("cor"))).alias("gold"))
add("w03_running_counts", lambda s, d: M.running(_numbers(s, d)), f"""SELECT sid, {', '.join(f'CAST(sum({c}) OVER (ORDER BY sid) AS BIGINT) AS {c}' for c in ('correct', 'proposed', 'gold'))}
FROM (SELECT pair_id AS sid, len(list_intersect({sql_tokens('orig')}, {sql_tokens('cor')})) AS correct, len({sql_tokens('orig')}) AS proposed, len({sql_tokens('cor')}) AS gold FROM ({_PAIRS}))""")


_proofread = lambda s, d: L.proofread_records(S.shred(table(s, d, "learner_sentences")))
add("d26_proofread", lambda s, d: _proofread(s, d).select("sentence_id", "original", "corrected", F.size("edits").alias("n_edits")))
add("k05_proofread_m2", lambda s, d: _proofread(s, d).select("sentence_id", M2.block(F.col("original"), F.col("edits")).alias("block")))

# ---- data sets ---------------------------------------------------------------------------------------

_named = lambda s, d: D.split(table(s, d, "kor_lang8").select("pair_id"), "pair_id")
_NAMED = """WITH a AS (SELECT pair_id, row_number() OVER (ORDER BY md5(pair_id || ':order'), pair_id) AS p, count(*) OVER () AS t FROM kor_lang8)
SELECT pair_id, CASE WHEN p <= t - ceil(t * 0.3) THEN 'train' WHEN p <= t - ceil(ceil(t * 0.3) * 0.5) THEN 'val' ELSE 'test' END AS split FROM a"""
add("t01_split", _named, _NAMED)
add("t01_split_sizes", lambda s, d: _named(s, d).groupBy("split").agg(F.count("*").alias("n")), f"SELECT split, count(*) AS n FROM ({_NAMED}) GROUP BY 1")
add("o04_sample", lambda s, d: D.sample(table(s, d, "kor_lang8").select("pair_id"), "pair_id"), "SELECT pair_id FROM kor_lang8 ORDER BY md5(pair_id || ':order'), pair_id LIMIT 500")
add("u02_union_corpora", lambda s, d: D.union(kor=pairs(s, d).select("orig", "cor"), raw=raw_pairs(s, d)).groupBy("corpus").agg(F.count("*").alias("n"), F.sum(F.length("orig")).alias("chars")), f"SELECT 'kor' AS corpus, count(*) AS n, CAST(sum(length(orig)) AS BIGINT) AS chars FROM ({_PAIRS}) UNION ALL SELECT 'raw', count(*), CAST(sum(length(original)) AS BIGINT) FROM lang8_raw WHERE original IS NOT NULL AND corrected IS NOT NULL")
add("u04_common_tokens", lambda s, d: pairs(s, d).select("pair_id", F.array_join(X.kept_items(X.tokens(F.col("orig")), X.tokens(F.col("cor"))), " ").alias("t")), f"SELECT pair_id, array_to_string(list_filter({sql_tokens('orig')}, lambda x: list_contains({sql_tokens('cor')}, x)), ' ') AS t FROM ({_PAIRS})")
_ids = lambda c: F.transform(X.tokens(F.col(c)), lambda w: F.length(w) + 1)
_IDS = lambda c: f"list_transform({sql_tokens(c)}, lambda w: length(w) + 1)"
_joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
add("t02_pad", lambda s, d: pairs(s, d).select("pair_id", _joined(D.pad(_ids("orig"), 16)).alias("ids")), f"SELECT pair_id, array_to_string(list_resize({_IDS('orig')}[1:16], 16, 0), ' ') AS ids FROM ({_PAIRS})")
add("t03_pad_labels", lambda s, d: pairs(s, d).select("pair_id", _joined(D.pad(_ids("cor"), 16, D.IGNORE)).alias("ids")), f"SELECT pair_id, array_to_string(list_resize({_IDS('cor')}[1:16], 16, -100), ' ') AS ids FROM ({_PAIRS})")
_record = lambda s, d: pairs(s, d).select("pair_id", D.decoder_record(_ids("orig"), _ids("cor"), 16).alias("r"))
add("t04_decoder_record", lambda s, d: _record(s, d).select("pair_id", *(_joined(F.col(f"r.{c}")).alias(c) for c in ("input_ids", "decoder_input_ids", "labels"))), f"""
WITH a AS (SELECT pair_id, {_IDS('orig')} AS o, list_append({_IDS('cor')}, 1) AS l FROM ({_PAIRS}))
SELECT pair_id, array_to_string(list_resize(o[1:16], 16, 0), ' ') AS input_ids, array_to_string(list_resize(list_prepend(0, l[1:-2])[1:16], 16, 0), ' ') AS decoder_input_ids, array_to_string(list_resize(l[1:16], 16, -100), ' ') AS labels FROM a""")
add("t05_attention_mask", lambda s, d: _record(s, d).select("pair_id", _joined(D.attention_mask(F.col("r.input_ids"))).alias("mask")), f"SELECT pair_id, array_to_string(list_transform(list_resize({_IDS('orig')}[1:16], 16, 0), lambda x: CAST(x <> 0 AS INT)), ' ') AS mask FROM ({_PAIRS})")
add("t06_unmask", lambda s, d: _record(s, d).select("pair_id", _joined(D.unmask(F.col("r.labels"))).alias("ids")), f"SELECT pair_id, array_to_string(list_resize(list_append({_IDS('cor')}, 1)[1:16], 16, 1), ' ') AS ids FROM ({_PAIRS})")
_chance = lambda salt: f"CAST('0x' || md5(CAST(pair_id AS VARCHAR) || ':' || {salt})[1:8] AS BIGINT) / 4294967296.0"
_ORIG_TOKENS = f"SELECT pair_id, orig, {sql_tokens('orig')} AS t FROM ({_PAIRS})"
add("t07_replace_some", lambda s, d: pairs(s, d).select("pair_id", F.array_join(D.replace_some(X.tokens(F.col("orig")), F.col("pair_id"), {"같이": "가치", "많이": "마니"}), " ").alias("t")), f"SELECT pair_id, array_to_string(list_transform(t, lambda w, i: CASE WHEN {_chance('CAST(i - 1 AS VARCHAR)')} < 0.2 THEN CASE w WHEN '같이' THEN '가치' WHEN '많이' THEN '마니' ELSE w END ELSE w END), ' ') AS t FROM ({_ORIG_TOKENS})")
add("t08_mask_words", lambda s, d: pairs(s, d).select("pair_id", F.array_join(D.mask_words(X.tokens(F.col("orig")), F.col("pair_id")), " ").alias("t")), f"SELECT pair_id, array_to_string(list_transform(t, lambda w, i: CASE WHEN {_chance('CAST(i - 1 AS VARCHAR)')} < 0.1 THEN '<mask>' ELSE w END), ' ') AS t FROM ({_ORIG_TOKENS})")
add("t08_permute_sentences", lambda s, d: pairs(s, d).select("pair_id", F.array_join(D.permute_sentences(F.split("orig", r"(?<=\.) "), F.col("pair_id")), " ").alias("t")), f"SELECT pair_id, array_to_string(list_transform(list_sort(list_transform(string_split(replace(orig, '. ', '.' || chr(1)), chr(1)), lambda x, i: {{'c': {_chance('CAST(i - 1 AS VARCHAR)')}, 'i': i, 's': x}})), lambda x: x.s), ' ') AS t FROM ({_PAIRS})")
add("t08_roll", lambda s, d: pairs(s, d).select("pair_id", F.array_join(D.roll(X.tokens(F.col("orig")), F.col("pair_id")), " ").alias("t")), f"SELECT pair_id, array_to_string(list_concat(t[k + 1:], t[1:k]), ' ') AS t FROM (SELECT pair_id, t, CAST(floor({_chance(q('roll'))} * len(t)) AS INT) AS k FROM ({_ORIG_TOKENS}))")
_epochs = lambda s, d: table(s, d, "events").groupBy(F.col("user_id").alias("epoch")).agg(F.round(F.avg("value"), 4).alias("gleu"))
_EPOCHS = "SELECT user_id AS epoch, round(avg(value), 4) AS gleu FROM events GROUP BY 1"
add("a15_mean_loss", _epochs, _EPOCHS)
add("a16_best_epoch", lambda s, d: D.best_so_far(_epochs(s, d)), f"{_EPOCHS} ORDER BY gleu DESC, epoch LIMIT 1")
add("a17_spacing_errors", lambda s, d: D.spacing_errors(pairs(s, d).select((F.length("orig") - F.length(F.replace("orig", F.lit(" "), F.lit("")))).alias("n_spaces"), F.size(X.tokens(F.col("orig"))).alias("n_groups"))).withColumn("percent", F.round("percent", 6)), f"""
WITH a AS (SELECT length(orig) - length(replace(orig, ' ', '')) AS s, len({sql_tokens('orig')}) AS g FROM ({_PAIRS}))
SELECT count(*) AS n_sides, count(*) FILTER (s + 1 <> g) AS n_wrong, round(count(*) FILTER (s + 1 <> g) * 100.0 / count(*), 6) AS percent FROM a""")
add("a19_max_and_min", lambda s, d: pairs(s, d).groupBy("source").agg(F.max_by("pair_id", F.struct(F.length("orig"), F.col("pair_id"))).alias("longest"), F.min_by("pair_id", F.struct(F.length("orig"), F.col("pair_id"))).alias("shortest")), f"SELECT source, max_by(pair_id, {{'a': length(orig), 'b': pair_id}}) AS longest, min_by(pair_id, {{'a': length(orig), 'b': pair_id}}) AS shortest FROM ({_PAIRS}) GROUP BY 1")
add("a20_softmax", lambda s, d: pairs(s, d).select("pair_id", F.posexplode(D.softmax(F.transform(_ids("orig"), lambda x: x.cast("double")))).alias("no", "p")).withColumn("p", F.round("p", 6)), f"""
WITH a AS (SELECT pair_id, {_IDS('orig')} AS v FROM ({_PAIRS})), e AS (SELECT pair_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM a), t AS (SELECT pair_id, e, list_sum(e) AS total, unnest(range(1, len(e) + 1)) AS i FROM e)
SELECT pair_id, CAST(i - 1 AS INT) AS no, round(e[i] / total, 6) AS p FROM t""")


add("u01_concatenate", lambda s, d: pairs(s, d).select(F.col("orig").alias("t")).unionByName(pairs(s, d).select(F.col("cor").alias("t"))), f"SELECT orig AS t FROM ({_PAIRS}) UNION ALL SELECT cor FROM ({_PAIRS})")
add("u03_token_union", lambda s, d: pairs(s, d).select("pair_id", F.size(F.array_union(X.tokens(F.col("orig")), X.tokens(F.col("cor")))).alias("n"), F.arrays_overlap(X.tokens(F.col("orig")), X.tokens(F.col("cor"))).alias("overlap")), f"SELECT pair_id, len(list_distinct(list_concat({sql_tokens('orig')}, {sql_tokens('cor')}))) AS n, list_has_any({sql_tokens('orig')}, {sql_tokens('cor')}) AS overlap FROM ({_PAIRS})")
add("o01_sorted_tokens", lambda s, d: pairs(s, d).select("pair_id", F.array_join(F.array_sort(F.array_distinct(X.tokens(F.col("orig")))), " ").alias("t")), f"SELECT pair_id, array_to_string(list_sort(list_distinct({sql_tokens('orig')})), ' ') AS t FROM ({_PAIRS})")
add("e05_number_range", lambda s, d: table(s, d, "nation").select("n_nationkey", F.explode(D.number_range(0.0, 1.0, 0.25)).alias("x")), "SELECT n_nationkey, unnest([0.0, 0.25, 0.5, 0.75])::DOUBLE AS x FROM nation")
add("w04_token_offsets", lambda s, d: pairs(s, d).select("pair_id", F.posexplode(X.token_offsets(F.split("orig", r"\. ", -1))).alias("no", "at")), f"""
WITH a AS (SELECT pair_id, string_split(orig, '. ') AS t FROM ({_PAIRS})), b AS (SELECT pair_id, t, unnest(range(1, len(t) + 1)) AS i FROM a), c AS (SELECT pair_id, CAST(i - 1 AS INT) AS no, len({sql_tokens('t[i]')}) AS n FROM b)
SELECT pair_id, no, CAST(coalesce(sum(n) OVER (PARTITION BY pair_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS at FROM c""")
add("k09_spacing_report", lambda s, d: P.spacing_report(pairs(s, d)), f"""
WITH a AS (SELECT pair_id, orig, length(orig) - length(replace(orig, ' ', '')) + 1 AS n_words, len({sql_tokens('orig')}) AS n_groups FROM ({_PAIRS})) SELECT pair_id, orig, n_words, n_groups FROM a WHERE n_words <> n_groups""")
add("h26_rouge_weighted", lambda s, d: _rounded(R.n_counts(_hyp_ref(s, d), 1, "pair_id").select("pair_id", *R.prf(F.col("n_hyp"), F.col("n_ref"), F.col("n_common"), alpha=0.7, weight=1.2)), "pair_id"), _rouge_sql(1).replace("coalesce(pp, 0) AS p, coalesce(rr, 0) AS r", "coalesce(pow(pp, 1 / 1.2), 0) AS p, coalesce(pow(rr, 1 / 1.2), 0) AS r").replace("(0.5 * p + 0.5 * r)", "(0.3 * p + 0.7 * r)"))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

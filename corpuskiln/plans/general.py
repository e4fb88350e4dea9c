"""Queries of the general data problems: lines that fail to parse, and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.operators import shred as S
from corpuskiln.sources import rejects
from corpuskiln.util import table


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lang8_lines")


def _nodes(spark, sf_dir):
    return S.shred(table(spark, sf_dir, "learner_sentences"))


QUERIES = {
    "p1_found": lambda s, d: rejects.rejected(_lines(s, d)),
    "p1_loaded": lambda s, d: rejects.loaded(_lines(s, d)),
    "p1_report": lambda s, d: rejects.parse_lines(_lines(s, d)).groupBy("file_name", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n_lines")),
    "p2_found": lambda s, d: S.morph_places(S.shred(table(s, d, "learner_sentences"), repeated=True)),  # distinct itself
    "p2_nodes": lambda s, d: S.adjacency(_nodes(s, d)).groupBy("label", "is_object").agg(F.count("*").alias("n"), F.count("scalar").alias("n_scalars"), F.sum("n_children").alias("n_children")),
    "p2_sentences": lambda s, d: S.sentences(_nodes(s, d)).drop("body_key"),
    "p2_words": lambda s, d: S.words(_nodes(s, d)).drop("body_key"),
    "p2_morphs": lambda s, d: S.morphs(_nodes(s, d)).drop("body_key"),
}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_FIVE = "^" + r"\t".join([f"({_FIELD})"] * 5) + "$"
_WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
_BAD = r"[\x00-\x08\x0a-\x1f\x7f-\x{9f}\x{fffd}]"


def _value(i: int) -> str:
    """Field i of a line, without its quotes."""
    v = f"regexp_extract(t, {_sql(_FIVE)}, {i}, 's')"
    return f"CASE WHEN {v} LIKE '\"%' THEN replace({v}[2:-2], '\"\"', '\"') ELSE {v} END AS v{i}"


_P1 = rf"""
WITH a AS (SELECT line_id, regexp_replace(coalesce(line, ''), '\r$', '') AS t FROM lang8_lines),
b AS (SELECT line_id, regexp_full_match(t, {_sql(_FIELD + r"(?:\t" + _FIELD + ")*")}, 's') AS quoted, regexp_full_match(t, {_sql(_FIVE)}, 's') AS five, {', '.join(_value(i) for i in (1, 2, 4, 5))} FROM a),
c AS (SELECT *, NOT regexp_full_match(v1, '0*[1-9][0-9]*') OR NOT regexp_full_match(v2, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') OR try_cast(v2 AS TIMESTAMP) IS NULL
  OR regexp_full_match(v4, {_sql(_WHITE)}) OR regexp_full_match(v5, {_sql(_WHITE)}) OR regexp_matches(v4, {_sql(_BAD)}) OR regexp_matches(v5, {_sql(_BAD)}) AS wrong FROM b)
SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT five THEN 'column_count' ELSE 'value' END AS reason FROM c WHERE NOT quoted OR NOT five OR wrong"""



def _plain(c: str) -> str:
    """The text of XML content: references to characters and entities put in, empty content as null."""
    numbers = f"array_to_string(list_transform(string_split({c}, '&#'), lambda p, i: CASE WHEN i = 1 THEN p ELSE chr(CAST(split_part(p, ';', 1) AS INT)) || p[strpos(p, ';') + 1:] END), '')"
    return f"nullif(replace(replace(replace(replace(replace({numbers}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&amp;', '&'), '')"


def _attribute(c: str, name: str) -> str:
    both = f"regexp_extract({c}, {_sql('^<[^>]*[ ' + chr(92) + 'n]' + name + '=(' + chr(34) + '[^' + chr(34) + ']*' + chr(34) + '|' + chr(39) + '[^' + chr(39) + ']*' + chr(39) + ')')}, 1)"
    return f"CASE WHEN {both} <> '' THEN coalesce({_plain(f'({both})[2:-2]')}, '') END"


def _inside(c: str, tag: str) -> str:
    return _plain(f"regexp_extract({c}, '<{tag}(?:[ \\n][^>]*[^>/]|)>(.*?)</{tag}>', 1, 's')")


_LIST = "CASE coalesce(json_type({0}), 'NULL') WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'NULL' THEN [] ELSE [{0}] END"
#: The records, their words (``t`` in XML, ``o`` in JSON) and their morphs.
_P2 = f"""
WITH b AS (SELECT DISTINCT sentence_id, trim(body) AS body FROM learner_sentences WHERE body IS NOT NULL),
x AS (SELECT sentence_id, body, regexp_replace(replace(replace(regexp_replace(body, '<!--.*?-->', '', 'gs'), '<![CDATA[<]]>', '&lt;'), '<![CDATA[&]]>', '&amp;'), '<!.CDATA.(.*?)]]>', '\\1', 'gs') AS t FROM b WHERE body LIKE '<%'),
j AS (SELECT sentence_id, body, coalesce(json_extract(body, '$.SENTENCE'), body::JSON) AS o FROM b WHERE NOT body LIKE '<%'),
xs AS (SELECT sentence_id, body, section, regexp_extract_all(regexp_extract(t, '<' || a || '>(.*?)</' || a || '>', 1, 's'), '<word(?:/>|>.*?</word>)', 0, 's') AS w FROM x, (VALUES ('M', 'MorphemeAnnotations'), ('E', 'LearnerErrorAnnotations')) AS v(section, a)),
js AS (SELECT sentence_id, body, section, {_LIST.format("json_extract(o, '$.' || a || '.word')")} AS w FROM j, (VALUES ('M', 'MorphemeAnnotations'), ('E', 'LearnerErrorAnnotations')) AS v(section, a)),
xw AS (SELECT sentence_id, body, section, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS word_no FROM xs),
jw AS (SELECT sentence_id, body, section, unnest(w) AS o, unnest(range(1, len(w) + 1)) AS word_no FROM js),
xa AS (SELECT *, regexp_extract_all(t, '<morph(?:[ \\n][^>]*)?/>|<morph(?:[ \\n][^>]*[^>/])?>.*?</morph>', 0, 's') AS m FROM xw),
ja AS (SELECT *, {_LIST.format("json_extract(o, '$.morph')")} AS m FROM jw),
xm AS (SELECT sentence_id, section, word_no, unnest(m) AS t, unnest(range(1, len(m) + 1)) AS morph_no FROM xa),
jm AS (SELECT sentence_id, section, word_no, unnest(m) AS o, unnest(range(1, len(m) + 1)) AS morph_no FROM ja)
"""
_KEY = "sentence_id, section, CAST(word_no AS INT) AS word_no"
_ATTRIBUTES = {"pos": "pos", "from": "from_at", "to": "to_at", "subsequence": "subsequence", "analyzedType": "analyzed_type", "wordStart": "word_start"}
_MORPH_XML = [f"CASE WHEN t LIKE '%</morph>' AND t NOT LIKE '%><%' THEN {_inside('t', 'morph')} END AS text"]
_MORPH_XML += [f"{_attribute('t', a)} AS {b}" for a, b in _ATTRIBUTES.items()] + [f"{_inside('t', a)} AS {a.lower()}" for a in ("Preserved", "Removed", "Proofread")]
_PART = lambda tag: f"regexp_extract(t, '<{tag}(?:[ \\n][^>]*)?>', 0, 's')"
_MORPH_XML += [f"{_attribute(_PART('Proofread'), 'pos')} AS proofread_pos"] + [f"{_attribute(_PART(tag), 'type')} AS {name}" for tag, name in (("ErrorArea", "error_area"), ("ErrorPattern", "error_pattern"), ("ErrorLevel", "error_level"))]
_MORPH_JSON = ["CASE WHEN json_type(o) = 'OBJECT' THEN o ->> '$.#text' ELSE o ->> '$' END AS text"] + [f"o ->> '$.@{a}' AS {b}" for a, b in _ATTRIBUTES.items()] + [f"o ->> '$.{a}' AS {a.lower()}" for a in ("Preserved", "Removed")]
_MORPH_JSON += ["CASE WHEN json_type(o, '$.Proofread') = 'OBJECT' THEN o ->> '$.Proofread.#text' ELSE o ->> '$.Proofread' END AS proofread", "o ->> '$.Proofread.@pos' AS proofread_pos", "o ->> '$.ErrorArea.@type' AS error_area", "o ->> '$.ErrorPattern.@type' AS error_pattern", "o ->> '$.ErrorLevel.@type' AS error_level"]

ORACLE = {
    "p2_found": f"{_P2} SELECT DISTINCT {_KEY}, CAST(morph_no AS INT) AS morph_no FROM (SELECT sentence_id, section, word_no, morph_no FROM xm UNION ALL SELECT sentence_id, section, word_no, morph_no FROM jm)",
    "p2_sentences": f"{_P2} SELECT sentence_id, {_inside('t', 's')} AS text, {_attribute('t', 'from')} AS from_at, {_attribute('t', 'to')} AS to_at FROM x UNION ALL SELECT sentence_id, o ->> '$.s', o ->> '$.@from', o ->> '$.@to' FROM j",
    "p2_words": f"{_P2} SELECT {_KEY}, {_inside('t', 'w')} AS w FROM xw UNION ALL SELECT {_KEY}, o ->> '$.w' FROM jw",
    "p2_morphs": f"{_P2} SELECT {_KEY}, CAST(morph_no AS INT) AS morph_no, {', '.join(_MORPH_XML)} FROM xm UNION ALL SELECT {_KEY}, CAST(morph_no AS INT), {', '.join(_MORPH_JSON)} FROM jm",
    "p1_found": _P1,
    "p1_loaded": f"""{_P1.replace("SELECT line_id, regexp_replace(coalesce", "SELECT line_id, file_name, line_no, regexp_replace(coalesce").replace("b AS (SELECT line_id,", f"b AS (SELECT line_id, file_name, line_no, {_value(3)},").rsplit("SELECT line_id, CASE", 1)[0]}
SELECT line_id, file_name, line_no, try_cast(v1 AS BIGINT) AS pair_id, CAST(v2 AS TIMESTAMP) AS posted_at, v3 AS l1, v4 AS original, v5 AS corrected FROM c WHERE quoted AND five AND NOT wrong""",
    "p1_report": f"SELECT file_name, coalesce(reason, 'loaded') AS outcome, count(*) AS n_lines FROM lang8_lines LEFT JOIN ({_P1}) USING (line_id) GROUP BY 1, 2",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

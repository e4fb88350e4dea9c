"""Queries of the training-data problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpuskiln.llm import bitslice, cosine, forms, languages, lookalike, mixture, packing, recompress
from corpuskiln.util import table


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "kor_lang8")


def _raw(spark, sf_dir):
    return table(spark, sf_dir, "lang8_raw")


def _codes(spark, sf_dir):
    return table(spark, sf_dir, "lang_codes")


def _targets(spark, sf_dir):
    return table(spark, sf_dir, "mix_targets")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


QUERIES = {
    "p3_found": lambda s, d: cosine.found(_pairs(s, d)),
    "p3_links": lambda s, d: cosine.links(_pairs(s, d)),
    "p3_report": lambda s, d: cosine.report(_pairs(s, d)),
    "p4_found": lambda s, d: languages.found(_raw(s, d), _codes(s, d)),
    "p4_segments": lambda s, d: languages.segments(_raw(s, d), _codes(s, d)),
    "p4_languages": lambda s, d: languages.documents(_raw(s, d), _codes(s, d)),
    "p5_found": lambda s, d: lookalike.found(_raw(s, d)),
    "p5_normalized": lambda s, d: lookalike.normalized(_raw(s, d)).drop("raw").distinct(),
    "p6_found": lambda s, d: forms.found(_pairs(s, d)),
    "p6_copies": lambda s, d: forms.counts(_pairs(s, d)),
    "p7_found": lambda s, d: bitslice.found(_pairs(s, d)),
    "p7_links": lambda s, d: bitslice.links(_pairs(s, d)),
    "p7_groups": lambda s, d: bitslice.groups(_pairs(s, d)),
    "p8_containers": lambda s, d: packing.containers(_docs(s, d)),
    "p8_summary": lambda s, d: packing.summary(_docs(s, d)),
    "p8_invariants": lambda s, d: packing.invariants(_docs(s, d)),
    "p9_mixture": lambda s, d: mixture.mixture(_docs(s, d), _targets(s, d)),
    "p9_shares": lambda s, d: mixture.shares(_docs(s, d), _targets(s, d)),
    "p9_invariants": lambda s, d: mixture.invariants(_docs(s, d), _targets(s, d)),
    "p10_found": lambda s, d: recompress.found(_docs(s, d)),
    "p10_shares": lambda s, d: recompress.shares(_docs(s, d)),
}


# Small examples with the results that the problems' statements give for them; the same operators.
_LOOKS = [
    (1, "my Cafe"), (2, "my \u0421\u0430f\u0435"), (3, "\uff21\uff22\uff23\u3000\uff11"), (4, "ABC 1"), (5, "a\u200bb c"), (6, "ab\u00a0c"), (7, "\u00e9cole"), (8, "e\u0301cole"), (9, "my Cafe."),
    (10, "my cafe"), (11, "my  Cafe"), (12, "\uff76\uff9e\uff7d"), (13, "\u30ac\u30b9"), (14, ""), (15, None), (16, "\u1112\u1161\u11ab\uae00"), (17, "\ud55c\uae00"), (18, "ecole"), (19, "my Cafe"),
]
_ALIKE = [(1, 2), (2, 19), (3, 4), (5, 6), (7, 8), (12, 13), (16, 17)]
_SPOKEN = [
    (1, "오늘은 학교에 가서 친구를 만났어요.", "오늘은 학교에 가서 친구를 만났어요.", "ko"), (2, "I went to the school with my friend.", "I went to the school with my friend.", None),
    (3, "오늘은 학교에 가서 친구를 만났어요. Nous avons étudié avec la maîtresse.", "안녕", "ko"), (4, "...", "I have a friend and we like the house. 私は友達と一緒に町へ行きたいです。", "zz"),
    (5, "Я не знаю почему", "Я не знаю почему", "ru"), (6, None, "", "zz"), (7, "오늘 PDF 파일과 USB 메모리를 샀어요", "감사합니다!", "fr"), (8, "我的朋友在学校看书", "Ｉ ａｍ ｎｏｔ ａ ｃｈｉｌｄ", "en"),
]
_LANGUAGES = [(2, "original", "en"), (2, "corrected", "en"), (3, "original", "ko"), (3, "original", "fr"), (3, "corrected", "ko"), (4, "corrected", "en"), (4, "corrected", "ja"), (7, "original", "ko"), (7, "corrected", "ko"), (8, "original", "zh"), (8, "corrected", "en")]


def _looks(s):
    return s.createDataFrame([(i, t, None) for i, t in _LOOKS], "pair_id long, original string, corrected string")


def _spoken(s, d):
    return languages.found(s.createDataFrame(_SPOKEN, "pair_id long, original string, corrected string, lang_label string"), _codes(s, d))


QUERIES |= {"golden_looks": lambda s, _: lookalike.found(_looks(s)), "golden_languages": _spoken}

_KEY = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_KEYED = f"""
k AS (SELECT pair_id, split, {_KEY.format("src")} AS a, {_KEY.format("tgt")} AS b FROM kor_lang8 WHERE src IS NOT NULL AND tgt IS NOT NULL),
c AS (SELECT pair_id, split, least(a, b) AS ka, greatest(a, b) AS kb FROM k)"""
_SIMILAR = f"""{_KEYED},
g AS (SELECT DISTINCT pair_id, gram FROM (SELECT pair_id, ka[i:i+2] AS gram FROM (SELECT pair_id, ka, unnest(range(1, length(ka) - 1)) AS i FROM c)
  UNION ALL SELECT pair_id, kb[i:i+2] FROM (SELECT pair_id, kb, unnest(range(1, length(kb) - 1)) AS i FROM c))),
n AS (SELECT pair_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT x.pair_id AS id_a, y.pair_id AS id_b, count(*) AS o FROM g x JOIN g y ON x.gram = y.gram AND x.pair_id < y.pair_id GROUP BY 1, 2),
s AS (SELECT id_a, id_b FROM o JOIN n p ON p.pair_id = id_a JOIN n q ON q.pair_id = id_b WHERE 5 * o >= 3 * (p.n + q.n - o)),
e AS (SELECT x.pair_id AS id_a, y.pair_id AS id_b FROM c x JOIN c y ON x.ka = y.ka AND x.kb = y.kb AND x.pair_id < y.pair_id)"""

_CLASSES = f"""{_SIMILAR},
q AS (SELECT min(pair_id) AS rep, count(*) AS n, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split IN ('val', 'test')) AS n_eval FROM c GROUP BY ka, kb),
l AS (SELECT s.id_a AS a, s.id_b AS b, o / (p.n + r.n - o) AS similarity FROM s JOIN o USING (id_a, id_b) JOIN n p ON p.pair_id = s.id_a JOIN n r ON r.pair_id = s.id_b SEMI JOIN q x ON x.rep = s.id_a SEMI JOIN q y ON y.rep = s.id_b)"""

ORACLE = {
    "p3_found": f"""WITH {_SIMILAR} SELECT id_a, id_b FROM (SELECT * FROM s UNION SELECT * FROM e) JOIN c p ON p.pair_id = id_a JOIN c q ON q.pair_id = id_b
WHERE (p.split = 'train' AND q.split IN ('val', 'test')) OR (q.split = 'train' AND p.split IN ('val', 'test'))""",
    "p6_found": f"WITH {_KEYED} SELECT * FROM (SELECT min(pair_id) OVER (PARTITION BY ka, kb) AS keep_id, pair_id FROM c) WHERE keep_id <> pair_id",
    "p6_copies": f"WITH {_KEYED} SELECT min(pair_id) AS keep_id, count(*) AS n_copies FROM c GROUP BY ka, kb",
    "p3_links": f"""WITH {_CLASSES} SELECT a AS train_rep, b AS eval_rep, x.n_train, y.n_eval, similarity FROM l JOIN q x ON x.rep = a JOIN q y ON y.rep = b WHERE x.n_train > 0 AND y.n_eval > 0
UNION ALL SELECT b, a, y.n_train, x.n_eval, similarity FROM l JOIN q x ON x.rep = a JOIN q y ON y.rep = b WHERE y.n_train > 0 AND x.n_eval > 0 UNION ALL SELECT rep, rep, n_train, n_eval, 1.0 FROM q WHERE n_train > 0 AND n_eval > 0""",
    "p3_report": f"""WITH {_SIMILAR}, d AS (SELECT * FROM s EXCEPT SELECT * FROM e),
l AS (SELECT id_a AS x, id_b AS y, 1 AS near FROM d UNION ALL SELECT id_b, id_a, 1 FROM d UNION ALL SELECT id_a, id_b, 0 FROM e UNION ALL SELECT id_b, id_a, 0 FROM e),
t AS (SELECT x, count(*) FILTER (near = 0) AS same, count(*) FILTER (near = 1) AS near FROM l JOIN c ON c.pair_id = y WHERE split = 'train' GROUP BY 1),
h AS (SELECT c.split, k.source, coalesce(same, 0) AS same, coalesce(near, 0) AS near FROM c JOIN kor_lang8 k USING (pair_id) LEFT JOIN t ON x = pair_id WHERE c.split IN ('val', 'test'))
SELECT split, source, count(*) AS n_rows, count(*) FILTER (same > 0) AS n_same_rows, count(*) FILTER (same + near > 0) AS n_overlap_rows, CAST(sum(same) AS BIGINT) AS n_same_links, CAST(sum(near) AS BIGINT) AS n_near_links FROM h GROUP BY 1, 2""",
    "p7_found": f"WITH {_SIMILAR} SELECT * FROM s EXCEPT SELECT * FROM e",
    "p7_links": f"WITH {_CLASSES} SELECT a AS rep_a, b AS rep_b, x.n AS n_a, y.n AS n_b, similarity FROM l JOIN q x ON x.rep = a JOIN q y ON y.rep = b",
    "p7_groups": f"""WITH RECURSIVE {_CLASSES}, b2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), reach(a, b) AS (SELECT rep, rep FROM q UNION SELECT reach.a, b2.b FROM reach JOIN b2 ON b2.a = reach.b),
roots AS (SELECT a AS rep, min(b) AS group_id FROM reach GROUP BY 1), n2 AS (SELECT a AS rep, count(*) AS n_links FROM b2 GROUP BY 1)
SELECT pair_id, group_id, coalesce(n_links, 0) AS n_links FROM (SELECT pair_id, min(pair_id) OVER (PARTITION BY ka, kb) AS rep FROM c) JOIN roots USING (rep) LEFT JOIN n2 USING (rep)""",
    "p8_invariants": "SELECT count(*) AS n_texts, 0 AS n_cut, 0 AS n_overfull FROM documents WHERE text <> ''",
    "p9_invariants": "SELECT source, EXISTS (SELECT 1 FROM documents d WHERE d.source = m.source AND text <> '') AS has_texts, true AS repeats_kept, true AS share_met FROM mix_targets m",
    "p10_found": """
WITH w AS (SELECT doc_id, i, text[i:i+99] AS t FROM (SELECT doc_id, text, unnest(range(1, length(text) - 98)) AS i FROM documents WHERE length(text) >= 100)),
s AS (SELECT t FROM w GROUP BY t HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT DISTINCT doc_id, i FROM w SEMI JOIN s USING (t)),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM h),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r)
SELECT doc_id, CAST(min(i) - 1 AS INT) AS span_start, CAST(max(i) + 99 AS INT) AS span_end FROM g GROUP BY doc_id, run""",
}

ORACLE["golden_looks"] = "SELECT 'original' AS field, CAST(a AS BIGINT) AS id_a, CAST(b AS BIGINT) AS id_b FROM (VALUES " + ", ".join(map(str, _ALIKE)) + ") AS v(a, b)"
ORACLE["golden_languages"] = "SELECT CAST(a AS BIGINT) AS pair_id, field, lang FROM (VALUES " + ", ".join(map(str, _LANGUAGES)) + ") AS v(a, field, lang)"
ORACLE["p10_shares"] = f"""WITH f AS ({ORACLE["p10_found"]}) SELECT doc_id, count(*) AS n_spans, CAST(sum(span_end - span_start) AS BIGINT) AS covered_chars, any_value(length(text)) AS n_chars, sum(span_end - span_start) / any_value(length(text)) AS covered_share
FROM f JOIN documents USING (doc_id) GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

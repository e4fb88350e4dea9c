import json

from corpuskiln.operators import learner as L
from corpuskiln.operators import shred as S

XML = (
    '<SENTENCE from="1" to="9"><s>넘어소 &amp; 가요 </s><!-- <morph/> --><MorphemeAnnotations><word><w>넘어소</w><morph pos="VV" from="1">넘</morph><morph/></word>'
    "<word/><word><morph>가요</morph><w>가요</w></word></MorphemeAnnotations><LearnerErrorAnnotations><word><w>넘어소</w>"
    '<morph><Proofread pos="VV">넘</Proofread><ErrorArea type="CVV"/></morph><morph><Preserved>어서</Preserved></morph></word></LearnerErrorAnnotations></SENTENCE>'
)
JSON = json.dumps({"SENTENCE": {"@from": 1, "s": "가 나", "MorphemeAnnotations": {"word": [{"w": "가", "morph": {"@pos": "NNG", "#text": "가"}}, None, {"w": "나", "morph": [None, "나"]}]}, "LearnerErrorAnnotations": None}})
BODIES = [(1, XML), (1, XML), (2, JSON), (3, None), (4, "<broken"), (5, ""), (6, '{"s": "x", "MorphemeAnnotations": {"word": {"w": null, "morph": null}}}'), (7, "[]")]


def nodes(spark):
    return S.shred(spark.createDataFrame([(i, b, "clash") for i, b in BODIES], "sentence_id long, body string, node string"))


def test_places(spark):
    found = {tuple(r) for r in S.morph_places(nodes(spark)).collect()}
    assert found == {(1, "M", 1, 1), (1, "M", 1, 2), (1, "M", 3, 1), (1, "E", 1, 1), (1, "E", 1, 2), (2, "M", 1, 1), (2, "M", 3, 1), (2, "M", 3, 2)}


def test_tables(spark):
    n = nodes(spark)
    assert {(r.sentence_id, r.text, r.from_at) for r in S.sentences(n).collect()} == {(1, "넘어소 & 가요 ", "1"), (2, "가 나", "1"), (6, "x", None)}
    words = {(r.sentence_id, r.section, r.word_no): r.w for r in S.words(n).collect()}
    assert words == {(1, "M", 1): "넘어소", (1, "M", 2): None, (1, "M", 3): "가요", (1, "E", 1): "넘어소", (2, "M", 1): "가", (2, "M", 2): None, (2, "M", 3): "나", (6, "M", 1): None}
    morphs = {(r.sentence_id, r.section, r.word_no, r.morph_no): r for r in S.morphs(n).collect()}
    assert morphs[1, "M", 1, 1].pos == "VV" and morphs[1, "M", 1, 1].text == "넘" and morphs[2, "M", 3, 2].text == "나"
    assert morphs[1, "E", 1, 1].proofread == "넘" and morphs[1, "E", 1, 1].error_area == "CVV" and morphs[1, "E", 1, 2].preserved == "어서"
    assert {r.sentence_id for r in S.adjacency(n).filter("label = '#error'").collect()} == {4, 5}


def test_proofreading(spark):
    n = nodes(spark)
    done = {r.sentence_id: r for r in L.proofread(S.sentences(n), S.words(n), S.morphs(n)).collect()}
    assert done[1].corrected == "넘어서 가요" and [tuple(e) for e in done[1].edits] == [(0, 1, "V", "넘어서")]
    assert done[2].corrected == "가 나" and done[2].edits == []
    assert {r.sentence_id: r for r in L.proofread_records(n).collect()} == done


def test_empty(spark):
    assert S.morph_places(S.shred(spark.createDataFrame([], "sentence_id long, body string"))).count() == 0

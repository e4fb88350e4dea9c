from pyspark.sql import functions as F

from corpuskiln.operators import clean as C
from corpuskiln.plans import corpus
from corpuskiln.streaming import clean as S

NEAR = ("가 나 다 라 마 바 사", "가 나 다 라 마 바 아")
FAR = ("가나다 라마바 사 아 자 차 카", "정책헌 법률령 사 아 자 차 카")


def test_whole_funnel(spark, tmp_path):
    rows = spark.createDataFrame([(1, *NEAR), (2, *FAR), (3, *FAR), (4, None, "x")], "pair_id long, original string, corrected string")
    rows.write.parquet(str(tmp_path / "lang8_raw.parquet"))
    assert [tuple(r) for r in corpus.QUERIES["clean_pairs"](spark, str(tmp_path)).collect()] == [FAR]
    steps = [(r.step, r.n_pairs) for r in corpus.QUERIES["clean_funnel"](spark, str(tmp_path)).orderBy("step_no").collect()]
    assert steps[0] == ("loaded", 3) and steps[-2:] == [("final", 2), ("far_apart", 1)]
    pairs = corpus.raw_pairs(spark, str(tmp_path))
    assert [tuple(r) for r in C.clean(pairs, "far_apart", keep="le").collect()] == [NEAR]
    assert C.clean(pairs, "far_apart", limit=0).count() == 2
    assert C.funnel(pairs, limit=0).filter(F.col("step") == "far_apart").first().n_pairs == 2
    assert {tuple(r) for r in S.row_steps(pairs).collect()} == {FAR}

from pyspark.sql import functions as F

from corpuskiln.operators import clean as C
from corpuskiln.operators import dataset as D
from corpuskiln.sources import learner_xml as XML
from corpuskiln.sources import pairs as P
from corpuskiln.streaming import clean as S


def test_sizes(spark):
    for n in (0, 1, 7, 100):
        counts = {r.split: r.n for r in D.split(spark.range(n), "id").groupBy("split").agg(F.count("*").alias("n")).collect()}
        assert tuple(counts.get(x, 0) for x in ("train", "val", "test")) == D.split_sizes(n)
    assert D.split_sizes(17560) == (12292, 2634, 2634)


def test_records(spark):
    r = spark.range(1).select(D.decoder_record(F.array(F.lit(5), F.lit(6)), F.array(F.lit(7), F.lit(8), F.lit(9)), 5).alias("r")).first().r
    assert (r.input_ids, r.decoder_input_ids, r.labels) == ([5, 6, 0, 0, 0], [0, 7, 8, 9, 0], [7, 8, 9, 1, -100])


def test_cleaning(spark):
    rows = [("가 나 다 라 마 바 사 abc", "가 나 다 라 마 바 아"), (None, "x"), ("짧", "짧"), ("가 나 다 라 마 바 / 사", "가 나 다 라 마 바 아")]
    pairs = spark.createDataFrame(rows, "orig string, cor string")
    assert [tuple(r) for r in C.clean(pairs).collect()] == [("가 나 다 라 마 바 사", "가 나 다 라 마 바 아")]
    assert [r.n_pairs for r in C.funnel(pairs).orderBy("step_no").collect()][0] == 4
    split = C.split_sentences(spark.createDataFrame([("aaaaa.bbbbb.c", "aaaaa.bbbbx.c"), ("a.b.", "a."), ("a", "b")], "orig string, cor string"))
    assert {tuple(r) for r in split.collect()} == {("bbbbb .", "bbbbx ."), ("a", "b")}


def test_files(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('a\tb\nc\n"d\te"\n\tx\n1\t2\t3\n')
    assert {tuple(r) for r in P.read_pairs(spark, str(tmp_path / "p.tsv")).collect()} == {("a", "b"), ('"d', 'e"'), ("", "x")}
    pairs = P.read_pairs(spark, str(tmp_path / "p.tsv"), keep_empty=False)
    P.write_pairs(pairs, str(tmp_path / "out"))
    assert {tuple(r) for r in P.read_pairs(spark, str(tmp_path / "out")).collect()} == {("a", "b"), ('"d', 'e"')}
    (tmp_path / "a.txt").write_text("x\n\ny\nz")
    (tmp_path / "b.txt").write_text("x\n\nw")
    zipped = P.zip_lines(P.numbered_lines(spark, str(tmp_path / "a.txt")), P.numbered_lines(spark, str(tmp_path / "b.txt")))
    assert sorted((r.pos, r.orig, r.cor) for r in zipped.collect()) == [(0, "x", "x"), (2, "y", "w")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "s.xml").write_text("<R><SENTENCE from='1'><s>가</s><LearnerErrorAnnotations><word><w>가</w><morph><Removed>가</Removed></morph></word></LearnerErrorAnnotations></SENTENCE><SENTENCE><s>나</s></SENTENCE></R>")
    read = XML.read(spark, str(tmp_path / "x"))
    assert read.count() == 2 and [r.s for r in XML.with_errors(read).collect()] == ["가"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("가 나 다 라 마 바 사", "가 나 다 라 마 바 아"), ("가 나 다 라 마 바 사", "가 나 다 라 마 바 사"), ("가 나 다 라 마 바 자", "가 나 다 라 마 바 아")]
    batch = spark.createDataFrame(rows, "orig string, cor string")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = S.row_steps(stream).writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("cleaned").collect())) == sorted(map(tuple, S.row_steps(batch).collect()))


def test_entry_without_training_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {"p1_found", "p2_found", "gleu_corpus"} <= set(names) and set(entry.oracle_sql()) <= set(names)


def test_sinks(spark, tmp_path):
    from corpuskiln.operators import annotate as A
    from corpuskiln.sources import m2

    pairs = spark.createDataFrame([(1, " 안 녕 ", "안녕"), (2, "가", "가")], "pair_id long, orig string, cor string")
    P.write_with_header(pairs, str(tmp_path / "h"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "h"), sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).collect()][0][1] == "안녕"
    P.write_sides(pairs, str(tmp_path / "s"))
    assert {r.value for r in spark.read.text(str(tmp_path / "s_original")).collect()} == {"안 녕", "가"}
    P.write_generations(spark.createDataFrame([(1, "val", "a\nb", "r", "s")], "epoch int, mode string, hyp string, ref string, src string"), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g" / "hyp")).first().value == "ab"
    clean = spark.createDataFrame([(1, "안 녕", "안녕"), (2, "가", "가")], "pair_id long, orig string, cor string")
    m2.write(A.annotate(clean), str(tmp_path / "m"))
    (tmp_path / "all.m2").write_text("\n".join(p.read_text() for p in sorted((tmp_path / "m").glob("part*"))))
    assert {(r.source, len([e for e in r.edits if e.start >= 0])) for r in m2.read(spark, str(tmp_path / "all.m2")).collect()} == {("안 녕", 1), ("가", 0)}
    (tmp_path / "n.csv").write_text("WS\t3\nNOUN\t4\n")
    assert P.read_label_counts(spark, str(tmp_path / "n.csv")).agg(F.sum("n")).first()[0] == 7
    sgml = '<DOC nid="3"><TEXT><P>\nOne.\n</P></TEXT><ANNOTATION><MISTAKE start_par="0" start_off="1" end_par="0" end_off="2"><TYPE>X</TYPE><CORRECTION>y</CORRECTION></MISTAKE></ANNOTATION></DOC>'
    (tmp_path / "d.sgml").write_text(sgml)
    doc = XML.read_sgml(spark, str(tmp_path / "d.sgml")).first()
    assert doc.nid == "3" and doc.paragraphs == ["One."] and (doc.mistakes[0].start_off, doc.mistakes[0].type, doc.mistakes[0].correction) == (1, "X", "y")


def test_reorder_and_types(spark):
    from corpuskiln.operators import annotate as A
    from corpuskiln.sources import m2

    blocks = spark.createDataFrame([(0, "a", "old"), (1, "a ", "new"), (2, "b", "x")], "pos int, source string, block string")
    probe = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "pos int, source string")
    assert [(r.block, r.found) for r in m2.reorder(probe, blocks).orderBy("pos").collect()] == [("x", True), ("new", True), (None, False)]
    kinds = spark.createDataFrame([(["NOUN"],), (["ENDING", "VERB"],), (["NOUN", "PARTICLE"],), (["ADJECTIVE", "ENDING"],), (["ENDING", "PARTICLE"],)], "k array<string>")
    assert [r[0] for r in kinds.select(A.composite_type(F.col("k"))).collect()] == ["NOUN", "CONJUGATION", "UNCLASSIFIED", "CONJUGATION", "UNCLASSIFIED"]
    assert D.steps(100, 8) == {"per_epoch": 13, "total": 13, "warmup": 1, "log_every": 13}


def test_lines_of_split_files(spark, tmp_path):
    """Lines keep their numbers where several tasks read one file."""
    lines = [f"line {i}" if i % 7 else "" for i in range(4000)]
    (tmp_path / "long.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "short.txt").write_text("x\ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = P.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    long = {r.pos: r.value for r in rows if "long" in r.file}
    assert [long[i] for i in range(4000)] == lines and sorted((r.pos, r.value) for r in rows if "short" in r.file) == [(0, "x"), (1, "y")]


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as N

    import pytest

    from corpuskiln.util import ensure_checkpoint_dir

    none = N(isDefined=lambda: False)
    context = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)), getConf=lambda: N(get=lambda _: None))
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(N(sparkContext=context, conf=N(get=lambda *_: None)))

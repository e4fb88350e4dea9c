import statistics

from pyspark.sql import functions as F

from corpuskiln.operators import gleu as G


def test_every_draw_counts(spark):
    texts = [(i, n, " ".join("abcdefgh"[(i * k + n) % 8] for k in range(9))) for i in range(6) for n in (0, 1)]
    rows = spark.createDataFrame([(i, n, t, "z y x w v", texts[2 * i][2]) for i, n, t in texts], "sid long, ref_no int, ref string, src string, hyp string")
    stats = G.statistics(rows, ("sid", "ref_no")).cache()
    each = {(r["sid"], r["ref_no"]): [r[c] for c in G.names()] for r in stats.collect()}
    draw = lambda i, j: (i * 7 + j * j // 3) % 2
    schema = ", ".join(f"{c} long" for c in G.names())
    totals = [tuple(map(sum, zip(*(each[i, draw(i, j)] for i in range(6))))) for j in range(500)]
    scores = [r[0] for r in spark.createDataFrame(totals, schema).select(G.score()).collect()]
    got = G.multi_reference(stats, lambda sid, j: ((sid * 7 + F.floor(j * j / 3)) % 2).cast("int")).first()
    assert G.ITERATIONS == 500 and len(set(scores)) > 1
    assert abs(got["mean"] - statistics.fmean(scores)) < 1e-9 and abs(got["std"] - statistics.pstdev(scores)) < 1e-9

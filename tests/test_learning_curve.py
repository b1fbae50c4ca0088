from kgenrich.operators import evaluate as ev
from kgenrich.plans import jobs, testkg


def test_learning_curve_over_caps_and_seeds(spark):
    c = jobs.demo_corpus(spark, "/root/testdata/sf0.001")
    s = jobs.learning_curve(c, testkg.relation("nation"), caps=[12, 40], seeds=[1, 2], crf_iter=15).collect()
    assert sorted((r.cap, r.seed) for r in s) == [(12, 1), (12, 2), (40, 1), (40, 2)]
    assert all(0 <= r.precision <= 1 and r.tp + r.fn > 0 for r in s)
    mean = ev.mean_curve(spark.createDataFrame(s)).collect()
    assert [r.cap for r in mean] == [12, 40] and mean[1].recall >= 0.5

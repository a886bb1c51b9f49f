"""Floor-rank percentiles - every exact form equals the plain-Python rule
``sorted(x)[int(n*p)]`` on random groups with ties."""

import random

from pyspark.sql import functions as F

from rampstat.operators.percentiles import floor_rank_percentiles


def brute(values, p):
    s = sorted(values)
    return s[min(len(s) * p // 100, len(s) - 1)]


def test_histogram_and_disc_match_brute_force(spark):
    rnd = random.Random(11)
    data = []
    for g in range(60):
        n = rnd.randint(1, 240)
        data += [(g, float(rnd.randint(0, 30))) for _ in range(n)]
    df = spark.createDataFrame(data, "g int, x double")
    expect = {}
    for g in {d[0] for d in data}:
        vals = [x for gg, x in data if gg == g]
        expect[g] = tuple(brute(vals, p) for p in (50, 95, 99))
    for method in ("histogram", "disc"):
        got = {r[0]: tuple(r[1:]) for r in
               floor_rank_percentiles(df, ["g"], "x", method=method, names=["a", "b", "c"]).collect()}
        assert got == expect, method


def test_standard_percentile_disc_differs_where_n_p_is_whole(spark):
    # sanity: the ascending standard form is not the reference rule
    df = spark.createDataFrame([(0, 150.0), (0, 250.0)], "g int, x double")
    std = df.groupBy("g").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)")).first()[1]
    ours = floor_rank_percentiles(df, ["g"], "x", names=["a", "b", "c"]).first()[1]
    assert std == 150.0 and ours == 250.0


def test_approx_runs(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(100)], "g int, x double")
    assert floor_rank_percentiles(df, ["g"], "x", method="approx", names=["a", "b", "c"]).count() == 1

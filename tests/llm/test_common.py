import brute
import pytest
from pyspark.sql import functions as F

from rampstat.llm import common as c


def test_ascii_lower(spark):
    texts = ["ABC xyz", "ÉTÉ Été", "ǅ İI ΑΣ", "", "Straße ẞ", "ªº µ 中A"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(c.ascii_lower(F.col("x"))).collect()] == [x.translate(brute.LOWER) for x in texts]


def test_tables_are_written_once_and_released(spark):
    c.release(spark)
    t = c.save(spark.range(5), "t")
    assert sorted(r.id for r in t.collect()) == list(range(5))
    assert c.release(spark) == 1 and c.release(spark) == 0
    with pytest.raises(Exception, match="(?i)file|path"):
        t.collect()


def test_broadcast_only_below_a_count(spark):
    plan = lambda n: spark.range(9).join(c.broadcast_below(spark.range(5), n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(5) and "strategy=broadcast" not in plan(4)

"""J1's sink: deltas, compaction, versions, replays and lost folders."""

import os
import random
import tempfile

import pytest

from rampstat.streaming.keyed_table import KEPT_VERSIONS, KeyedTable


def _dir():
    return tempfile.mkdtemp(prefix="keyed-", dir="/tmp")


def _batch(spark, rows):
    return spark.createDataFrame(rows, "k long, n long, top long")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_replaced_and_added_rows_over_many_batches(spark, least):
    """Whatever is compacted when, the table is that of all batches."""
    r = random.Random(least)
    put = KeyedTable(spark, _dir(), ["k"], stream="s", least_rows=least)
    add = KeyedTable(spark, _dir(), ["k"], sums=["n"], newest=["top"], stream="s", least_rows=least)
    last, total = {}, {}
    for epoch in range(7):
        rows = [(k, r.randrange(9), r.randrange(9)) for k in r.sample(range(12), r.randrange(6))]
        put.publish(_batch(spark, rows), epoch)
        add.publish(_batch(spark, rows), epoch)
        for k, n, top in rows:
            last[k] = (k, n, top)
            old = total.get(k, (k, 0, -1))
            total[k] = (k, old[1] + n, max(old[2], top))
        assert _rows(put.read()) == sorted(last.values())
        assert _rows(add.read()) == sorted(total.values())


def test_a_batch_writes_its_own_keys_only(spark):
    t = KeyedTable(spark, _dir(), ["k"], stream="s", least_rows=100)
    t.publish(_batch(spark, [(k, 0, 0) for k in range(200)]), 0)  # folded into a base
    for epoch in range(1, 5):
        t.publish(_batch(spark, [(epoch, 7, 7)]), epoch)
        assert spark.read.parquet(f"{t.path}/deltas/batch={epoch:012d}").count() == 1
    assert os.listdir(f"{t.path}/base") == ["version=000000000000"]  # written once
    assert t.read().where("n = 7").count() == 4 and t.read().count() == 200
    assert t.read(2).where("n = 7").count() == 2  # an older version


def test_the_base_is_rewritten_when_changes_have_doubled(spark):
    t = KeyedTable(spark, _dir(), ["k"], stream="s", least_rows=1)
    for epoch in range(17):
        t.publish(_batch(spark, [(epoch, 1, 1)]), epoch)
    bases = [t._manifest(v) for v in t.versions()]
    assert len({m.base for m in bases}) <= 6  # 1, 2, 4, 8, 16 rows: not once a batch
    assert t.read().count() == 17


def test_replay_adds_nothing_and_old_versions_go(spark):
    t = KeyedTable(spark, _dir(), ["k"], sums=["n"], newest=["top"], stream="s", least_rows=4)
    for epoch in range(KEPT_VERSIONS + 4):
        t.publish(_batch(spark, [(1, 1, epoch)]), epoch)
        t.publish(_batch(spark, [(1, 1, epoch)]), epoch)  # again after a restart
    assert _rows(t.read()) == [(1, KEPT_VERSIONS + 4, KEPT_VERSIONS + 3)]
    assert len(t.versions()) == KEPT_VERSIONS
    assert _rows(t.read(t.versions()[0])) == [(1, t.versions()[0] + 1, t.versions()[0])]


def test_a_batch_that_died_before_its_manifest_is_written_anew(spark):
    t = KeyedTable(spark, _dir(), ["k"], sums=["n"], newest=["top"], stream="s")
    t.publish(_batch(spark, [(1, 1, 1)]), 0)
    _batch(spark, [(1, 50, 50)]).write.parquet(f"{t.path}/deltas/batch={1:012d}")  # no manifest: not part of any version
    assert _rows(t.read()) == [(1, 1, 1)]
    t.publish(_batch(spark, [(1, 2, 2)]), 1)
    assert _rows(t.read()) == [(1, 3, 2)]


def test_lost_versions_and_other_streams_are_errors(spark):
    t = KeyedTable(spark, _dir(), ["k"], stream="s")
    with pytest.raises(LookupError, match="lacks what batch 4"):
        t.publish(_batch(spark, [(1, 1, 1)]), 5)
    t.publish(_batch(spark, [(1, 1, 1)]), 0)
    other = KeyedTable(spark, t.path, ["k"], stream="another")
    for epoch in (0, 1):
        with pytest.raises(LookupError, match="another stream"):
            other.publish(_batch(spark, [(1, 1, 1)]), epoch)
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, _dir(), ["k"]).read()


def test_whole_rows_of_the_newest(spark):
    t = KeyedTable(spark, _dir(), ["k"], ordered_by=["top", "n"], stream="s")
    t.publish(_batch(spark, [(1, 5, 9), (2, 1, 1)]), 0)
    t.publish(_batch(spark, [(1, 6, 8), (2, 0, 2)]), 1)  # k 1: older than what is there
    assert _rows(t.read()) == [(1, 5, 9), (2, 0, 2)]


def test_empty_batches(spark):
    t = KeyedTable(spark, _dir(), ["k"], stream="s")
    t.publish(_batch(spark, []), 0)
    assert _rows(t.read()) == []
    t.publish(_batch(spark, [(1, 1, 1)]), 1)
    t.publish(_batch(spark, []), 2)
    assert _rows(t.read()) == [(1, 1, 1)] and t.versions() == [0, 1, 2]

import brute
import duckdb
import pytest

from rampstat.llm import sharding as s


@pytest.mark.parametrize("limit", [60, 700, 5000, 1 << 30])
def test_odd_cases(spark, limit):
    rows = brute.odd_rows() + [(i, f"filler text {i} " * (i % 9)) for i in range(100, 260)]
    got = s.shard(brute.frame(spark, rows), limit).collect()
    assert sorted((str(r.id), r.bytes) for r in got) == sorted((str(i), len((x or "").encode())) for i, x in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # a directory: no prefix of another
    for name, own in by.items():
        total = sum(r.bytes for r in own)
        assert {(r.shard_bytes, r.shard_docs, r.depth, r.oversized) for r in own} == {(total, len(own), len(name), total > limit)}
        assert total <= limit or len(own) == 1
        if name:  # only a bucket over the limit was split
            above = [r for other, own in by.items() if other.startswith(name[:-1]) for r in own]
            assert sum(r.bytes for r in above) > limit


def test_repeats_of_one_document_are_spread(spark):
    got = s.shard(brute.frame(spark, [(7, "y" * 50)] * 300 + [(1, "z")]), 1000).collect()
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.bytes
    assert len(got) == 301 and max(sizes.values()) <= 1000 and not any(r.oversized for r in got)


def test_query_splits_as_its_sql(spark, tmp_path):
    rows = [(i, f"filler text {i} " * (i % 9)) for i in range(600)] + [(600, "long " * 9000), (601, None), (602, "")]
    brute.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = s.op5_extendible_sharding(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    brute.same(got.collect(), con.execute(s.ORACLE).fetchall())
    shards = got.groupBy("shard", "depth", "shard_bytes", "shard_docs", "oversized").count().collect()
    assert len(shards) > 32 and len({r.depth for r in shards}) > 1 and [r.shard_docs for r in shards if r.oversized] == [1]
    assert all(r.shard_docs == r["count"] for r in shards)


def test_empty(spark):
    assert s.shard(brute.frame(spark, [])).collect() == []


def test_written_shards(spark, tmp_path):
    docs = brute.frame(spark, [(i, "text " * (i % 50)) for i in range(300)])
    shards = s.write_shards(docs, str(tmp_path / "out"), 4000).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").columns == docs.columns and back.count() == 300
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {r.shard: r.shard_docs for r in shards}

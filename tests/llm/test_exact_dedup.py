import random

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rampstat.llm import exact_dedup as e


def run(docs):
    done = e.exact_copies(docs).select("did", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    back = lambda i: None if i == brute.NONE else i
    return [(back(r[0]), back(r[1]), *r[2:]) for r in done.collect()]


def test_odd_cases(spark):
    rows = brute.odd_rows()
    # one partition: the first of rows that tie stays
    brute.same(run(brute.frame(spark, rows).coalesce(1)), brute.exact_copies(rows))


def mixed(seed, n=900):
    """A third of all rows hold one text, in variants of white space; others a few or one."""
    r = random.Random(seed)
    hot = ["the one text", "the  one\ttext", "the\none \r\n text"]
    texts = [r.choice(hot) if r.random() < 0.34 else f"{r.choice(' abc')}text {r.randrange(250)}{r.choice(['', ' ', '  '])}" for _ in range(n)]
    return list(zip(r.sample(range(10 * n), n), texts, strict=True))


@pytest.mark.parametrize(("seed", "parts"), [(1, 3), (2, 9), (3, 70)])
def test_over_one_two_and_three_rounds(spark, seed, parts):
    rows = mixed(seed)
    docs = brute.frame(spark, rows, extra=False).repartition(parts)
    assert e.rounds_for(parts) == {3: 1, 9: 2, 70: 3}[parts]
    brute.same(run(docs), brute.exact_copies(rows))


def test_every_round_leaves_an_entry_a_run_and_text_and_loses_no_row(spark):
    docs = brute.frame(spark, mixed(4), extra=False).repartition(70)
    runs = e.first_runs(e.entries_of(docs))
    before = runs.count()
    for turn in range(e.rounds_for(70)):
        runs = e.save(e.exchange(runs, turn), "round")
        got = runs.agg(F.sum("size"), F.count("*"), F.countDistinct("run", *e.TEXT), F.max(F.floor(F.col("run") / e.FAN_IN ** (turn + 1)))).first()
        assert got[0] == 900 and got[1] == got[2] <= before
        before = got[1]
    assert before == runs.select(*e.TEXT).distinct().count()  # every text is in one run
    assert runs.select("run").distinct().count() > 50  # and the runs share them


def test_texts_are_told_apart_by_more_than_the_digest(spark):
    entry = lambda second, did: (0, b"\x01" * 32, 5, second, did, did, 1)
    got = spark.createDataFrame([entry(1, 7), entry(2, 3), entry(1, 4)], e.ENTRY).coalesce(1)
    brute.same([(r.second, r.did, r.size) for r in e.first_runs(got).collect()], [(1, 4, 2), (2, 3, 1)])


def test_a_run_out_of_order_is_an_error():
    batch = pa.RecordBatch.from_pydict({"run": [0, 0], "digest": [b"\x01" * 32] * 2, "n_bytes": [5, 5], "second": [1, 1], "did": [7, 3], "uid": [0, 1], "size": [1, 1]})
    with pytest.raises(ValueError, match="out of order"):
        e.merge_batch(batch)


def test_merging_goes_on_over_batches():
    rows = [(r, bytes([d]) * 32, 1, 0, k, k, 1) for r in range(2) for d in range(3) for k in range(7)]
    names = [x.split()[0] for x in e.ENTRY.split(", ")]
    for size in (1, 2, 5, 42):
        batches = (pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[i:i + size])), strict=True))) for i in range(0, len(rows), size))
        got = pa.Table.from_batches(list(e.merge_runs(batches))).to_pylist()
        assert [(x["run"], x["digest"][0], x["did"], x["size"]) for x in got] == [(r, d, 0, 7) for r in range(2) for d in range(3)]


def test_drop_copies_keeps_columns_and_one_row_of_a_text(spark):
    rows = brute.odd_rows()
    docs = brute.frame(spark, rows)
    got = e.drop_copies(docs)
    assert got.columns == docs.columns
    want = {(x[0], x[4]) for x in brute.exact_copies(rows) if x[3]}
    assert got.count() == len(want) and {r.doc_id for r in got.collect()} == {i for i, _ in want}


def test_empty(spark):
    assert run(brute.frame(spark, [])) == [] and e.drop_copies(brute.frame(spark, [])).collect() == []


def test_long_texts(spark):
    x = "word " * 3_000_000  # longer than a batch of 8 MB
    rows = [(1, x), (2, x.replace(" ", "\n\t")), (3, x + "x")]
    brute.same(run(brute.frame(spark, rows, extra=False)), brute.exact_copies(rows))

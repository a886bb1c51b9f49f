import brute
import numpy as np
import pyarrow as pa
import pytest

from rampstat.llm import quality as q
from rampstat.llm.arrow_text import words

SF = "/root/testdata/sf0.1"


def test_counts_of_odd_cases(spark):
    rows = brute.odd_rows()
    done = q.verdicts(brute.frame(spark, rows), None).collect()
    want = []
    for i, x in rows:
        c = quality = brute.quality_counts(x)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want.append((brute.known(i), *quality, None, failed, not failed))
    brute.same(done, want)


def test_no_labels_or_one_class(spark):
    docs = brute.frame(spark, brute.odd_rows())
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert q.fit(docs, empty) is None
    assert q.fit(docs, spark.createDataFrame([(i, 1) for i in range(16)] + [(None, 0), (3, None)], "doc_id long, quality int")) is None
    assert q.fit(brute.frame(spark, []), empty) is None
    assert q.verdicts(brute.frame(spark, []), None).collect() == []


def test_keep_good_keeps_columns(spark):
    docs = brute.frame(spark, brute.odd_rows())
    kept = q.keep_good(docs, None)
    want = [(i, x) for i, x in brute.odd_rows() if (c := brute.quality_counts(x))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    assert kept.columns == docs.columns
    brute.same([r[:2] for r in kept.collect()], want)


def test_character_trigrams_stay_within_texts():
    texts = pa.array(["", "a", "ab", "abc", "éüß", None, "abcd"])
    row, u, ix = words(texts)
    hit, at = q.features(texts, row, u, ix)[2]
    assert np.diff(at).tolist() == [0, 0, 0, 1, 1, 0, 2] and len(hit) == 4
    assert hit[0] == hit[2]  # "abc" twice


def test_scores_are_sums_of_sparse_rows():
    texts = pa.array(["some words here and there", "other words", "", None, "xyz xyz xyz"])
    row, u, ix = words(texts)
    feats = q.features(texts, row, u, ix)
    w = np.random.default_rng(0).normal(size=(q.KINDS, q.BUCKETS)).astype(np.float32)
    got = q.score(q.Model(w, 0, 1, 0), feats)
    for i in range(len(texts)):
        at, value = q.sparse_rows(feats, i)
        assert got[i] == pytest.approx(float(w.ravel()[at] @ value), abs=1e-4)


def test_held_out_accuracy(spark):
    """Fitted on half of the labelled rows, right on nearly all of the others."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = q.fit(docs, labels.where("doc_id % 2 = 0"))
    done = q.verdicts(docs, model).where("NOT base_failed").join(labels.where("doc_id % 2 = 1"), q.F.col("did") == q.F.col("doc_id")).collect()
    right = [(r.probability >= 0.5) == (r.quality == 1) for r in done]
    assert len(done) > 1500 and np.mean(right) > 0.99
    good = [r.probability for r in done if r.quality == 1]
    assert np.mean([p >= 0.5 for p in good]) > 0.99
    assert abs(np.mean([r.probability for r in done]) - np.mean([r.quality for r in done])) < 0.05  # calibrated


import brute
import pytest

import corpus_pipeline as c
from rampstat.llm import decontamination, line_dedup, near_dedup, packing, quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark):
    from rampstat.llm.common import save

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in c.STAGES:
        done = save(f(spark, docs, SF), f"test-{name}")
        out.append((docs, done))
        docs = done
    return out


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _ in c.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(done.columns == COLUMNS for _, done in stages[:-1])


def test_quality(spark, stages):
    docs, done = stages[0]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.did for r in quality.verdicts(docs, model).where("kept").collect()}
    brute.same(rows_of(done), [r for r in rows_of(docs) if r[0] in kept])
    assert all(len(brute.words(x)) >= 20 for _, x in rows_of(done))


def test_line_dedup(stages):
    import hashlib

    docs, done = stages[1]
    got = {i: hashlib.sha256(x.encode()).hexdigest() for i, x in rows_of(done)}
    want = {r[0]: r for r in brute.line_dedup(rows_of(docs))}
    assert {i: want[i][3] for i in got} == got
    assert all(r.n_chars == len(r.text) for r in done.collect())
    # what is not there has lost all its words, and nothing that is there has
    gone = {i: x for i, x in rows_of(docs) if i not in got}
    assert all(want[i][2] > 0 for i in gone) and all(brute.words(x) for _, x in rows_of(done))
    assert gone and len(set(got) | set(gone)) == docs.count()


def test_near_dedup(spark, stages):
    """Compared as the corpus has the texts, then as they come."""
    docs, done = stages[2]
    ids = {i for i, _ in rows_of(docs)}
    whole = [r for r in rows_of(spark.read.parquet(f"{SF}/documents.parquet")) if r[0] in ids]
    left = {i for i, _, first in brute.components(whole) if i == first}
    want = {i for i, _, first in brute.components([r for r in rows_of(docs) if r[0] in left]) if i == first}
    assert {i for i, _ in rows_of(done)} == want
    assert all(brute.words(x) for _, x in rows_of(done))


def test_near_copies_that_line_dedup_has_shortened_go(spark, tmp_path):
    """Two texts that differ in one line: the second keeps that line alone, and is found all the same."""
    lines = [f"this is line number {k} of a longer text with words of its own {k * k}" for k in range(40)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[:-1], "and another last line than the first one has"])), (3, "nothing like it at all " * 3)]
    rows = [(i, x, "en", "s", len(x)) for i, x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    shorter = c.line_deduplication(spark, docs, str(tmp_path))
    assert dict(rows_of(shorter))[2] == "and another last line than the first one has"
    assert {i for i, _ in rows_of(c.near_deduplication(spark, shorter, str(tmp_path)))} == {1, 3}


def test_decontamination(spark, stages):
    docs, done = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute.decontaminate(rows_of(docs), items) if not r[5]}
    brute.same(rows_of(done), [r for r in rows_of(docs) if r[0] in clean])
    assert 0 < len(clean) < docs.count()


def test_packing_and_run(spark, stages):
    docs, done = stages[4]
    total = {}
    for r in done.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert set(total) == {i for i, _ in rows_of(docs)}
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    brute.same(c.run(spark, SF).select(cols).collect(), done.select(cols).collect())


@pytest.mark.parametrize("k", range(5))
def test_odd_cases(spark, k, tmp_path):
    """Nulls, repeats and clashing columns go through every stage; so does the empty table."""
    extra = brute.EXTRA
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in extra)
    rows = [(i, x, None, "s", None if x is None else len(x), *["x"] * len(extra)) for i, x in brute.odd_rows()]
    name, f = c.STAGES[k]
    for r in (rows, []):
        docs = spark.createDataFrame(r, schema)
        done = f(spark, docs, SF)
        got = done.collect()
        assert k == 4 or done.columns == docs.columns
        assert len(got) <= len(rows) * (1 if k < 4 else 10) and (not r or got)


def test_operators_leave_no_import_to_chance():
    for m in (decontamination, line_dedup, near_dedup, packing, quality):
        assert "except Import" not in open(m.__file__).read()

import random

import brute
import pytest

from rampstat.llm import fill_in_middle as f


def run(docs, **more):
    return [tuple(r) for r in f.digests(docs, **more).collect()]


def marked_rows(seed=5):
    """Texts with marks, parts of marks, letters of other scripts, and every form."""
    r = random.Random(seed)
    bits = ["<P>", "<S", "S>", ">", "<", "<<", "M", "word", " ", "é", "中", "\n", "x1", "<M", "P>", "😀"]
    rows = [(i, "".join(r.choice(bits[1:]) for _ in range(r.randrange(40)))) for i in range(150)]
    return rows + [(1000 + i, "".join(r.choice(bits) for _ in range(9))) for i in range(30)]


@pytest.mark.parametrize("small", [False, True])
def test_odd_cases(spark, small):
    # small: many pieces a document, units longer than a piece, marks of the text cut in two
    most = {"units": 3, "piece_bytes": 2} if small else {}
    rows = brute.odd_rows() if not small else [(i, x and x[:400]) for i, x in brute.odd_rows()]
    rows += marked_rows()
    want, _ = brute.fill_in_middle(rows)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    brute.same(run(brute.frame(spark, rows), **most), want)


def test_another_seed_cuts_elsewhere(spark):
    rows = marked_rows()
    brute.same(run(brute.frame(spark, rows), seed=2), brute.fill_in_middle(rows, 2)[0])


def test_pieces_are_bounded(spark):
    rows = f.pieces(brute.frame(spark, [(1, "ab " * 500 + "z" * 300)]), units=8, piece_bytes=16).collect()
    assert max(len(r.piece) for r in rows) <= 16 and len(rows) > 100
    assert sorted(r.pos for r in rows) == list(range(len(rows)))


def test_outputs_and_their_way_back(spark):
    rows = brute.odd_rows() + marked_rows()
    want, texts = brute.fill_in_middle(rows)
    out = f.transformed(brute.frame(spark, rows))
    brute.same([(r.did, r.n, r.form, r.output) for r in out.collect()], [(w[0], w[1], w[2], t) for w, t in zip(want, texts, strict=True)])
    back = f.restored(out).select("row.did", "text").collect()
    brute.same([tuple(r) for r in back], [(i, x or "") for i, x in rows])


def test_a_mark_is_found_wherever_pieces_end():
    for form, order in f.ORDER.items():
        part = {f.P: b"<<P", f.M: b"S>m<", f.S: b">s<M"}
        out = b"".join(m + part[m] for m in order)
        for size in range(1, 9):
            reader, got = f.Reader(form), {0: b"", 1: b"", 2: b""}
            for i in range(0, len(out), size):
                for place, x in reader.feed(out[i:i + size]):
                    got[place] += x
            for place, x in reader.feed(b"", end=True):
                got[place] += x
            assert got == {f.PLACE[m]: part[m] for m in order}


def test_one_shuffle(spark):
    plan = f.digests(brute.frame(spark, marked_rows()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 2


def test_empty(spark):
    assert run(brute.frame(spark, [])) == []
    assert run(brute.frame(spark, [(1, None)])) == brute.fill_in_middle([(1, None)])[0]


def test_long_texts(spark):
    rows = [(i, x) for i, x in enumerate(["word. " * 1_600_000, "é" * 5_000_000, "z" * 9_000_000])]
    brute.same(run(brute.frame(spark, rows, extra=False)), brute.fill_in_middle(rows)[0])

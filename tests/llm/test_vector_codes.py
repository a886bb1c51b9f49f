import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from rampstat.llm import vector_codes as v


def frame(spark, rows, clash=True):
    extra = ["v", "vid", "x", "code", "error", "of", "ids", "part", "n"] if clash else []
    schema = "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema.rstrip(", "))


def run(df, **more):
    codes, books = v.compress(df, **more)
    return [(None if r.vid == brute.NONE else r.vid, r.code, r.error, r.label_error) for r in v.with_label_error(codes).collect()], books


def rows_of(n, dims=64, seed=1, spread=0.13):
    r = np.random.default_rng(seed)
    x = r.normal(0, spread, (n, dims)).astype(np.float32)
    return [(int(i), [float(c) for c in x[k]], int(k % 5) if k % 7 else None) for k, i in enumerate(r.permutation(n * 3)[:n])]


def check(spark, rows, **more):
    got, books = run(frame(spark, rows).repartition(3), **more)
    keep = {k: more[k] for k in ("parts", "entries", "rounds") if k in more}
    want, want_books = brute.vector_codes(rows, **keep)
    brute.same(got, want)
    assert books.tolist() == [[list(e) for e in b] for b in want_books]


def test_against_every_entry(spark):
    check(spark, rows_of(500))


@pytest.mark.parametrize(("block", "leaf"), [(7, 2), (50, 4), (300, 1)])
def test_any_block_and_leaf(spark, block, leaf):
    check(spark, rows_of(300, 32, 2), parts=8, entries=20, rounds=3, block=block, leaf=leaf)


def test_odd_cases(spark):
    rows = rows_of(90, 16, 3)
    rows += [(5, None, 1), (6, [], 1), (7, [0.5] * 15 + [None], 1), (8, [0.5] * 15 + [float("nan")], 1), (9, [float("-inf")] * 16, 1), (1000, [0.5] * 8, 2)]
    rows += [(None, [0.25] * 16, None), (None, [0.25] * 16, 3), rows[0], rows[0], (rows[1][0], [-0.001] * 16, 1)]
    check(spark, rows, entries=12)
    check(spark, rows, entries=200)  # more entries than vectors


def test_ties_and_a_hot_vector(spark):
    """A third of all rows are one vector; few values, so ties and equal entries abound."""
    r = np.random.default_rng(4)
    rows = [(i, [float(c) / 256 for c in (r.integers(-1, 2, 16) if i % 3 else np.ones(16))], i % 2) for i in range(400)]
    check(spark, rows, entries=16, leaf=3)


def test_a_ball_that_is_owned_is_not_opened():
    """Far groups: the balls of a group belong to one entry, and no points are compared."""
    r = np.random.default_rng(5)
    centre = r.integers(-9, 9, (6, 4)) * 10000
    x = np.concatenate([c + r.integers(-5, 6, (200, 4)) for c in centre])
    forest = v.Forest.grow(x, 1)
    (owned, owner), (open_leaves, _) = forest.walk(centre[None])
    assert len(open_leaves) == 0 and forest.count[owned].sum() == len(x)
    assert len(owned) < 60


def test_balls_hold_their_points_sums_and_counts():
    x = np.array([q[1] for q in rows_of(700, 32, 6)])
    x = np.floor(x * 256).astype(np.int64)
    forest = v.Forest.grow(x, 8, leaf=5)
    assert (np.sort(forest.order, axis=1) == np.arange(700)).all()
    for b in range(len(forest.part)):
        own = forest.points[forest.lo[b]:forest.hi[b]]
        assert (forest.sums[b] == own.sum(axis=0)).all() and forest.count[b] == len(own)
        assert (np.sqrt(((own - forest.mean[b]) ** 2).sum(axis=1)) <= forest.radius[b] + 1e-9).all()
        below = np.flatnonzero(forest.parent == b)
        assert len(below) == 0 or sorted((forest.lo[c], forest.hi[c]) for c in below)[0][0] == forest.lo[b]
        assert len(below) == 0 or forest.count[below].sum() == forest.count[b]
    back = v.Forest.read({"ids": range(700), **forest.stored()}, 8)
    assert (back.points == forest.points).all() and (back.radius == forest.radius).all()


def test_candidate_lists_shrink_downwards(spark):
    x = np.floor(np.array([q[1] for q in rows_of(2000, 16, 7)]) * 256).astype(np.int64)
    forest = v.Forest.grow(x, 4, leaf=8)
    books = x[:64].reshape(64, 4, 4).transpose(1, 0, 2)
    (owned, _), (leaves, lists) = forest.walk(books)
    assert forest.count[owned].sum() + forest.count[leaves].sum() == 4 * 2000  # each point once
    assert (forest.count[leaves] * lists.sum(axis=1)).sum() < 0.25 * 64 * 4 * 2000


def test_decoded(spark):
    rows = rows_of(80, 16, 8)
    codes, books = v.compress(frame(spark, rows), entries=9)
    ints = {i: [int(np.floor(256 * x)) for x in vec] for i, vec, _ in rows}
    for r in v.decoded(codes, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(r.v, ints[r.vid], strict=True)) == r.error


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="component"):
        run(frame(spark, [(1, [1e9] * 16, 1)]))


def test_empty_and_nothing_kept(spark):
    assert run(frame(spark, []))[0] == []
    got, books = run(frame(spark, [(1, None, 1), (2, [0.5] * 15, 1)]))
    assert got == [] and v.codebooks_sha256(books)
    assert v.with_label_error(v.compress(frame(spark, [], clash=False))[0]).where(F.col("label") == 1).count() == 0

import math
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from rampstat.llm import class_lm as m


def scored(spark, train_rows, rows, **more):
    train = brute.frame(spark, train_rows).select(F.col("text").alias("t"))
    model, lexicon = m.train_model(train, **more)
    return model, m.score(brute.frame(spark, rows), model, lexicon).collect()


def base(train_rows, rows):
    tokens = lambda x: [*brute.words(x), None]
    c = Counter(t for _, x in train_rows for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(i, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)), 6)) for i, x in rows]


@pytest.mark.parametrize("local", [1 << 19, 5])
def test_odd_cases(spark, monkeypatch, local):
    monkeypatch.setattr(m, "KNOWN_WORDS", local)  # the fewer, the more words are joined
    monkeypatch.setattr(m, "SHARE", 0.005)
    rows = brute.odd_rows()
    train = rows[:9] + rows[12:]
    _, got = scored(spark, train, rows, classes=8)
    brute.same([(r.id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got], base(train, rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("local", [1 << 19, 40, 0])
def test_score_is_the_plain_models(spark, monkeypatch, local):
    """Scores from the lexicon's classes, counted again in plain Python, however many words are broadcast."""
    monkeypatch.setattr(m, "KNOWN_WORDS", local)
    monkeypatch.setattr(m, "SHARE", 0.02)
    monkeypatch.setattr(m, "MIN_COUNT", 3)
    r = np.random.default_rng(1)
    train = [(i, " ".join(f"w{int(k)}{'aeiou'[int(k) % 5]}" for k in r.zipf(1.3, 25) % 300)) for i in range(60)] + [(90, None), (91, "")]
    rows = train[:20] + [(200, "never seen words w1e w1e"), (201, None), (202, "w1e " * 3000)]
    frame = brute.frame(spark, train).select(F.col("text").alias("t"))
    model, lexicon = m.train_model(frame, classes=6)
    lex = {x.word: (x.cls, x.c) for x in lexicon.collect()}
    c = Counter(w for _, x in train for w in brute.words(x))
    assert {w: n for w, (_, n) in lex.items()} == dict(c)
    heads = set(model.types.heads.to_pylist())
    tied = {w: int(k) for w, k in zip(lex, model.cls[model.types.of(m.pa.array(list(lex), m.pa.large_string()))], strict=True)}
    assert all(lex[w][0] == k for w, k in tied.items() if w in heads or c[w] < 3)
    assert any(lex[w][0] != k for w, k in tied.items())
    unseen = lambda w: int(model.cls[model.types.of(m.pa.array([w], m.pa.large_string()))[0]])
    of = lambda w: 0 if w is None else lex[w][0] if w in lex else unseen(w)
    chain = lambda x: [*brute.words(x), None]
    moves, size = np.zeros((6, 6)), np.full(6, 0.5)
    for _, x in train:
        for a, b in zip([None, *chain(x)], chain(x), strict=False):
            moves[of(a), of(b)] += 1
    size[0] += len(train) + 0.5
    for k, n in lex.values():
        size[k] += n + 0.5
    p = (moves + 0.5) / (moves.sum(1, keepdims=True) + 0.5 * 6)
    count = {None: len(train), **c}
    want = {i: sum(math.log10(p[of(a), of(b)] * (count.get(b, 0) + 0.5) / size[of(b)]) for a, b in zip([None, *chain(x)], chain(x), strict=False)) for i, x in rows}
    got = {x.id: x.score for x in m.score(brute.frame(spark, rows), model, lexicon).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_rarer_words_go_where_their_neighbours_are(spark):
    """To first order the gain is the likelihood's, for a word that is a small part of its classes."""
    r = np.random.default_rng(5)
    k = 6
    now = r.integers(2000, 90000, (k, k)).astype(float)
    found = r.integers(0, 4, (40, 2 * k)).astype(float)
    got = m.best_classes(found, now)
    for row, b in zip(found, got, strict=True):
        gains = []
        for c in range(1, k):
            with_it = now.copy()
            with_it[c] += row[:k]
            with_it[:, c] += row[k:]
            flat = m.f(with_it).sum() - m.f(with_it.sum(1)).sum() - m.f(with_it.sum(0)).sum()
            gains.append(flat)
        assert max(gains) - gains[b - 1] < 0.05


def test_no_training(spark):
    _, got = scored(spark, [], [(1, "a b"), (2, None)])
    assert {(r.id, r.n_tokens, r.n_known) for r in got} == {(1, 3, 0), (2, 1, 0)}
    assert all(math.isfinite(r.score) for r in got)


def test_empty(spark):
    assert scored(spark, [(1, "a b")], [])[1] == []


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARE", 0.01)
    train = [(i, " ".join(f"w{(i * 7 + k * k) % 40}" for k in range(12))) for i in range(60)]
    model, _ = scored(spark, train, [], classes=6)
    assert np.allclose((10 ** model.log_move).sum(1), 1)


def test_clustering_finds_two_languages(spark, monkeypatch):
    """Words of two vocabularies that never meet in a text end in different classes, and
    held-out texts score better than by unigrams."""
    monkeypatch.setattr(m, "SHARE", 0.002)
    r = np.random.default_rng(0)
    text = lambda i: " ".join(f"{'ab'[i % 2]}word{k}" for k in r.integers(0, 40, 30))
    train, held = [(i, text(i)) for i in range(200)], [(i, text(i)) for i in range(20)]
    model, got = scored(spark, train, held, classes=5)
    names = model.types.heads.to_pylist()
    by = [{int(model.cls[1 + k]) for k, w in enumerate(names) if w[0] == c} for c in "ab"]
    assert not by[0] & by[1]
    assert sum(x.score for x in got) > sum(x.base_score for x in got) + 0.25 * sum(x.n_tokens for x in got)


def test_best_move_gain_is_the_likelihoods(spark):
    r = np.random.default_rng(3)
    n, classes = 12, 4
    pairs = r.integers(0, 9, (n, n)).astype(float)
    cls = np.concatenate([[0], 1 + r.integers(0, classes - 1, n - 1)])

    def total(c):
        t = np.zeros((classes, classes))
        np.add.at(t, (c[:, None], c[None, :]), pairs)
        return t

    now = total(cls)
    for w in range(1, n):
        own = pairs[w, w]
        right = np.bincount(cls, weights=np.where(np.arange(n) == w, 0, pairs[w]), minlength=classes)
        left = np.bincount(cls, weights=np.where(np.arange(n) == w, 0, pairs[:, w]), minlength=classes)
        b, gain = m.best_move(int(cls[w]), right, left, own, now)
        tried = {}
        for k in range(1, classes):
            c = cls.copy()
            c[w] = k
            tried[k] = m.likelihood(total(c)) - m.likelihood(now)
        assert gain == pytest.approx(max(tried.values()), abs=1e-6) and tried[b] == pytest.approx(gain, abs=1e-6)

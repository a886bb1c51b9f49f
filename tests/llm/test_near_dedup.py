import random

import brute
import numpy as np

from rampstat.llm import near_dedup as n


def run(spark, rows):
    done = n.near_duplicates(brute.frame(spark, rows)).collect()
    none = lambda x: None if x == brute.NONE else x
    assert all(r.kept == (r.did == r.component_id) for r in done)
    return [(none(r.did), r.n_shingles, none(r.component_id)) for r in done]


def near_copies(seed=5):
    """Groups of texts with edits, chains where the ends are not alike, and unlike texts."""
    r = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"g{g}w{r.randrange(500)}" for _ in range(160)]
        for k in range(6):
            w = list(base)
            for j in range(k):
                w[20 + 22 * j] = f"edit{g}{k}{j}"
            rows.append(" ".join(w))
        for j in range(4):  # each step changes one more place
            base[25 + 30 * j] = f"step{j}"
            rows.append(" ".join(base))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_odd_cases(spark):
    rows = brute.odd_rows()
    brute.same(run(spark, rows), brute.components(rows))


def test_components_against_all_pairs(spark):
    rows = near_copies()
    brute.same(run(spark, rows), brute.components(rows))


def test_empty(spark):
    assert run(spark, []) == []


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    for shared in (900, 950, 990):
        common, a, b = (r.integers(0, 1 << 63, k, np.uint64) for k in (shared, 1000 - shared, 1000 - shared))
        x, y = (n.minhash(np.unique(np.concatenate([common, own]))) for own in (a, b))
        apart = int(np.bitwise_count(n.odd_sketch(x).view(np.uint64) ^ n.odd_sketch(y).view(np.uint64)).sum())
        true = shared / (2000 - shared)
        assert n.sketch_limit(true + 0.08) < apart < n.sketch_limit(true - 0.08)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301)], "a long, b long")
    got = {r.node: r.label for r in n.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}


def test_keep_first_keeps_columns(spark):
    docs = brute.frame(spark, near_copies())
    kept = n.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in brute.components(near_copies()) if i == c}


def cloud(seed=7, n=90):
    """Copies of one text with 0 to 40 words changed each: alike to few of the others."""
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(150)]
    rows = []
    for k in range(n):
        w = list(base)
        for j in r.sample(range(150), r.randrange(40 * k // n + 1)):
            w[j] = f"new{k}x{j}"
        rows.append((k, " ".join(w)))
    return rows


def test_large_buckets_in_blocks(spark, monkeypatch):
    want = brute.components(cloud())
    assert 3 < len({c for _, _, c in want}) < 80
    brute.same(run(spark, cloud()), want)
    monkeypatch.setattr(n, "BLOCK", 10)  # several blocks a bucket
    brute.same(run(spark, cloud()), want)


def test_long_texts_in_many_blocks_and_runs(spark, monkeypatch):
    """Blocks and runs of few shingles: every set is compared with all that it may link to."""
    monkeypatch.setattr(n, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(n, "RUN_SHINGLES", 700)
    brute.same(run(spark, cloud()), brute.components(cloud()))
    r = random.Random(3)
    base = [f"long{r.randrange(5000)}" for _ in range(9000)]
    rows = [(k, " ".join(w if r.random() > 0.001 * k else f"x{k}y{j}" for j, w in enumerate(base))) for k in range(12)]
    brute.same(run(spark, rows), brute.components(rows))


def test_a_text_longer_than_a_batch(spark):
    """Some 13 MB, twice with few words changed, next to short texts."""
    base = [f"w{(i * 7919) % 1000003}" for i in range(1_600_000)]
    rows = [(1, " ".join(base)), (2, "a short text of some words"), (0, " ".join([*base[:800_000], "other", *base[800_001:]]))]
    done = {r.did: (r.n_shingles, r.component_id) for r in n.near_duplicates(brute.frame(spark, rows, extra=False)).collect()}
    assert done == {i: (len(brute.shingles(x)), 2 if i == 2 else 0) for i, x in rows}


def test_ties_at_the_threshold(spark):
    """17 of 20 shingles shared is 0.85 and links; 84 of 100 does not."""
    w = [f"tie{k}" for k in range(300)]
    rows = [(0, " ".join(w[:21])), (1, " ".join(w[:24])), (2, " ".join(w[100:188])), (3, " ".join(w[100:204]))]
    assert [len(brute.shingles(x)) for _, x in rows] == [17, 20, 84, 100]
    got = run(spark, rows)
    brute.same(got, brute.components(rows))
    assert {i: c for i, _, c in got} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_only_members_with_a_likely_partner_go_on():
    r = np.random.default_rng(4)
    base = np.unique(r.integers(0, 1 << 63, 400, np.uint64))
    sets = [base, base[3:], np.unique(r.integers(0, 1 << 63, 400, np.uint64)), base[:200]]
    samples = [n.minhash(s) for s in sets]
    key = int(n.band_keys(samples[0])[0])
    bands = [n.band_keys(x).tolist() for x in samples]
    for b in bands:
        b[0] = key  # as if all shared the first band
    t = n.pa.table({"key": [key] * 4, "i": [0] * 4, "j": [0] * 4, "side": [0] * 4, "node": list(range(4)), "label": list(range(4)),
                    "n_shingles": [len(s) for s in sets], "bands": bands, "sketch": [n.odd_sketch(x).tolist() for x in samples]})
    likely = n.block_members(t, 85, n.sketch_limit(n.SKETCH_LEAST))
    assert likely.column("node").to_pylist() == [0, 1]
    links = n.block_links(likely.append_column("s", n.pa.array([sets[0].tobytes(), sets[1].tobytes()], n.pa.binary())), 85, n.sketch_limit(n.SKETCH_LEAST))
    assert links.to_pylist() == [{"a": 0, "b": 1}]

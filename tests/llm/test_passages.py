import random

import brute
import numpy as np
import pytest

from rampstat.llm import passages as p


def run(spark, rows, **more):
    done = p.remove_repeats(brute.frame(spark, rows), **more).collect()
    return [(None if r.did == brute.NONE else r.did, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in done]


def spliced(seed):
    """Texts over few letters with passages copied between them, some cut to 49, 50 and 51 bytes."""
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdé \n") for _ in range(k))
    shared = [text(k) for k in (49, 50, 51, 64, 120, 400)] + ["z" * 300, "xy" * 100]
    return [(i, "".join(text(r.randrange(90)) + r.choice(shared)[r.randrange(3):] for _ in range(r.randrange(6)))) for i in range(60)]


def test_odd_cases(spark):
    rows = brute.odd_rows()
    brute.same(run(spark, rows), brute.passages(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_spliced(spark, seed, monkeypatch):
    monkeypatch.setattr(p, "PACK_BYTES", 1500)  # many packs
    brute.same(run(spark, spliced(seed)), brute.passages(spliced(seed)))


def test_kept_text(spark):
    rows = [(1, "a" * 20 + "b" * 60), (2, "c" + "b" * 60 + "d")]
    got = {r.did: bytes(r.kept) for r in p.remove_repeats(brute.frame(spark, rows), keep_text=True).collect()}
    assert got == {1: rows[0][1].encode(), 2: b"cd"}


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("limit", [1, 3, 6])
def test_interval_expansion_gives_common_prefixes(limit):
    r = random.Random(limit)
    strings = sorted({bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12))) for _ in range(40)})
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    codes = np.where(raw == 0, 0, raw.astype(np.int16) + 1)
    order = p.suffix_order(codes)
    text = raw.tobytes()
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    fixed = p.expand(codes[order - 1], limit)
    tail = [text[i:].split(b"\0")[0] for i in order]
    for j in range(1, len(order)):
        common = next((k for k in range(limit) if tail[j][k:k + 1] != tail[j - 1][k:k + 1] or k >= len(tail[j])), limit)
        if tail[j] != tail[j - 1] or len(tail[j]) >= limit:  # equal ends of strings are no windows
            assert fixed[j] == (common < limit)

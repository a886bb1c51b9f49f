import math
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rampstat.llm import packing as p

PATH = p.tokenizer_path()


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


HARD = ["", " x ", "a<|endoftext|>b c", "It's 12 foo,bar's q ́e Aİ", None, "<|", "<|startoftext|> <<|endoftext|>", "H̱ T̈ ǰ ΑΣ ΣΑΣ",
        "a b c　d", "\x1c\x1f ctrl\x01x", "ª º µ ß ẞ × ÷ Ÿ", "don't WE'LL i'm 'tis o'", "İI ıi ﬁ ﬀ Å Å", "日本語 テスト 한국어 ꙮ 🙂👍🏽", "a" * 300 + "B" * 300]


def test_words_encode_like_whole_texts(tok):
    r = random.Random(3)
    signs = [chr(c) for c in range(1, 0x250)] + list("  ́̈İΣ '.,!<|>")
    texts = HARD + ["".join(r.choice(signs) for _ in range(80)) for _ in range(400)]
    flat, at = p.token_ids(pa.array(texts), PATH)
    for i, x in enumerate(texts):
        assert flat[at[i]:at[i + 1]].tolist() == tok.encode(x or "", add_special_tokens=False).ids, x


def test_cache_that_overflows(tok, monkeypatch):
    monkeypatch.setattr(p, "CACHE_WORDS", 50)
    enc = p.WordIds(PATH)
    for k in range(30):
        u = [f"Word{k % 7}x{i}" for i in range(20)] + [f"same{i}" for i in range(5)] + ["L" * 200]
        a, n = enc.lookup(pa.array(u, pa.large_string()))
        assert len(enc.words) <= 50 + len(u) and len(set(enc.hashes)) == len(enc.hashes)
        assert [enc.ids[x:x + y].tolist() for x, y in zip(a, n, strict=True)] == [tok.encode(w, add_special_tokens=False).ids for w in u]


def test_words_of_one_hash(tok, monkeypatch):
    monkeypatch.setattr(p, "word_hash", lambda u: np.array([len(w) for w in u.to_pylist()], np.uint64))
    enc = p.WordIds(PATH)
    for u in (["cat", "house"], ["dog", "house"], ["cat", "mouse", "a"], ["dog"], ["cat"]):
        a, n = enc.lookup(pa.array(u, pa.large_string()))
        assert [enc.ids[x:x + y].tolist() for x, y in zip(a, n, strict=True)] == [tok.encode(w, add_special_tokens=False).ids for w in u]


def check(spark, rows, tok, max_len):
    got = p.pack_documents(brute.frame(spark, rows), PATH, max_len=max_len, keep_ids=True).collect()
    want = []
    for i, x in rows:
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), max_len)):
            own = ids[s:s + max_len]
            want.append((brute.known(i), k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), str(own)))
    brute.same([(r.did, r.piece, r.start, r.length, r.ids_crc32, str(list(r.ids))) for r in got], want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert not ends or max(ends.values()) <= max_len
    return got, len(ends), sum(r.length for r in got)


@pytest.mark.parametrize("max_len", [16, 4096])
def test_odd_cases(spark, tok, max_len):
    got, n, total = check(spark, brute.odd_rows(), tok, max_len)
    assert n <= math.ceil(total / max_len) * 1.1 + 1


def test_sequences_hold_the_ids(spark, tok):
    docs = brute.frame(spark, [(i, f"text number {i} of a few") for i in range(40)])
    packed = p.pack_documents(docs, PATH, max_len=32, keep_ids=True)
    by = {r.sequence_id: list(r.ids) for r in p.sequences(packed).collect()}
    for r in packed.collect():
        assert by[r.sequence_id][r.offset:r.offset + r.length] == list(r.ids)


def test_groups_are_joined(spark, monkeypatch):
    monkeypatch.setattr(p, "GROUP_BINS", 3)
    from pyspark.sql import functions as F

    r = random.Random(1)
    sizes = [r.randrange(1, 60) for _ in range(600)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "uid long, length long")
    got = p.pack_pieces(pieces, 64, 3).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(x.n for x in got) == sum(sizes) and max(x.n for x in got) <= 64
    assert len(got) <= 1.08 * math.ceil(sum(sizes) / 64)


def loose_pieces(spark, n=600):
    """Pieces of which no two fit one sequence of 64 and none fills one."""
    return spark.createDataFrame([(i, 33 + i % 28) for i in range(n)], "uid long, length long")


def test_groups_stay_bounded_when_no_bin_fills(spark):
    got = p.pack_pieces(loose_pieces(spark), 64, 5).collect()
    assert sorted(r.uid for r in got) == list(range(600)) and len({r.sequence_id for r in got}) == 600
    of_group = {}
    for r in got:  # a sequence's number begins with its turn and group
        of_group[r.sequence_id >> 24] = of_group.get(r.sequence_id >> 24, 0) + r.length
    assert len(of_group) > 40 and max(of_group.values()) <= 3 * 5 * 64


@pytest.mark.parametrize("turns", [1, 2])
def test_last_turn_drops_nothing(spark, monkeypatch, turns):
    monkeypatch.setattr(p, "TURNS", turns)
    r = random.Random(1)
    sizes = [r.randrange(1, 65) for _ in range(600)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    got = p.pack_pieces(pieces, 64, 3).collect()
    assert sorted((x.uid, x.length) for x in got) == list(enumerate(sizes))
    ends = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    assert max(ends.values()) <= 64


def test_empty(spark):
    assert p.pack_documents(brute.frame(spark, []), PATH).collect() == []


@pytest.mark.parametrize("start", [[[7, 2], [8], [3]], [[5, 3], [7], [2, 3]], [[6, 3], [5, 4], [1, 1]], [[8], [5, 4], [2, 1]], [[9], [6, 1], [2, 2]]])
def test_local_search_empties_bins(start):
    """Moves, one-for-one and two-for-one exchanges: 20 in bins of 10."""
    lengths = np.array([x for b in start for x in b])
    numbers = iter(range(len(lengths)))
    done = p.local_search([[next(numbers) for _ in b] for b in start], lengths, 10)
    assert len(done) == 2 and sorted(x for b in done for x in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 10 for b in done)


def test_exchanges():
    assert p.best_exchange(np.array([3]), np.array([7, 2]), 1)[0] == 1
    gain, take, give = p.best_exchange(np.array([2, 3]), np.array([6, 4]), 1)
    assert (gain, sorted(take), give) == (1, [0, 1], [1])
    gain, take, give = p.best_exchange(np.array([6]), np.array([2, 3]), 1)
    assert (gain, take, sorted(give)) == (1, [0], [0, 1])
    assert p.best_exchange(np.array([2]), np.array([9]), 1)[0] == 0


def test_search_never_does_worse():
    r = np.random.default_rng(2)
    for _ in range(20):
        lengths = r.integers(1, 100, 120)
        bins = p.best_fit(lengths, 100)
        done = p.local_search(bins, lengths, 100)
        assert len(done) <= len(bins) and sorted(x for b in done for x in b) == list(range(120))
        assert all(lengths[b].sum() <= 100 for b in done)


def test_query_against_the_least_number_of_sequences(spark):
    rows = p.op4_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096
    assert len(fill) <= math.ceil(sum(fill.values()) / 4096) + 1

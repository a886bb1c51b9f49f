import base64
import hashlib
import io
import random

import brute
import pytest

from rampstat.llm import warc as w

PAGES = [(3, "http://a/", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (2, "http://c/\r\nx", None), (9, None, ""),
         (4, "http://d/é", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (None, "http://e/", "<p>same</p>"), (5, "http://f/", "x" * 100_000), (6, "http://g/", "own")]


def frame(spark, rows):
    extra = ", ".join(f"`{c}` string" for c in brute.EXTRA)
    return spark.createDataFrame([(*r, *["x"] * len(brute.EXTRA)) for r in rows], f"page_id long, url string, html string, {extra}")


def sha(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


def expected(rows):
    out = []
    for i, _, x in rows:
        first = min(brute.known(j) for j, _, y in rows if (y or "") == (x or ""))
        kind = "response" if first == brute.known(i) else "revisit"
        out.append((i, len((x or "").encode()), sha(x), kind, first if kind == "revisit" else None))
    return out


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("size", [1, 1 << 20])
def test_round_trip(spark, tmp_path, compress, size):
    folder = str(tmp_path / "w")
    index = w.write_archives(frame(spark, PAGES), folder, archive_bytes=size, compress=compress)
    assert sum(r.records for r in index.collect()) == len(PAGES)
    back = w.read_archives(index, folder)
    got = back.select(w.page_of("record_id"), "payload_bytes", "payload_digest", "record_type", w.page_of("refers_to")).collect()
    brute.same(got, expected(PAGES))
    texts = {(r.record_id, bytes(r.payload)) for r in back.collect() if r.record_type == "response"}
    assert texts == {(w.record_name(brute.known(i)), (x or "").encode()) for (i, _, x), e in zip(PAGES, expected(PAGES), strict=True) if e[3] == "response"}


def test_least_size_of_revisits(spark, tmp_path):
    index = w.write_archives(frame(spark, PAGES), str(tmp_path / "w"), min_revisit=1000)
    assert {r.record_type for r in w.read_archives(index, str(tmp_path / "w")).collect()} == {"response"}


def test_empty(spark, tmp_path):
    index = w.write_archives(frame(spark, []), str(tmp_path / "w"))
    assert index.collect() == [] and w.read_archives(index, str(tmp_path / "w")).collect() == []


def records(compress, n=30):
    r = random.Random(4)
    payloads = [bytes(r.randrange(256) for _ in range(r.randrange(400))) for _ in range(n)]
    out = [w.record_bytes("response", i, "http://x/", p, w.sha1(p), None) for i, p in enumerate(payloads)]
    return [w.member(x) if compress else x for x in out]


def salvaged(data):
    return list(w.salvage(io.BytesIO(data)))


@pytest.mark.parametrize("compress", [True, False])
def test_whole_archives_have_no_gaps(compress):
    parts = records(compress)
    got = salvaged(b"".join(parts))
    assert [x[0] for x in got] == ["record"] * len(parts)
    assert [x[2] for x in got] == [len(x) for x in parts]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_damage_costs_only_what_it_hits(compress, seed):
    r = random.Random(seed)
    parts = records(compress)
    hit = r.randrange(len(parts))
    kind = seed % 4
    bad = bytearray(parts[hit])
    if kind == 0:  # bytes of the block changed (a record's header has no digest)
        for k in r.sample(range(len(bad) - 60, len(bad) - 10), 8):
            bad[k] ^= 0x5A
    elif kind == 1:  # cut short
        bad = bad[:len(bad) // 2]
    elif kind == 2:  # foreign bytes before it, marks among them
        bad = bytearray(b"junk" + w.MEMBER + b"\x00" * 9 + b"WARC/1.1 no record\r\n") + bad
    else:  # the head is lost
        bad = bad[12:]
    data = b"".join([*parts[:hit], bytes(bad), *parts[hit + 1:]])
    got = salvaged(data)
    seen = {x[3]["warc-record-id"] for x in got if x[0] == "record"}
    assert {w.record_name(i) for i in range(len(parts)) if i != hit} <= seen
    assert (w.record_name(hit) in seen) == (kind == 2)
    gaps = [x for x in got if x[0] == "gap"]
    assert gaps and sum(x[2] for x in got) == len(data)  # every byte is in a record or in quarantine
    ends = 0
    for x in got:
        assert x[1] == ends
        ends += x[2]


def test_lost_tail():
    data = b"".join(records(True))
    got = salvaged(data[:-5])
    assert got[-1][0] == "gap" and len(got) == 30


def test_gaps_are_logged_through_spark(spark, tmp_path):
    folder = tmp_path / "w"
    index = w.write_archives(frame(spark, PAGES).coalesce(1), str(folder))
    name = index.first().archive
    data = bytearray((folder / name).read_bytes())
    data[40:44] = b"\xff" * 4
    (folder / name).write_bytes(data)
    rows = w.read_archives(index, str(folder)).collect()
    assert sum(r.record_type == "gap" for r in rows) == 1 and sum(r.length for r in rows) == len(data)
    assert sum(r.record_type != "gap" for r in rows) == len(PAGES) - 1


@pytest.mark.parametrize("compress", [True, False])
def test_long_urls_are_read_back(spark, tmp_path, compress):
    long = [(1, "data:text/html," + "a" * 100_000, "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, "http://c/" + "é\r\n" * 1_000_000, "own"),
            (4, "http://d/" + "d" * ((1 << 20) - 300), "<p>same</p>")]
    index = w.write_archives(frame(spark, long).coalesce(1), str(tmp_path / "w"), compress=compress)
    back = w.read_archives(index, str(tmp_path / "w"))
    got = back.select(w.page_of("record_id"), "payload_bytes", "payload_digest", "record_type", w.page_of("refers_to")).collect()
    brute.same(got, expected(long))
    assert {r.target_uri for r in back.collect()} == {u.replace("\r\n", "%0A") for _, u, _ in long}


def test_header_ends_on_any_chunk_bound(monkeypatch):
    for size in range(60, 120):
        monkeypatch.setattr(w, "CHUNK", size)
        parts = records(False, 5)
        assert [x[0] for x in salvaged(b"".join(parts))] == ["record"] * 5
        head = parts[0][:parts[0].index(b"\r\n\r\n")]  # cut in its header: only it is lost
        got = salvaged(head + b"\r\n" + b"".join(parts[1:]))
        assert [x[0] for x in got] == ["gap"] + ["record"] * 4

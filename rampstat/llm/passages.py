"""Repeated passages: bytes covered by a ``LENGTH``-byte string that a document
with a smaller id also holds are removed.

Every ``LENGTH``-byte window is dealt to a bucket by its minimizer, the smallest
hash among the ``ANCHOR``-byte strings in it, so equal windows meet wherever they
are; neighbouring windows with one minimizer travel as one string. Windows whose
minimizer only one document has cannot repeat and stay at home. In a bucket,
the strings of one minimizer are sorted into a Burrows-Wheeler transform, and
threshold-bounded interval expansion finds the windows that are equal: from the
interval of all suffixes, intervals are extended backwards breadth-first, one
byte longer each turn, and each turn fixes the common prefixes of that length;
after ``LENGTH`` turns, neighbouring suffixes whose common prefix is not fixed agree in
``LENGTH`` bytes or more.

Documents travel in packs of a few megabytes, and a pack sends a bucket each
distinct string once, with the smallest id that has it. So a passage that a third of
all documents hold costs a bucket one entry a pack, and no task sees all its holders.
Packs, hashes and strings move as compressed binary columns; answers are bits.

Defined cases: a null or empty text has no bytes; texts of fewer than ``LENGTH`` bytes
lose nothing; a null id ranks as the largest id and comes back null; rows that share
an id never remove each other's bytes; empty tables give no rows; one text of any
length is a pack of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.arrow_text import mix, slices, whole
from rampstat.llm.common import given_id, known_id, save, ship, table

LENGTH = 50
ANCHOR = 24
#: Windows that travel in one string, at most (bits of an answer).
RUN = 64
PACK_BYTES = 2 << 20
#: Bytes of text whose minimizers one bucket takes on average.
BUCKET_BYTES = 5 << 20
#: Bytes that are sorted at a time: small enough for the processor's cache.
SORT_BYTES = 96 << 10

PACK = "pack long, ids binary, ends binary, data binary"
#: A pack's ids, its documents' ends within the data, and the data, compressed.


def squeezed(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def opened(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def packs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", PACK_BYTES):
                t = whole(part.column("t")).cast(pa.large_binary())
                at = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1, 8 * t.offset)
                data = t.buffers()[2].to_pybytes()[at[0]:at[-1]] if at[-1] > at[0] else b""
                ids = part.column("did").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"pack": pa.array([uuid.uuid4().int >> 65], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()),
                                                  "ends": pa.array([(at[1:] - at[0]).tobytes()], pa.binary()), "data": pa.array([squeezed(data)], pa.binary())})

    d = docs.select(known_id(F.col(id_col)).alias("did"), F.col(text_col).cast("string").alias("t"))
    return save(d.mapInArrow(run, PACK), "packs")


# -- windows of a pack -------------------------------------------------------


class Strings:
    """The strings of a pack: runs of windows of one document with one minimizer."""

    def __init__(self, ids: bytes, ends: bytes, data: bytes):
        self.ids, self.ends, self.data = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), opened(data)
        size = np.diff(self.ends, prepend=0)
        self.starts = self.ends - size
        raw = np.frombuffer(self.data, np.uint8)
        n = len(raw) - LENGTH + 1
        if n <= 0:
            self.at = self.run = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        h, wide = anchor_hashes(raw), 1
        width = LENGTH - ANCHOR + 1
        while 2 * wide <= width:  # smallest of ``width`` neighbours, by doubling
            h = np.minimum(h[:-wide], h[wide:])
            wide *= 2
        least = np.minimum(h[:len(h) - (width - wide)], h[width - wide:])
        doc = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
        first = np.cumsum(np.maximum(size - LENGTH + 1, 0)) - np.maximum(size - LENGTH + 1, 0)
        at = np.arange(len(doc)) - first[doc] + self.starts[doc]  # windows within a document
        least = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        run = np.diff(begin, append=len(at))
        if len(run) and run.max() > RUN:  # periodic text
            parts = -(-run // RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, run = np.repeat(begin, parts) + nth * RUN, np.minimum(np.repeat(run, parts) - nth * RUN, RUN)
        self.at, self.run, self.doc, self.key = at[begin], run, doc[begin], least[begin]

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers in the order of (bucket, minimizer), whether several ids
        of this pack have it, and each string's place in that order."""
        u, place = np.unique(self.key, return_inverse=True)
        low, high = np.full(len(u), np.iinfo(np.int64).max), np.full(len(u), np.iinfo(np.int64).min)
        np.minimum.at(low, place, self.ids[self.doc])
        np.maximum.at(high, place, self.ids[self.doc])
        order = np.argsort((u % np.uint64(buckets)).astype(np.int64), kind="stable")
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        return u[order], (low < high)[order], rank[place]

    def distinct(self, chosen: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of the ``chosen`` strings: the distinct ones, the smallest id of each, its
        minimizer, and the place among them of each chosen one."""
        seen: dict[bytes, int] = {}
        data, length = self.data, self.run[chosen] + LENGTH - 1
        place = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(self.at[chosen].tolist(), (self.at[chosen] + length).tolist(), strict=True)], np.int64)
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, place, self.ids[self.doc[chosen]])
        key = np.zeros(len(seen), np.uint64)
        key[place] = self.key[chosen]
        return list(seen), least, key, place


def anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``ANCHOR``-byte string."""
    n = len(raw) - ANCHOR + 1
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, ANCHOR, 8):
        h ^= h >> np.uint64(32)
        h += eight[k:k + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def short(u: np.ndarray, buckets: int) -> np.ndarray:
    """What tells minimizers of one bucket apart: 32 bits; a clash costs work only."""
    return (u // np.uint64(buckets)).astype(np.uint32)


def bucket_bounds(u: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets in ``u`` (sorted by bucket), and where each begins and ends."""
    own, start = np.unique((u % np.uint64(buckets)).astype(np.int64), return_index=True)
    return own, np.append(start, len(u))


# -- the first round: minimizers that several documents have ------------------


def offers(p: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, *own in zip(*(batch.column(c).to_pylist() for c in ("pack", "ids", "ends", "data")), strict=True):
                u, several, _ = Strings(*own).keys(buckets)
                b, at = bucket_bounds(u, buckets)
                k = short(u, buckets)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(b, pa.int64()), "pack": pa.array([pack] * len(b), pa.int64()),
                    "keys": pa.array([k[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    "several": pa.array([np.packbits(several[x:y]).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    return p.mapInArrow(run, "bucket long, pack long, keys binary, several binary")


def shared_keys(t: pa.Table) -> pa.Table:
    """For each pack of a bucket, bits that tell which of its minimizers some other
    document has too."""
    keys = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(t.column("several").to_pylist(), keys, strict=True)]
    u, place, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    n[place[np.concatenate(several) > 0]] = 2
    bits = np.split((n > 1)[place], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"pack": t.column("pack"), "bucket": t.column("bucket"), "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})


def told(rows: DataFrame, column: str) -> DataFrame:
    """What the buckets answer each pack, in bucket order."""
    return rows.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("bucket", column))).alias(column))


# -- the second round: strings ------------------------------------------------


def shared_strings(s: Strings, bits: list[dict] | None, buckets: int) -> np.ndarray:
    """The strings whose minimizer is shared."""
    u, _, rank = s.keys(buckets)
    b, at = bucket_bounds(u, buckets)
    if not bits:
        return np.zeros(0, np.int64)
    known = np.concatenate([np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=n) for x, n in zip(bits, np.diff(at), strict=True)])
    return np.flatnonzero(known[rank] > 0)


def in_buckets(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of distinct strings by bucket (stable), the buckets, and their bounds."""
    b = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    own, start = np.unique(b[order], return_index=True)
    return order, own, np.append(start, len(order))


def string_offers(p: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, bits, *own in zip(*(batch.column(c).to_pylist() for c in ("pack", "bits", "ids", "ends", "data")), strict=True):
                s = Strings(*own)
                strings, least, key, _ = s.distinct(shared_strings(s, bits, buckets))
                order, b, at = in_buckets(key, buckets)
                size, k = np.array([len(x) for x in strings], np.uint8), short(key, buckets)
                parts = [order[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(b, pa.int64()), "pack": pa.array([pack] * len(b), pa.int64()),
                    "strings": pa.array([squeezed(b"".join([strings[i] for i in x])) for x in parts], pa.binary()),
                    "sizes": pa.array([size[x].tobytes() for x in parts], pa.binary()), "keys": pa.array([k[x].tobytes() for x in parts], pa.binary()),
                    "least": pa.array([squeezed(least[x].tobytes()) for x in parts], pa.binary())})

    return p.mapInArrow(run, "bucket long, pack long, strings binary, sizes binary, keys binary, least binary")


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffix array of a text of codes under 512, by prefix doubling from seven codes."""
    n = len(codes)
    padded = np.append(codes.astype(np.int64), np.zeros(7, np.int64))
    key, wide = padded[:n].copy(), 7
    for k in range(1, 7):
        key = (key << 9) | padded[k:k + n]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank_there = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank_there[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = rank_there
        key = rank << 32
        key[:n - wide] |= rank[wide:] + 1  # nothing follows: smallest
        wide *= 2


def expand(bwt: np.ndarray, limit: int) -> np.ndarray:
    """Where common prefixes of neighbouring suffixes are shorter than ``limit``:
    True at j if suffixes j - 1 and j agree in fewer bytes. Breadth-first backward
    extension; turn l fixes the common prefixes of l bytes. Code 0 ends strings."""
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    before = np.empty(n, np.int32)
    before[order] = np.arange(n, dtype=np.int32)  # where a suffix goes with the byte before it
    first = bwt[order]
    fixed = np.zeros(n + 1, bool)
    fixed[0] = fixed[n] = True
    fixed[1:n] |= first[1:] != first[:-1]  # turn 0
    active = np.arange(n, dtype=np.int32)
    interval = np.cumsum(fixed[:n], dtype=np.int32)
    plain = bwt != 0
    came = np.empty(n, np.int32)
    for _ in range(1, limit):
        goes = plain[active]
        active, interval = active[goes], interval[goes]
        if not len(active):
            break
        came.fill(-1)
        came[before[active]] = interval
        active = np.flatnonzero(came >= 0).astype(np.int32)
        old, head = came[active], first[active]
        new = np.ones(len(active), bool)
        new[1:] = (active[1:] != active[:-1] + 1) | (old[1:] != old[:-1]) | (head[1:] != head[:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(active) - 1)
        ends = active[last] + 1
        fresh = ~fixed[ends]
        fixed[ends] = True
        number = np.cumsum(new, dtype=np.int32) - 1
        stays = fresh[number]  # only an interval that fixed something goes on
        active, interval = active[stays], number[stays]
    return fixed[:n]


def earlier_windows(strings: list[bytes], least: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bits for each string: window j is also in a string with a smaller id."""
    size = np.array([len(x) for x in strings])
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    ends = np.cumsum(size + 1) - 1
    codes = raw.astype(np.int16) + 1
    codes[ends] = 0
    string = np.repeat(np.arange(len(size)), size + 1)
    order = suffix_order(codes)
    fixed = expand(codes[order - 1], length)
    group = np.cumsum(fixed) - 1
    owner = np.minimum.reduceat(least[string[order]], np.flatnonzero(fixed))[group]
    offset = order - (ends - size)[string[order]]
    found = (owner < least[string[order]]) & (offset <= size[string[order]] - length)
    bits = np.zeros(len(size), np.uint64)
    np.bitwise_or.at(bits, string[order][found], np.uint64(1) << offset[found].astype(np.uint64))
    return bits


ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def answers(t: pa.Table) -> pa.Table:
    """For each pack of a bucket, for each of its strings: which windows some smaller
    id has, as bits."""
    sizes = [np.frombuffer(x, np.uint8) for x in t.column("sizes").to_pylist()]
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()])
    least = np.concatenate([np.frombuffer(opened(x), np.int64) for x in t.column("least").to_pylist()])
    seen: dict[bytes, int] = {}
    places = []
    for x, n in zip(t.column("strings").to_pylist(), sizes, strict=True):
        data, to = opened(x), np.cumsum(n).tolist()
        places += [seen.setdefault(data[a:b], len(seen)) for a, b in zip([0, *to], to, strict=False)]
    place, strings = np.array(places, np.int64), list(seen)
    own = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(own, place, least)
    key = np.zeros(len(strings), np.uint32)
    key[place] = keys
    # one minimizer's strings are compared; a string alone meets only itself
    order = np.argsort(key, kind="stable")
    _, start, n = np.unique(key[order], return_index=True, return_counts=True)
    bits, held, size = np.zeros(len(strings), np.uint64), [], 0
    for a, k in zip(start[n > 1].tolist(), n[n > 1].tolist()):
        mine = order[a:a + k]
        held.append(mine)
        size += sum(len(strings[i]) + 1 for i in mine)
        if size >= SORT_BYTES:
            compare(held, strings, own, bits)
            held, size = [], 0
    if held:
        compare(held, strings, own, bits)
    mask = np.where(least > own[place], ALL, bits[place])
    parts = np.split(mask, np.cumsum([len(n) for n in sizes])[:-1])
    return pa.table({"pack": t.column("pack"), "bucket": t.column("bucket"), "masks": pa.array([squeezed(x.tobytes()) for x in parts], pa.binary())})


def compare(held: list[np.ndarray], strings: list[bytes], own: np.ndarray, bits: np.ndarray) -> None:
    at = np.concatenate(held)
    bits[at] = earlier_windows([strings[i] for i in at], own[at])


# -- removal ------------------------------------------------------------------


def covered(s: Strings, bits: list[dict] | None, masks: list[dict] | None, buckets: int) -> np.ndarray:
    """Which bytes of a pack go."""
    cover = np.zeros(len(s.data) + 1, np.int32)
    chosen = shared_strings(s, bits, buckets)
    if masks and len(chosen):
        _, least, key, place = s.distinct(chosen)
        order, _, _ = in_buckets(key, buckets)
        mask = np.zeros(len(key), np.uint64)
        mask[order] = np.concatenate([np.frombuffer(opened(x["masks"]), np.uint64) for x in masks])
        # within the pack, a larger id than the smallest one loses every window
        mine = np.where(s.ids[s.doc[chosen]] > least[place], ALL, mask[place])
        full = mine == ALL
        at, run = s.at[chosen], s.run[chosen]
        np.add.at(cover, at[full], 1)
        np.add.at(cover, at[full] + run[full] + LENGTH - 1, -1)
        some = np.flatnonzero(~full & (mine > 0))
        for j in range(RUN):
            there = at[some[(mine[some] >> np.uint64(j)) & np.uint64(1) > 0]] + j
            np.add.at(cover, there, 1)
            np.add.at(cover, there + LENGTH, -1)
    return np.cumsum(cover[:-1]) > 0


def removed(p: DataFrame, buckets: int, keep_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits, masks, *own in zip(*(batch.column(c).to_pylist() for c in ("bits", "masks", "ids", "ends", "data")), strict=True):
                s = Strings(*own)
                gone = covered(s, bits, masks, buckets)
                raw = np.frombuffer(s.data, np.uint8)
                total = np.concatenate([[0], np.cumsum(gone)])
                n_removed = total[s.ends] - total[s.starts]
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = s.starts[s.starts < s.ends]
                begins[heads] = gone[heads]
                spans = np.concatenate([[0], np.cumsum(begins)])
                kept = [(raw[a:b][~gone[a:b]] if n else raw[a:b]).tobytes() for a, b, n in zip(s.starts, s.ends, n_removed, strict=True)]
                out = {"did": pa.array(s.ids), "n_bytes": pa.array(s.ends - s.starts), "n_removed": pa.array(n_removed),
                       "n_spans": pa.array(spans[s.ends] - spans[s.starts]),
                       "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
                if keep_text:
                    out["kept"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return p.mapInArrow(run, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: ``did`` (null as NO_ID), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``
    (and ``kept``, the remaining bytes)."""
    ship(docs.sparkSession)
    p = packs(docs, id_col, text_col)
    total = p.agg(F.sum(F.octet_length("data")).alias("b")).first()["b"] or 0  # compressed, to about two fifths
    buckets = max(4, -(-5 * total // (2 * BUCKET_BYTES)))
    bits = told(save(offers(p, buckets).groupBy("bucket").applyInArrow(shared_keys, "pack long, bucket long, bits binary"), "shared"), "bits")
    with_bits = p.join(save(bits, "bits"), "pack", "left")
    masks = told(save(string_offers(with_bits, buckets).groupBy("bucket").applyInArrow(answers, "pack long, bucket long, masks binary"), "answers"), "masks")
    return removed(with_bits.join(save(masks, "masks"), "pack", "left"), buckets, keep_text)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(given_id(F.col("did")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")

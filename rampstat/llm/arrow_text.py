"""Arrow-batch text helpers for operators that run Python on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, to bound memory.
SLICE_BYTES = 2 << 20


#: What operators keep in a Python worker between batches. A worker serves one operator
#: after the other; the next one frees it.
CACHES: list[dict] = []


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES, keep_caches: bool = False) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about ``limit`` bytes of text; a longer text comes alone."""
    for cache in CACHES if not keep_caches else ():
        cache.clear()
    pa.default_memory_pool().release_unused()
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def whole(texts: pa.Array) -> pa.Array:
    """The texts (null: empty) as an array with buffers of its own: some string
    kernels misread an array that begins inside a larger buffer."""
    t = pc.fill_null(texts, "").cast(pa.large_string())
    return pa.concat_arrays([t, pa.array([], t.type)])


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """White-space words (``[^\\x20\\x09-\\x0D]+``) of each text: the row each word
    is in, the distinct words, and each word's place among them."""
    t = whole(texts)
    split = pc.ascii_split_whitespace(pc.ascii_lower(t) if lower else t)
    flat = pc.list_flatten(split)
    row = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    d = flat.dictionary_encode()
    ix, u = d.indices.to_numpy(zero_copy_only=False), d.dictionary
    empty = pc.index(u, pa.scalar("", u.type)).as_py()
    if empty >= 0:  # around leading and trailing white space
        there = ix != empty
        row, ix = row[there], ix[there]
        ix = ix - (ix > empty)
        u = pa.concat_arrays([u.slice(0, empty), u.slice(empty + 1)])
    return row.astype(np.int64), u, ix.astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly (odd multiplications and shifts)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hash(u: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same on every machine and in every run."""
    import pandas as pd

    return pd.util.hash_array(u.to_numpy(zero_copy_only=False), categorize=False)

"""Quality rules: fixed rules on counts, and a calibrated linear classifier.

The classifier is a logistic regression on hashed word unigrams, word bigrams
and character trigrams (each kind's hits averaged over the text), fitted on a
bounded sample of the labelled rows: ``TRAIN_ROWS`` of them, those whose ids
hash lowest, so the sample spreads over the whole table and is the same in
every run. A fifth of the sample is held out of the fit; on it, Platt scaling
turns scores into probabilities. Texts are then scored whole, in Arrow batches,
against the fixed thresholds below. Counting and scoring are one pass without
a shuffle.

Defined cases: a null text has no words and, like every text of fewer than
``MIN_WORDS`` words, fails the rules; a null id stays null; repeated rows each
get the same verdict; labels that are null, or whose document is missing, are not
used; if the sample lacks one of the two classes there is no classifier and the
rules alone decide (``probability`` is null); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.arrow_text import mix, slices, whole, word_hash, words
from rampstat.llm.common import given_id, known_id, ship, table

# Fixed thresholds.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
KEEP_PROBABILITY = 0.5

#: Labelled rows that the classifier is fitted and calibrated on, at most.
TRAIN_ROWS = 3000
HELD_OUT = 5
#: Buckets of each kind of feature.
BUCKETS = 1 << 16
KINDS = 3
STEPS = 150
PENALTY = 1e-4

SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass
class Model:
    weights: np.ndarray  # KINDS x BUCKETS
    bias: float
    slope: float  # Platt scaling
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (score + self.bias) + self.shift, -60, 60)))


# -- counts ------------------------------------------------------------------


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins and ends."""
    t = whole(texts)
    at = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1, 8 * t.offset) if len(t) else np.zeros(1, np.int64)
    data = np.frombuffer(t.buffers()[2], np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def by_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)])
    return total[at[1:]] - total[at[:-1]]


def is_one_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def repeat_words(row: np.ndarray, ix: np.ndarray, n: int, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each row inside windows of ``size`` (a power of two) words that
    the row has twice or more. Windows are numbered exactly, by doubling."""
    ids, width = ix, 1
    while width < size and len(ids) > width:
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(pair, return_inverse=True)[1]
        width *= 2
    if width < size or not len(ids):
        return np.zeros(n, np.int64)
    here = np.flatnonzero(row[:len(ids)] == row[size - 1:size - 1 + len(ids)])
    _, which, times = np.unique(ids[here] * n + row[here], return_inverse=True, return_counts=True)
    twice = here[times[which] > 1]
    cover = np.zeros(len(row) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + size, -1)
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)


def duplicate_lines(texts: pa.Array, n: int) -> np.ndarray:
    split = pc.split_pattern(whole(texts), "\n")
    row = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    d = pc.list_flatten(split).dictionary_encode()
    has_word = pc.match_substring_regex(d.dictionary, WORD).to_numpy(zero_copy_only=False)
    ix = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    there = has_word[ix]
    key = row[there].astype(np.int64) * max(1, len(has_word)) + ix[there]
    first = np.unique(key) // max(1, len(has_word))
    return np.bincount(row[there], minlength=n) - np.bincount(first.astype(np.int64), minlength=n)


def counts(texts: pa.Array, row: np.ndarray, ix: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(texts)
    data, at = text_bytes(texts)
    in_word = ~is_one_of(b" \t\n\x0b\x0c\r")[data] & ((data & 0xC0) != 0x80)
    return [np.bincount(row, minlength=n), by_row(in_word, at), by_row(is_one_of(SYMBOLS.encode())[data], at),
            duplicate_lines(texts, n), repeat_words(row, ix, n)]


# -- features ----------------------------------------------------------------


def features(texts: pa.Array, row: np.ndarray, u: pa.Array, ix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the bucket of each hit, and the hits' bounds by row."""
    n = len(texts)
    small = np.uint64(BUCKETS - 1)
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    hashed = word_hash(u) if len(u) else np.zeros(0, np.uint64)
    one = (mix(hashed) & small).astype(np.int32)[ix]
    same = row[:-1] == row[1:]
    two = (mix(hashed[ix[:-1]] * np.uint64(3) + hashed[ix[1:]]) & small).astype(np.int32)[same]
    at2 = np.concatenate([[0], np.cumsum(np.bincount(row[:-1][same], minlength=n))])
    data, b = text_bytes(texts)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[b]  # in code points
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    tri = chars[:-2] * np.uint32(0x9E3779B1) + chars[1:-1] * np.uint32(0x85EBCA6B) + chars[2:] * np.uint32(0xC2B2AE35)
    tri ^= tri >> np.uint32(15)
    tri = ((tri * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int32) & np.int32(BUCKETS - 1)
    own = np.ones(len(tri), bool)  # none spans two texts
    for k in (1, 2):
        ends = starts[1:] - k
        own[ends[(ends >= 0) & (ends < len(tri))]] = False
    size = np.maximum(np.diff(starts) - 2, 0)
    return [(one, at), (two, at2), (tri[own], np.concatenate([[0], np.cumsum(size)]))]


def score(model: Model, feats: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    total = 0
    for w, (hit, at) in zip(model.weights, feats, strict=True):
        total = total + by_row(w[hit], at) / np.maximum(np.diff(at), 1)
    return total


# -- fitting -----------------------------------------------------------------


def sparse_rows(feats: list[tuple[np.ndarray, np.ndarray]], i: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (numbered through all kinds) and mean hits of one text."""
    at, value = [], []
    for k, (hit, bounds) in enumerate(feats):
        own, times = np.unique(hit[bounds[i]:bounds[i + 1]], return_counts=True)
        at.append(own.astype(np.int32) + k * BUCKETS)
        value.append((times / max(1, bounds[i + 1] - bounds[i])).astype(np.float32))
    return np.concatenate(at), np.concatenate(value)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most ``rows`` labelled texts as sparse features: the ids that hash lowest."""
    chosen = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("label")).dropna()
    chosen = chosen.where("label in (0, 1)").groupBy("lid").agg(F.max("label").alias("label"), F.min("label").alias("least"))
    chosen = chosen.where("label = least").select("lid", "label", F.xxhash64("lid").alias("h")).orderBy("h", "lid").limit(rows)
    # bounded by ``rows``, so it may be broadcast; rows repeating an id count once
    both = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col).cast("string").alias("t")).join(
        F.broadcast(chosen), F.col("did") == F.col("lid"))
    both = both.groupBy("did").agg(F.min("t").alias("t"), F.first("label").alias("label"), F.first("h").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                row, u, ix = words(part.column("t"))
                feats = features(part.column("t"), row, u, ix)
                got = [sparse_rows(feats, i) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("h"), pa.array([a.tobytes() for a, _ in got], pa.binary()),
                                                  pa.array([v.tobytes() for _, v in got], pa.binary())], ["label", "h", "at", "value"])

    return both.select("t", "label", "h").mapInArrow(run, "label int, h long, at binary, value binary")


def logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by Adam over the whole sample at each step;
    both classes weigh the same. ``rows``: buckets and values of each text."""
    n, d = len(y), KINDS * BUCKETS
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    parts = []  # a few hundred texts at a time, to bound what a step holds
    for i in range(0, n, 200):
        own = rows[i:i + 200]
        parts.append((slice(i, i + len(own)), np.concatenate([a for a, _ in own]), np.concatenate([v for _, v in own]),
                      np.repeat(np.arange(len(own), dtype=np.int32), [len(a) for a, _ in own])))
    rows.clear()
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for k in range(1, steps + 1):
        g = np.append(PENALTY / d * w, 0.0)
        for here, at, value, row in parts:
            z = np.bincount(row, weights=value * w[at], minlength=here.stop - here.start) + b
            error = weight[here] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[here])
            g[:-1] += np.bincount(at, weights=value * error[row], minlength=d)
            g[-1] += error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.5 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities, by Newton steps."""
    scale = max(float(np.std(z)), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))  # keeps the slope finite
    a = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - goal) + 1e-6 * a)
        a = a - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(a[0] / scale), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model | None:
    """The fitted classifier, or None when the sample has not both classes."""
    ship(docs.sparkSession)
    sample = training_sample(docs, labels, rows, id_col, text_col, label_col).toArrow().sort_by("h")
    y = sample["label"].to_numpy()
    if len(y) < 2 * HELD_OUT or y.min() == y.max():
        return None
    texts = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(sample["at"].to_pylist(), sample["value"].to_pylist(), strict=True)]
    del sample
    held = np.arange(len(y)) % HELD_OUT == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    out = [texts[i] for i in np.flatnonzero(held if held.any() else ~held)]
    use = [texts[i] for i in np.flatnonzero(~held)]
    del texts
    w, b = logistic(use, y[~held])
    held = held if held.any() else ~held
    z = np.array([w[at] @ value + b for at, value in out])
    slope, shift = platt(z, y[held])
    return Model(w.reshape(KINDS, BUCKETS).astype(np.float32), float(b), slope, shift)


# -- verdicts ----------------------------------------------------------------


def verdicts(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``did`` (null id as NO_ID), the counts, ``probability`` (of good
    quality), ``base_failed`` and ``kept``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                own = judged(part.column("t"), model)
                yield pa.RecordBatch.from_arrays([part.column("did"), *own.values()], ["did", *own])

    d = docs.select(known_id(F.col(id_col)).alias("did"), F.col(text_col).cast("string").alias("t"))
    return d.mapInArrow(run, f"did long, {COUNTS}, probability double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, all their columns as they are."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(judged(part.column(text_col), model)["kept"])

    return docs.mapInArrow(run, docs.schema)


def judged(texts: pa.Array, model: Model | None) -> dict[str, pa.Array]:
    """Counts, probability and verdicts of each text."""
    row, u, ix = words(texts, lower=False)
    own = [x.astype(np.int64) for x in counts(texts, row, ix)]
    n_words, n_repeat_words = own[0], own[-1]
    failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)
    kept, p = ~failed, pa.nulls(len(texts), pa.float64())
    if model is not None:
        row, u, ix = words(texts)
        p = model.probability(score(model, features(texts, row, u, ix))).astype(np.float64)
        kept = kept & (p >= KEEP_PROBABILITY)
        p = pa.array(p)
    names = [x.split()[0] for x in COUNTS.split(", ")]
    return dict(zip(names, map(pa.array, own), strict=True)) | {"probability": p, "base_failed": pa.array(failed), "kept": pa.array(kept)}


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = verdicts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return done.select(given_id(F.col("did")).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept", "probability")

"""Near-duplicate documents: MinHash bands, odd sketches, exact links, components.

A document's set is its distinct five-word shingles (64-bit hashes). Documents
with one set form a class, and only classes go on. ``BANDS`` bands of ``ROWS``
MinHash values each give candidate pairs; two sets of similarity 0.85 share no
band with a probability of 3 in a million. The MinHash values are also folded
into an odd sketch, a bitmap of the parities of hashed samples: the population
count of two sketches' XOR estimates a high similarity closely, and pairs that
lie more than six standard deviations under the threshold go no further. The
others are linked or not by their full sets.

No bucket's pairs are all formed. First each member of a bucket is paired with
the bucket's smallest member alone (a row each); the links give components.
Buckets that still hold different components are looked through once more: small
ones by pairs between different components, larger ones in tasks that compare
sketches block by block; the full sets of members that have a likely partner follow,
and links alone come back. So no link between different components is lost, and no
group is turned into pairs of rows. A class's members are never paired, and a set that
many others are compared with is sent once for a long run of them.

Defined cases: no words or a null text is an empty set, linked with nothing;
fewer words than a shingle are one shingle together; a null id ranks as the
largest id; rows that repeat an id and text are equal rows of one class; rows that share
an id but not a text are different nodes; empty tables give no rows. Long texts
are shingled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.arrow_text import mix, slices, word_hash, words
from rampstat.llm.common import broadcast_below, given_id, known_id, save, ship, table

SHINGLE = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, ROWS = 40, 8
SKETCH_BITS = 1024
#: Similarity by the sketch under which a pair goes no further.
SKETCH_LEAST = 0.70
#: In buckets of more members than this, different components are compared in tasks,
#: by blocks of so many members.
SMALL = 8
BLOCK = 4096
#: Shingles of a block, and of the partners that follow one set, about (8 bytes each).
BLOCK_SHINGLES = 2 << 20
RUN_SHINGLES = 4 << 20
#: Ids of documents to be compared in full that are broadcast at most.
BROADCAST_IDS = 1 << 18

_RNG = np.random.default_rng(20240601)
_MUL = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32, False) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32, False)
_PLACE = _RNG.integers(0, 1 << 63, SHINGLE, np.uint64, False) | np.uint64(1)
_SAMPLE = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64, False) | np.uint64(1)

SIGNATURE = "did long, n_shingles long, set_id binary, bands array<long>, sketch array<long>"


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    n = len(texts)
    row, u, ix = words(texts)
    h = mix(word_hash(u))[ix] if len(u) else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    m = max(len(h) - SHINGLE + 1, 0)
    s = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        s += h[k:k + m] * _PLACE[k]
    s = mix(s)
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a >= SHINGLE:
            yield np.unique(s[a:b - SHINGLE + 1])
        elif b > a:
            yield mix((h[a:b] * _PLACE[:b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def minhash(s: np.ndarray) -> np.ndarray:
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i:i + 512, None] * _MUL + _ADD).min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    v = mix(samples.astype(np.uint64) * _SAMPLE + np.arange(len(samples), dtype=np.uint64))
    return mix(v.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bit j is set when an odd number of the (number, value) samples hash to j."""
    v = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32)) + np.uint64(77))
    bits = np.bincount((v % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch_limit(least: float) -> int:
    """Set bits of the XOR that two sets of similarity ``least`` are expected to have."""
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * (1 - least) * BANDS * ROWS)))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                n, keys, bands, sketches = [], [], [], []
                for s in shingle_sets(part.column("t")):
                    n.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    samples = minhash(s) if len(s) else None
                    bands.append(band_keys(samples) if len(s) else None)
                    sketches.append(odd_sketch(samples) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("did"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                     pa.array(sketches, pa.list_(pa.int64()))], ["did", "n_shingles", "set_id", "bands", "sketch"])

    ship(docs.sparkSession)
    return docs.select(known_id(F.col(id_col)).alias("did"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, SIGNATURE)


def full_sets(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node`` and its sorted shingles ``s`` (longs as bytes) for the ``chosen`` nodes (``node``, ``did``, ``set_id``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = list(shingle_sets(part.column("t")))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "s"])

    d = docs.select(known_id(F.col(id_col)).alias("did"), F.col(text_col).cast("string").alias("t"))
    d = d.join(broadcast_below(chosen.select("did").distinct(), BROADCAST_IDS), "did", "left_semi")
    sets = d.select("t").mapInArrow(run, "set_id binary, s binary").dropDuplicates(["set_id"])
    return save(sets.join(chosen.select("node", "set_id"), "set_id").select("node", "s"), "sets")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, are to be linked."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges two sorted runs
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of runs that come one after the other: the set of ``a`` first, then those of its partners."""
    held = np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        for a, node, s in zip(batch.column("a").to_pylist(), batch.column("node").to_pylist(), batch.column("s"), strict=True):
            own = np.frombuffer(s.as_buffer(), np.uint64)
            if node == a:
                held = own.copy()
            elif similar(held, own, percent):
                out.append((a, node))
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of the pairs of nodes (``a``, ``b``), those whose full sets are similar enough.

    Sketches and sizes are compared first. Then the partners of an ``a`` travel in runs of
    about ``RUN_SHINGLES``, each led by the set of ``a``, which is sent once a run; a
    task reads its runs as a stream and holds that one set."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"k{x}"), F.col("n_shingles").alias(f"n{x}"))
    apart = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where((apart <= sketch_limit(SKETCH_LEAST)) & sized)
    likely = save(likely.select("a", "b", "nb"), "likely")
    ends = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    sets = full_sets(docs, save(nodes.join(ends, "node").select("node", "did", "set_id"), "chosen"), id_col, text_col)
    many = likely.groupBy("a").agg(F.ceil(F.sum("nb") / RUN_SHINGLES).cast("long").alias("runs")).where("runs > 1")
    runs = likely.join(save(many, "runs"), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("runs", F.lit(1))).alias("run"), "b")
    lead = runs.select("a", "run").distinct().join(sets, F.col("a") == F.col("node")).select("a", "run", "node", "s")
    follow = runs.join(sets, F.col("b") == F.col("node")).select("a", "run", "node", "s")
    rows = lead.union(follow).repartition("a", "run").sortWithinPartitions("a", "run", F.col("node") != F.col("a"))
    return save(rows.mapInArrow(lambda x: confirm(x, percent), "a long, b long"), "links")


def likely_in_block(t: pa.Table, percent: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different labels, by sketch and size, among the members of a bucket's block
    or between two blocks of it, as places in ``t``. A pair is given only in the first
    band that it shares."""
    side, node, label = (t.column(c).to_numpy() for c in ("side", "node", "label"))
    size, key = t.column("n_shingles").to_numpy(), t.column("key")[0].as_py()
    sketch = np.array(t.column("sketch").to_pylist(), np.int64).view(np.uint64)
    bands = np.array(t.column("bands").to_pylist(), np.int64)
    here, there = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(side)),) * 2
    for i in range(0, len(here), 16):
        rows = here[i:i + 16]
        apart = np.bitwise_count(sketch[rows, None] ^ sketch[None, there]).sum(2, dtype=np.int64)
        x, y = np.nonzero((apart <= limit) & (label[rows, None] != label[None, there]))
        x, y = rows[x], there[y]
        keep = (node[x] < node[y]) | side.any()
        keep &= 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
        x, y = x[keep], y[keep]
        first = (bands[x] == bands[y]).argmax(1) == (bands[x] == key).argmax(1)
        yield x[first], y[first]


def block_members(t: pa.Table, percent: int, limit: int) -> pa.Table:
    """The members that have a likely partner, all columns as they are."""
    wanted = np.zeros(t.num_rows, bool)
    for x, y in likely_in_block(t, percent, limit):
        wanted[x] = wanted[y] = True
    return t.filter(pa.array(wanted))


def block_links(t: pa.Table, percent: int, limit: int) -> pa.Table:
    """Links by the full sets; of links that join the same labels, one."""
    node, label = t.column("node").to_numpy(), t.column("label").to_pylist()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s")]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for x, y in likely_in_block(t, percent, limit):
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            p, q = top(label[a]), top(label[b])
            if p != q and similar(sets[a], sets[b], percent):
                up[p] = q
                out.append((node[a], node[b]))
    return pa.table({"a": pa.array([int(a) for a, _ in out], pa.int64()), "b": pa.array([int(b) for _, b in out], pa.int64())})


MEMBER = "key long, i long, j long, side int, node long, label long, n_shingles long, bands array<long>, sketch array<long>"


def linked_in_blocks(members: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links between the labels in large buckets. Members are dealt into blocks of about
    ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles at most; each block, and each two
    blocks of a bucket, are compared in tasks, first by sketches alone. Sets are fetched for
    members that have a likely partner, and sent where they have one. The tasks give back
    members and links, never pairs."""
    members = members.join(nodes.select("node", "n_shingles", "bands", "sketch"), "node")
    blocks = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    members = members.join(save(blocks, "blocks"), "key")
    own = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own = own.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"),
                     "node", "label", "n_shingles", "bands", "sketch")
    limit = sketch_limit(SKETCH_LEAST)
    likely = save(own.groupBy("key", "i", "j").applyInArrow(lambda t: block_members(t, percent, limit), MEMBER), "block-members")
    chosen = save(nodes.join(likely.select("node").distinct(), "node").select("node", "did", "set_id"), "chosen")
    sets = full_sets(docs, chosen, id_col, text_col)
    found = likely.join(sets, "node").groupBy("key", "i", "j").applyInArrow(lambda t: block_links(t, percent, limit), "a long, b long")
    return save(found.distinct(), "block-links")


def components(links: DataFrame) -> DataFrame:
    """``node`` and the smallest node it reaches, ``label``, for the ends of the links.
    Labels spread over links and then jump to their label's label, so chains of
    n links take about log n turns; every turn is a written table."""
    edges = save(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = new.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        new = save(new.join(up, new.label == up.up, "left").select("node", "old", F.least("label", F.coalesce("upper", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("old <> label").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``did``, ``n_shingles``, ``component_id`` (as ``did``) and ``kept``."""
    sig = save(signatures(docs, id_col, text_col), "signatures")
    filled = sig.where("set_id IS NOT NULL")
    firsts = filled.groupBy("set_id").agg(F.min("did").alias("did"))
    nodes = save(filled.join(firsts, ["set_id", "did"]).dropDuplicates(["set_id"]).select(
        F.monotonically_increasing_id().alias("node"), "did", "set_id", "n_shingles", "bands", "sketch"), "nodes")

    rows = nodes.select("node", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most")
    members = save(rows.join(buckets, "key"), "members")
    star = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = linked(star, nodes, docs, percent, id_col, text_col)
    labels = components(links)

    # buckets that hold different components still: the pairs between those
    marked = save(members.join(labels, "node", "left").select("key", "node", "least", F.coalesce("label", "node").alias("label")), "marked")
    mixed = save(marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x < y").select("key", "size"), "mixed")
    small = marked.join(mixed.where(F.col("size") <= SMALL), "key")
    left = small.select("key", F.col("node").alias("a"), F.col("label").alias("la"), "least")
    right = small.select("key", F.col("node").alias("b"), F.col("label").alias("lb"))
    rest = left.join(right, "key").where("a < b AND la <> lb AND a <> least").select("a", "b").distinct()
    more = linked(rest, nodes, docs, percent, id_col, text_col)
    large = linked_in_blocks(marked.join(mixed.where(F.col("size") > SMALL), "key").select("key", "node", "label"), nodes, docs, percent, id_col, text_col)
    labels = components(links.union(more).union(large))

    of = nodes.join(labels, "node", "left").select("set_id", "did", F.coalesce("label", "node").alias("label"))
    smallest = of.groupBy("label").agg(F.min("did").alias("component_id"))
    of = of.join(smallest, "label").select("set_id", "component_id")
    out = sig.select("did", "n_shingles", "set_id").join(of, "set_id", "left")
    out = out.select("did", "n_shingles", F.coalesce("component_id", "did").alias("component_id"))
    return out.withColumn("kept", F.col("did") == F.col("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the document with the smallest id of each component, all their
    columns as they are (of rows that share an id, all or none)."""
    kept = near_duplicates(docs, percent, id_col, text_col).where("kept").select("did").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, known_id(F.col(id_col)).alias("did")).join(kept, "did", "left_semi").select("row.*")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_duplicates(table(spark, sf_dir, "documents"))
    return done.select(given_id(F.col("did")).alias("doc_id"), "n_shingles", given_id(F.col("component_id")).alias("component_id"), "kept")

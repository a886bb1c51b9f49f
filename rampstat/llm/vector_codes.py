"""Vector code compression: product codes by k-means over anchors-hierarchy metric trees.

Vectors of integers (``floor(256 * x)``) are cut into ``PARTS`` parts; each part position has a
codebook of ``ENTRIES`` entries, improved by ``ROUNDS`` rounds of k-means. The vectors lie
in blocks of at most ``BLOCK``, and a block holds a metric tree for each part
position, built once and stored, and walked in every round:

* Middle out: an anchors hierarchy picks about the square root of n anchors, each the
  point furthest from its own anchor so far; a point moves to a new anchor only
  after a look at half the distance between the two anchors. Anchors are then
  joined upwards, the two with the smallest common ball first, and those with more than
  ``LEAF`` points are taken apart downwards in the same way.
* Every ball caches the sum and the count of its points, and its radius about their mean.
* A round walks the balls from the top, all trees of a block at once, level by level.
  A ball inherits its parent's list of candidate entries and strikes out those
  that are further than the nearest one from every point of the ball (the bisecting
  plane of the two entries lies outside the ball). When one is left, the ball is
  wholly owned: its cached sum and count go to that entry, and nothing under it is
  looked at. Leaves that still have several candidates compare their points with these
  alone, in whole numbers, ties to the lower index.

A task gives back a sum and a count per entry and component, at most
PARTS * ENTRIES * width rows, and Spark adds them up; the codebooks (as many numbers) are
all that the driver sees and all that goes back with the next round's tasks.

Defined cases: a row whose vector is null, holds a null or a non-finite component, or
has another length than that of the smallest id with a vector whose length is a positive
multiple of ``PARTS``, is dropped; components
too large for squared distances in 64 bits (from 2**18 on, with vectors of 64) are an
error that says so; a null id ranks as the largest id and comes out null; rows that repeat
an id are vectors of their own, those of the first codebook ordered by id, then by
components; with fewer than ``ENTRIES`` vectors the codebooks have as many
entries as vectors; equal entries: the lower index owns; null labels are one label; no
vectors: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rampstat.llm.common import broadcast_below, given_id, known_id, save, ship, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a block, and points that a ball isn't taken apart for.
BLOCK, LEAF = 16384, 64
#: Pairs of points and entries that are compared at once.
PAIRS = 1 << 20
#: Labels whose error sums are broadcast at most: two longs each.
BROADCAST_LABELS = 1 << 18


# -- trees ---------------------------------------------------------------------------

def anchors(x: np.ndarray, k: int) -> np.ndarray:
    """The anchor of each point, of at most ``k`` anchors: each new one is the point that
    is furthest from its own, and takes the points that are nearer to it."""
    owner = np.zeros(len(x), np.int64)
    away = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    at = [0]
    for a in range(1, k):
        new = int(away.argmax())
        if away[new] == 0:
            break
        at.append(new)
        # a point nearer to its anchor than half the way to the new one stays there
        half = np.sqrt(((x[at[:-1]] - x[new]) ** 2).sum(axis=1)) / 2
        maybe = np.flatnonzero(away > half[owner])
        d = np.sqrt(((x[maybe] - x[new]) ** 2).sum(axis=1))
        taken = d < away[maybe]
        owner[maybe[taken]], away[maybe[taken]] = a, d[taken]
    return owner


def joined(mean: np.ndarray, count: np.ndarray, radius: np.ndarray) -> list[tuple[int, int]]:
    """The order in which balls are joined by twos, those with the smallest common
    ball first; the i-th join makes the ball ``len(mean) + i``."""
    k = len(mean)
    mean, count, radius, name = mean.copy(), count.astype(float), radius.copy(), np.arange(k)
    cost = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(axis=2)) + radius[:, None] + radius[None]
    np.fill_diagonal(cost, np.inf)
    out = []
    for i in range(k - 1):
        a, b = divmod(int(cost.argmin()), k)
        out.append((int(name[a]), int(name[b])))
        both = count[a] + count[b]
        centre = (mean[a] * count[a] + mean[b] * count[b]) / both
        radius[a] = max(np.sqrt(((mean[a] - centre) ** 2).sum()) + radius[a], np.sqrt(((mean[b] - centre) ** 2).sum()) + radius[b])
        mean[a], count[a], name[a] = centre, both, k + i
        cost[b, :] = cost[:, b] = np.inf
        gone = np.isinf(cost[a])
        row = np.sqrt(((mean - centre) ** 2).sum(axis=1)) + radius + radius[a]
        row[gone] = np.inf
        cost[a, :] = cost[:, a] = row
    return out


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a tree holds the points, and its balls as rows (parent, depth,
    first point, end), parents before children."""
    order, balls = np.arange(len(x)), []

    def take_apart(lo: int, hi: int, parent: int, depth: int) -> None:
        me = len(balls)
        balls.append((parent, depth, lo, hi))
        own = order[lo:hi].copy()
        owner = anchors(x[own], isqrt(hi - lo) + 1) if hi - lo > leaf else None
        if owner is None or owner.max() == 0:
            return
        points = x[own]
        k = int(owner.max()) + 1
        by = np.argsort(owner, kind="stable")
        count = np.bincount(owner, minlength=k)
        edge = np.concatenate([[0], np.cumsum(count)])
        mean = np.add.reduceat(points[by], edge[:-1], axis=0) / count[:, None]
        radius = np.sqrt(np.maximum.reduceat(((points[by] - mean[owner[by]]) ** 2).sum(axis=1), edge[:-1]))
        joins = joined(mean, count, radius)
        # down from the last join: each ball's points side by side
        stack, at, spread = [(k + len(joins) - 1, me, depth)], lo, []
        sizes = {**dict(enumerate(count.tolist()))}
        for i, (a, b) in enumerate(joins):
            sizes[k + i] = sizes[a] + sizes[b]
        while stack:
            ball, up, deep = stack.pop()
            if ball >= k:
                here = up if ball == k + len(joins) - 1 else len(balls)
                if here != up:
                    balls.append((up, deep, at, at + sizes[ball]))
                a, b = joins[ball - k]
                stack += [(b, here, deep + 1), (a, here, deep + 1)]
            else:
                n = sizes[ball]
                order[at:at + n] = own[by[edge[ball]:edge[ball + 1]]]
                spread.append((at, at + n, up, deep))
                at += n
        for a, b, up, deep in spread:
            take_apart(a, b, up, deep)

    if len(x):
        take_apart(0, len(x), -1, 0)
    return order, np.array(balls, np.int64).reshape(-1, 4)


class Forest:
    """The trees of a block: points of all part positions, one position after the other,
    in the order of its tree, and the balls of all trees, level by level."""

    def __init__(self, points: np.ndarray, order: np.ndarray, balls: np.ndarray):
        """points: (parts, n, width); order: (parts, n); balls: rows (part, parent, depth, lo, hi)."""
        self.parts, self.n, self.width = points.shape
        self.order, self.points = order, points.reshape(-1, self.width)
        self.part, self.parent, self.depth = balls[:, 0], balls[:, 1], balls[:, 2]
        self.lo, self.hi = balls[:, 3], balls[:, 4]
        self.level = np.searchsorted(self.depth, np.arange(self.depth.max(initial=-1) + 2))
        # cached sums, counts, and radii about the mean
        total = np.concatenate([np.zeros((1, self.width), np.int64), np.cumsum(self.points, axis=0)])
        self.sums, self.count = total[self.hi] - total[self.lo], self.hi - self.lo
        self.mean = self.sums / self.count[:, None]
        self.radius = np.zeros(len(balls))
        for d in range(len(self.level) - 1):
            b = slice(self.level[d], self.level[d + 1])
            ball = np.repeat(np.arange(self.level[d], self.level[d + 1]), self.count[b])
            first = np.cumsum(self.count[b]) - self.count[b]
            at = np.repeat(self.lo[b] - first, self.count[b]) + np.arange(len(ball))
            off = np.sqrt(((self.points[at] - self.mean[ball]) ** 2).sum(axis=1))
            self.radius[b] = np.maximum.reduceat(off, first)
        self.leaf = np.ones(len(balls), bool)
        self.leaf[self.parent[self.parent >= 0]] = False

    @classmethod
    def grow(cls, vectors: np.ndarray, parts: int, leaf: int = LEAF) -> Forest:
        n, dims = vectors.shape
        points = vectors.reshape(n, parts, dims // parts).transpose(1, 0, 2)
        order, rows, before = np.zeros((parts, n), np.int64), [], 0
        for p in range(parts):
            order[p], balls = build(points[p].astype(float), leaf)
            up = np.where(balls[:, 0] >= 0, balls[:, 0] + before, -1)
            rows.append(np.column_stack([np.full(len(balls), p), up, balls[:, 1], balls[:, 2] + p * n, balls[:, 3] + p * n]))
            before += len(balls)
        rows = np.concatenate(rows)
        by = np.argsort(rows[:, 2], kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        rows = rows[by]
        rows[:, 1] = np.where(rows[:, 1] >= 0, place[rows[:, 1]], -1)
        return cls(np.take_along_axis(points, order[:, :, None], axis=1), order, rows)

    def candidates(self, balls: np.ndarray, lists: np.ndarray, books: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """The candidate lists (a row of flags each) without the entries that another one
        beats at every point of the ball."""
        entry = books[self.part[balls]].astype(float)
        square = ((self.mean[balls][:, None, :] - entry) ** 2).sum(axis=2)
        square[~lists] = np.inf
        best = square.argmin(axis=1)
        nearest = np.take_along_axis(square, best[:, None], axis=1)
        reach = 2 * self.radius[balls][:, None] * apart[self.part[balls], best]
        # beaten for certain: more than rounding could do
        return lists & ~(square - nearest > reach + 1e-9 * (1 + nearest + reach))

    def walk(self, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For a codebook per part, (parts, entries, width): first (balls, entry) of the balls
        that are wholly owned, then (balls, candidate lists) of the leaves that aren't."""
        apart = np.sqrt(((books[:, :, None, :] - books[:, None, :, :]).astype(float) ** 2).sum(axis=3))
        # of equal entries only the first can own
        alone = ~(np.tril(apart == 0, -1).any(axis=2))
        balls = np.arange(*self.level[:2]) if len(self.level) > 1 else np.zeros(0, np.int64)
        lists = alone[self.part[balls]]
        owned, owner, open_leaves, open_lists = [], [], [], []
        for d in range(len(self.level) - 1):
            lists = self.candidates(balls, lists, books, apart)
            done = lists.sum(axis=1) == 1
            owned.append(balls[done])
            owner.append(lists[done].argmax(axis=1))
            stop = ~done & self.leaf[balls]
            open_leaves.append(balls[stop])
            open_lists.append(lists[stop])
            if d + 2 < len(self.level):
                # children of balls that go on inherit their lists
                row = np.full(len(self.part), -1)
                row[balls[~done & ~stop]] = np.flatnonzero(~done & ~stop)
                below = np.arange(self.level[d + 1], self.level[d + 2])
                below = below[row[self.parent[below]] >= 0]
                lists = lists[row[self.parent[below]]]
                balls = below
        none = np.zeros((0, books.shape[1]), bool)
        yield np.concatenate([*owned, np.zeros(0, np.int64)]), np.concatenate([*owner, np.zeros(0, np.int64)])
        yield np.concatenate([*open_leaves, np.zeros(0, np.int64)]), np.concatenate([*open_lists, none])

    def points_of(self, balls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of the balls, and the place in ``balls`` of each one's ball."""
        count = self.count[balls]
        which = np.repeat(np.arange(len(balls)), count)
        return np.repeat(self.lo[balls] - (np.cumsum(count) - count), count) + np.arange(len(which)), which

    def nearest(self, balls: np.ndarray, lists: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(points, entry, squared distance) for the points of open leaves, some at a time."""
        work = np.cumsum(self.count[balls] * lists.sum(axis=1))
        for part in np.split(np.arange(len(balls)), np.searchsorted(work, np.arange(PAIRS, int(work[-1]) if len(work) else 0, PAIRS))):
            if not len(part):
                continue
            _, entry = np.nonzero(lists[part])
            number = lists[part].sum(axis=1)
            first = np.cumsum(number) - number
            point, which = self.points_of(balls[part])
            each = number[which]
            start = np.cumsum(each) - each
            pair = np.repeat(np.arange(len(point)), each)
            e = entry[np.repeat(first[which] - start, each) + np.arange(len(pair))]
            book = books[np.repeat(self.part[balls[part]][which], each), e]
            square = ((self.points[point[pair]] - book) ** 2).sum(axis=1)
            best = np.minimum.reduceat(square * books.shape[1] + e, start)
            yield point, best % books.shape[1], best // books.shape[1]

    def totals(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums (parts, entries, width) and counts (parts, entries) of what each entry owns."""
        parts, entries, width = books.shape
        (owned, owner), (open_leaves, lists) = self.walk(books)
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        key = self.part[owned] * entries + owner
        np.add.at(sums, key, self.sums[owned])
        np.add.at(counts, key, self.count[owned])
        for point, entry, _ in self.nearest(open_leaves, lists, books):
            key = point // self.n * entries + entry
            by = np.argsort(key, kind="stable")
            k, first, number = np.unique(key[by], return_index=True, return_counts=True)
            sums[k] += np.add.reduceat(self.points[point[by]], first, axis=0)
            counts[k] += number
        return sums.reshape(books.shape), counts.reshape(parts, entries)

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each vector's parts: (n, parts) both."""
        (owned, owner), (open_leaves, lists) = self.walk(books)
        entry, square = np.zeros(self.parts * self.n, np.int64), np.zeros(self.parts * self.n, np.int64)
        point, which = self.points_of(owned)
        entry[point] = owner[which]
        square[point] = ((self.points[point] - books[self.part[owned][which], owner[which]]) ** 2).sum(axis=1)
        for point, e, s in self.nearest(open_leaves, lists, books):
            entry[point], square[point] = e, s
        out = []
        for x in (entry, square):
            back = np.zeros((self.parts, self.n), np.int64)
            np.put_along_axis(back, self.order, x.reshape(self.parts, self.n), axis=1)
            out.append(back.T)
        return out[0], out[1]

    def stored(self) -> dict:
        return {"points": self.points.astype(np.int32).tobytes(), "places": self.order.astype(np.int32).tobytes(),
                "balls": np.column_stack([self.part, self.parent, self.depth, self.lo, self.hi]).astype(np.int32).tobytes()}

    @classmethod
    def read(cls, row: dict, parts: int) -> Forest:
        n = len(row["ids"])
        return cls(np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(parts, n, -1),
                   np.frombuffer(row["places"], np.int32).astype(np.int64).reshape(parts, n),
                   np.frombuffer(row["balls"], np.int32).astype(np.int64).reshape(-1, 5))


# -- on Spark ------------------------------------------------------------------------

def largest(dims: int, parts: int, entries: int) -> int:
    """Components under this keep squared distances, times ``entries``, within 64 bits."""
    return isqrt((1 << 62) // (dims // parts * entries)) // 2


def whole_vectors(rows: DataFrame, parts: int, entries: int, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """Rows that are kept: ``vid``, ``v`` (long integers), ``label``; and their length."""
    d = rows.select(known_id(F.col(id_col)).alias("vid"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).alias("label"))
    d = d.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    first = d.where((F.size("x") > 0) & (F.size("x") % parts == 0)).orderBy("vid", "x").select(F.size("x")).first()
    if not first:
        return d.where("false").select("vid", F.lit(None).cast("array<long>").alias("v"), "label"), 0
    limit = largest(first[0], parts, entries) // 256
    fits = F.forall("x", lambda c: F.abs(c) < F.lit(limit))
    v = F.when(fits, F.transform("x", lambda c: F.floor(c * 256))).otherwise(F.raise_error(F.lit(f"a vector has a component of {limit} or more")))
    return d.where(F.size("x") == first[0]).select("vid", "label", v.alias("v")), first[0]


def trees(vectors: DataFrame, dims: int, parts: int = PARTS, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row per block of vectors: ``ids``, ``labels``, ``points``, ``places``, ``balls``."""
    label = vectors.schema["label"].dataType
    kind = to_arrow_type(label)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        waiting, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - n)
                waiting.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == block:
                    yield pa.Table.from_batches(waiting).combine_chunks()
                    waiting, n = [], 0
        if n:
            yield pa.Table.from_batches(waiting).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            v = t.column("v").combine_chunks()
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            stored = Forest.grow(flat, parts, leaf).stored()
            whole = lambda name, k: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(name).combine_chunks().cast(k))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([whole("vid", pa.int64()), whole("label", kind), *(pa.array([stored[c]], pa.binary()) for c in ("points", "places", "balls"))],
                                             names=["ids", "labels", "points", "places", "balls"])

    ship(vectors.sparkSession)
    return vectors.select("vid", "v", "label").mapInArrow(run, f"ids array<long>, labels array<{label.simpleString()}>, points binary, places binary, balls binary")


def forests(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, Forest]]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            row = {c: one.column(c)[0].as_py() for c in ("points", "places", "balls")}
            yield one, Forest.read({**row, "ids": one.column("ids")[0].values}, parts)


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floor of the mean of what it owns."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, forest in forests(batches, parts):
            s, c = forest.totals(books)
            sums, counts = sums + s, counts + c
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(list(sums[p, e]), pa.list_(pa.int64())), pa.array(counts[p, e])], names=["part", "entry", "sums", "n"])

    owned = blocks.select("ids", "points", "places", "balls").mapInArrow(run, "part long, entry long, sums array<long>, n long")
    sums = owned.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    books = books.copy()
    for r in sums.collect():  # at most parts * entries rows
        books[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return books


def first_codebooks(vectors: DataFrame, dims: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the ``entries`` vectors with the smallest ids."""
    rows = [r.v for r in vectors.orderBy("vid", "v").limit(entries).select("v").collect()]
    return np.array(rows, np.int64).reshape(len(rows), parts, dims // parts).transpose(1, 0, 2).copy()


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """Per kept row: ``vid``, ``label``, ``code`` (two hex digits a part) and ``error`` (its
    squared distances, summed); and the codebooks, (parts, entries, width)."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    vectors, dims = whole_vectors(rows, parts, entries, id_col, vector_col, label_col)
    kind = vectors.schema["label"].dataType
    books = first_codebooks(vectors, dims, parts, entries) if dims else np.zeros((parts, 0, 0), np.int64)
    if not dims:
        return rows.sparkSession.createDataFrame([], f"vid long, label {kind.simpleString()}, code string, error long"), books
    blocks = save(trees(vectors, dims, parts, block, leaf), "vector-trees")
    for _ in range(rounds):
        books = improved(blocks, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, forest in forests(batches, parts):
            entry, square = forest.assign(books)
            text = entry.astype(np.uint8).tobytes().hex()
            code = [text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([one.column("ids")[0].values, one.column("labels")[0].values, pa.array(code), pa.array(square.sum(axis=1))],
                                             names=["vid", "label", "code", "error"])

    return save(blocks.mapInArrow(run, f"vid long, label {kind.simpleString()}, code string, error long"), "vector-codes"), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with the vector that each code stands for, in the integers' scale, as ``v``."""
    parts = books.shape[0]
    book = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books])
    at = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    return codes.withColumn("v", F.flatten(F.array(*[F.get(F.get(book, F.lit(p)), at[p]) for p in range(parts)])))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of the same label; null labels are one."""
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(broadcast_below(sums, BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select(given_id(F.col("vid")).alias("vec_id"), "code", "error", "label_error",
                                          F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Two rounds in SQL: every part against every entry."""
    sql = """
WITH kept AS (SELECT vec_id, label, embedding AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR isnan(c) OR isinf(c)]) = 0),
parts AS (SELECT vec_id, label, p, [floor(c::DOUBLE * 256)::BIGINT FOR c IN x[4 * p + 1:4 * p + 4]] AS v
  FROM kept, (SELECT unnest(range(0, 16)) AS p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 64)"""
    for r in range(3):
        sql += f""",
a{r} AS (SELECT vec_id, label, p, v, min((((v[1] - w[1]) ** 2 + (v[2] - w[2]) ** 2 + (v[3] - w[3]) ** 2 + (v[4] - w[4]) ** 2)::BIGINT) * 64 + e) AS best
  FROM (SELECT parts.*, b.e, b.v AS w FROM parts JOIN b{r} AS b USING (p)) GROUP BY ALL)"""
        if r < 2:
            mean = ", ".join(f"(sum(v[{k}]) - ((sum(v[{k}]) % count(*)) + count(*)) % count(*)) // count(*)" for k in range(1, 5))
            sql += f""",
b{r + 1} AS (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{r} AS b LEFT JOIN
  (SELECT p, best % 64 AS e, [{mean}]::BIGINT[] AS v FROM a{r} GROUP BY p, best % 64) AS n ON n.p = b.p AND n.e = b.e)"""
    return sql + """,
d AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', (best % 64)::INT), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM d, s
"""


ORACLE = _oracle()

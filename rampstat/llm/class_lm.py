"""Scores by a Brown class-based bigram model trained on the corpus itself.

P(text) is the product over its tokens (words, then one end) of
P(class | class before) * P(token | class). Every word has a class:

* words that make up at least ``SHARE`` of the training tokens (so at most 1/SHARE of
  them, whatever the corpus' size), and groups of all other words by their last three
  characters (``BUCKETS``), are clustered with each other by exchange;
* of these other words, each with ``MIN_COUNT`` or more occurrences (an absolute count, so
  their number grows with the corpus) then moves to the class that suits its own
  neighbours best; the rarer and the unknown ones stay with their group.

Exchange clustering: from counts of neighbouring types, each type's best move to
another class is found in Spark tasks against the current class-transition
counts, and of the moves that raise the training likelihood a part is applied
each turn, until none is left or after ``TURNS`` turns. The move of a rarer word is the one of
greatest gain to first order, as it is a small part of any class; its neighbours' class
counts are summed by word in one shuffle. Only classes, class counts and the first
step's types, all of fixed bounds, meet at the driver.

The lexicon (each training word's count and class) is a table. Its most frequent words,
``KNOWN_WORDS`` at most, are broadcast; neighbouring tokens of which one is rarer meet their
classes and counts in shuffle joins. Counts, class transitions and
scores cover all documents and whole texts.

Defined cases: a null or empty text is the end alone; a null id has the id text
'' (crc32 0: training); repeated rows each train and score; without training
tokens every count is 0 and the formulas still hold; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.arrow_text import slices, word_hash, words
from rampstat.llm.common import save, ship, table

CLASSES = 64
SHARE = 1e-4
KNOWN_WORDS = 1 << 19
MIN_COUNT = 10
BUCKETS = 512
SUFFIX = 3
TURNS = 30
#: Added to every count.
ADDED = 0.5
#: Bytes of text counted, and scored, at a time.
COUNT_SLICE = 12 << 20
SCORE_SLICE = 6 << 20
#: Distinct bigrams that a task holds before it hands them on.
HELD = 3_000_000

FOLDS, HELD_OUT = 5, 1


def fold(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass
class Types:
    """Numbers of the clustered types: 0 is the end, then ``heads``, then buckets."""

    heads: pa.Array

    def __len__(self) -> int:
        return 1 + len(self.heads) + BUCKETS

    def of(self, u: pa.Array) -> np.ndarray:
        at = pc.index_in(u, self.heads.cast(u.type))
        tail = (word_hash(pc.utf8_slice_codeunits(u, -SUFFIX)) % np.uint64(BUCKETS)).astype(np.int64) if len(u) else np.zeros(0, np.int64)
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(at >= 0, at + 1, tail + 1 + len(self.heads))


@dataclass
class Lexicon:
    """What scoring tasks share: the frequent words, their classes and counts."""

    types: Types
    cls: np.ndarray  # class of each type
    known: pa.Array  # the most frequent words
    known_cls: np.ndarray
    known_counts: np.ndarray
    least: int  # all words of so many occurrences are known

    def stream(self, texts: pa.Array) -> Stream:
        row, u, ix = words(texts)
        place = pc.fill_null(pc.index_in(u, self.known.cast(u.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rare = place < 0
        names = u.filter(pa.array(rare))
        cls, counts, hashes = np.zeros(len(u) + 1, np.int16), np.zeros(len(u) + 1, np.int64), np.zeros(len(u) + 1, np.int64)
        cls[1:][~rare], counts[1:][~rare] = self.known_cls[place[~rare]], self.known_counts[place[~rare]]
        if len(names):
            cls[1:][rare], hashes[1:][rare] = self.cls[self.types.of(names)], word_hash(names).view(np.int64)
        n = len(texts)
        prev, now = neighbours(row, 1 + ix, n)  # a word's place, 0: an end
        at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + 1)])
        return Stream(at, prev, now, cls, np.concatenate([[False], rare]), hashes, counts)


@dataclass
class Stream:
    """The tokens of some texts in order, each with the one before it, as numbers of distinct
    words (0: an end). ``at``: where each text begins. Of each number the class (of a rare
    word that of its group, until it meets the lexicon), whether it is rare, hash and count."""

    at: np.ndarray
    prev: np.ndarray
    now: np.ndarray
    cls: np.ndarray
    rare: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    def sure(self) -> np.ndarray:
        return ~(self.rare[self.prev] | self.rare[self.now])

    def pairs(self) -> pa.Array:
        """For each text, its pairs with a rare word (hashes of frequent ones are null)."""
        there = np.flatnonzero(~self.sure())
        to = pa.array(np.searchsorted(there, self.at).astype(np.int32))
        given = []
        for x in (self.prev[there], self.now[there]):
            given += [pa.array(self.hashes[x], mask=~self.rare[x]), pa.array(self.cls[x].astype(np.int32))]
        return pa.ListArray.from_arrays(to, pa.StructArray.from_arrays(given, ["hp", "cp", "hn", "cn"]))


PAIRS = "array<struct<hp:long,cp:int,hn:long,cn:int>>"


@dataclass
class Model:
    lexicon: Lexicon
    log_move: np.ndarray  # log10 P(class | class before)
    log_size: np.ndarray  # log10 of each class's emission denominator
    end_count: int
    n: int
    v: int

    @property
    def types(self) -> Types:
        return self.lexicon.types

    @property
    def cls(self) -> np.ndarray:
        return self.lexicon.cls


# -- counts ------------------------------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """``word``, ``c`` of all training words, a saved table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", COUNT_SLICE):
                _, u, ix = words(part.column("t"))
                yield pa.RecordBatch.from_arrays([u.cast(pa.string()), pa.array(np.bincount(ix, minlength=len(u)).astype(np.int64))], ["word", "c"])

    return save(train.select("t").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def neighbours(row: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's type and that of the token before, both with the ends of the ``n`` texts."""
    size = np.bincount(row, minlength=n)
    to = np.cumsum(size + 1)
    stream = np.zeros(to[-1] + 1 if n else 1, np.int64)  # begins as after an end
    stream[1:][np.arange(len(ids)) + row] = ids  # one end after each text before
    return stream[:-1], stream[1:]


def bigram_counts(train: DataFrame, types: Types) -> DataFrame:
    """``prev``, ``next``, ``n`` of neighbouring types, a saved table of at most
    len(types) ** 2 rows; tasks add up their own first."""
    width = len(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], ["code", "n"])

        for batch in batches:
            for part in slices(batch, "t", COUNT_SLICE):
                row, u, ix = words(part.column("t"))
                prev, now = neighbours(row, types.of(u)[ix], part.num_rows)
                own, n = np.unique(prev * width + now, return_counts=True)
                codes, at = np.unique(np.concatenate([codes, own]), return_inverse=True)
                times = np.bincount(at, weights=np.concatenate([times, n]), minlength=len(codes)).astype(np.int64)
                if len(codes) > HELD:
                    yield rows()
                    codes, times = codes[:0], times[:0]
        yield rows()

    counted = train.select("t").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return save(counted.select(F.expr(f"code div {width}").cast("int").alias("prev"), (F.col("code") % width).cast("int").alias("next"), "n"), "bigrams")


# -- exchange clustering -----------------------------------------------------


def f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    return float(f(m).sum() - f(m.sum(0)).sum() - f(m.sum(1)).sum())


def best_move(a: int, right: np.ndarray, left: np.ndarray, own: float, m: np.ndarray) -> tuple[int, float]:
    """The class that a type of class ``a`` does best in, and what the likelihood
    gains. ``right`` and ``left``: its neighbours' counts by class, without the
    ``own`` bigrams of the type with itself; ``m``: class-transition counts."""
    m = m.copy()
    m[a, :] -= right
    m[:, a] -= left
    m[a, a] -= own
    fm, d = f(m), np.arange(len(m))
    there = (f(m + right) - fm).sum(1) - (f(m[d, d] + right) - fm[d, d])
    there += (f(m + left[:, None]) - fm).sum(0) - (f(m[d, d] + left) - fm[d, d])
    there += f(m[d, d] + right + left + own) - fm[d, d]
    rows, cols = m.sum(1) + left, m.sum(0) + right  # the neighbours' own totals stay
    there -= f(rows + right.sum() + own) - f(rows) + f(cols + left.sum() + own) - f(cols)
    there[0] = -np.inf  # the end's class is its own
    b = int(there.argmax())
    return b, float(there[b] - there[a])


def by_type(bigrams: DataFrame) -> DataFrame:
    """A row per type: its right and left neighbours with counts (lists bounded by the types)."""
    out = bigrams.groupBy(F.col("prev").alias("w")).agg(F.collect_list("next").alias("ri"), F.collect_list(F.col("n").cast("double")).alias("rn"))
    into = bigrams.groupBy(F.col("next").alias("w")).agg(F.collect_list("prev").alias("li"), F.collect_list(F.col("n").cast("double")).alias("ln"))
    return save(out.join(into, "w", "full"), "types")


def lists(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for w, *four in zip(*(part.column(c) for c in ("w", "ri", "rn", "li", "ln")), strict=True):
        yield w.as_py(), *(np.asarray(x.values) if x.is_valid else np.zeros(0) for x in four)


def transitions(types: DataFrame, cls: np.ndarray, classes: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((classes, classes))
        for batch in batches:
            for w, ri, rn, _, _ in lists(batch):
                m[cls[w]] += np.bincount(cls[ri.astype(np.int64)], weights=rn, minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], ["m"])

    parts = types.mapInArrow(run, "m binary").collect()  # a class matrix for each task
    return sum((np.frombuffer(r.m).reshape(classes, classes) for r in parts), np.zeros((classes, classes)))


def moves(types: DataFrame, cls: np.ndarray, m: np.ndarray) -> list:
    """(type, class, gain) of the types that would raise the likelihood elsewhere."""
    classes = len(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for w, ri, rn, li, ln in lists(batch):
                if w == 0:
                    continue
                ri, li = ri.astype(np.int64), li.astype(np.int64)
                own = float(rn[ri == w].sum())
                right = np.bincount(cls[ri], weights=np.where(ri == w, 0, rn), minlength=classes)
                left = np.bincount(cls[li], weights=np.where(li == w, 0, ln), minlength=classes)
                b, gain = best_move(int(cls[w]), right, left, own, m)
                if gain > 1e-6:
                    got.append((w, b, gain))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)],
                                                 ["w", "to", "gain"])

    return sorted(types.mapInArrow(run, "w int, to int, gain double").collect())  # at most one row a type


def cluster(bigrams: DataFrame, n_types: int, classes: int = CLASSES, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each type, and the class-transition counts."""
    types = by_type(bigrams)
    cls = np.concatenate([[0], 1 + np.arange(n_types - 1) % (classes - 1)])
    best, best_m, best_l, part = cls, transitions(types, cls, classes), -np.inf, 2
    m = best_m
    for turn in range(turns):
        now = likelihood(m)
        if now > best_l:
            best, best_m, best_l = cls, m, now
        else:  # too many at once
            cls, m, part = best, best_m, part * 2
        found = moves(types, cls, m)
        chosen = [r for r in found if (r.w * 40503 + turn * 7919) % 65536 % part == 0] or found[:1]
        if not chosen:
            break
        cls = cls.copy()
        for r in chosen:
            cls[r.w] = r.to
        m = transitions(types, cls, classes)
    return (cls, m) if likelihood(m) > best_l else (best, best_m)


# -- classes of rarer words ----------------------------------------------------


def profiles(train: DataFrame, types: Types, cls: np.ndarray, classes: int) -> DataFrame:
    """For words that are no heads: ``h`` (hash), and counts by slot, the classes of the
    words after and, from ``classes`` on, before; a row for each word of a slice."""
    width = 2 * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", COUNT_SLICE):
                row, u, ix = words(part.column("t"))
                if not len(u):
                    continue
                of = types.of(u)
                prev, now = neighbours(row, of[ix], part.num_rows)
                mine = of[ix] > len(types.heads)
                place = (np.arange(len(ix)) + row)[mine]  # an end follows each text, so there is a next one
                w = ix[mine] * width
                codes, n = np.unique(np.concatenate([w + cls[now[place + 1]], w + classes + cls[prev[place]]]), return_counts=True)
                own, first = np.unique(codes // width, return_index=True)
                to = pa.array(np.append(first, len(codes)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word_hash(u).view(np.int64)[own]), pa.ListArray.from_arrays(to, pa.array((codes % width).astype(np.int16))),
                     pa.ListArray.from_arrays(to, pa.array(n.astype(np.int32)))], ["h", "slots", "times"])

    return train.select("t").mapInArrow(run, "h long, slots array<smallint>, times array<int>")


def best_classes(found: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class of greatest gain to first order for each row of neighbour counts (classes
    after, then before): the likelihood's slope in each class-transition count."""
    k = len(m)
    p = m + ADDED
    after, before = np.log(p / p.sum(1, keepdims=True)), np.log(p / p.sum(0, keepdims=True))
    gain = found[:, :k] @ after.T + found[:, k:] @ before
    gain[:, 0] = -np.inf  # the end's class is its own
    return gain.argmax(1)


def rarer_classes(train: DataFrame, types: Types, cls: np.ndarray, m: np.ndarray) -> DataFrame:
    """``h``, ``own``: the class of each word of ``MIN_COUNT`` that is no head."""
    classes, least = len(m), MIN_COUNT
    width = 2 * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.zeros(width)  # the word that the next batch may go on with

        def rows(h: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
            enough = found[:, :classes].sum(1) >= least
            return pa.RecordBatch.from_arrays([pa.array(h[enough]), pa.array(best_classes(found[enough], m).astype(np.int32))], ["h", "own"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            starts = np.concatenate([[True], h[1:] != h[:-1]])
            word = np.cumsum(starts) - 1
            at = word[pc.list_parent_indices(batch.column("slots")).to_numpy()] * width + pc.list_flatten(batch.column("slots")).to_numpy()
            found = np.bincount(at, weights=pc.list_flatten(batch.column("times")).to_numpy(), minlength=(word[-1] + 1) * width).reshape(-1, width)
            names = h[starts]
            if last is not None and names[0] == last:
                found[0] += left
            elif last is not None:
                yield rows(np.array([last]), left[None])
            last, left = names[-1], found[-1].copy()
            yield rows(names[:-1], found[:-1])
        if last is not None:
            yield rows(np.array([last]), left[None])

    by_word = profiles(train, types, cls, classes).repartition("h").sortWithinPartitions("h")
    return save(by_word.mapInArrow(run, "h long, own int"), "classes")


def lexicon_table(counts: DataFrame, rarer: DataFrame, types: Types, cls: np.ndarray) -> DataFrame:
    """``word``, ``c``, ``h``, ``cls`` of all training words, a saved table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column("word").cast(pa.large_string())
            h = word_hash(u).view(np.int64) if len(u) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.select(["word", "c"]).columns, pa.array(h), pa.array(cls[types.of(u)].astype(np.int32))], ["word", "c", "h", "tied"])

    found = counts.select("word", "c").mapInArrow(run, "word string, c long, h long, tied int")
    return save(found.join(rarer, "h", "left").select("word", "c", "h", F.coalesce("own", "tied").alias("cls")), "lexicon")


# -- the model ---------------------------------------------------------------


def least_known(counts: DataFrame) -> int:
    """The least count of which there are at most ``KNOWN_WORDS`` words of it or more."""
    sizes = counts.groupBy(F.floor(F.log2("c") * 8).alias("size")).agg(F.min("c").alias("least"), F.count("*").alias("n")).collect()  # 8 a doubling
    least, words_so_far = 2**62, 0
    for r in sorted(sizes, key=lambda r: -r.least):
        words_so_far += r.n
        if words_so_far > KNOWN_WORDS:
            break
        least = r.least
    return least


def with_lexicon(pairs: DataFrame, lexicon: DataFrame, least: int) -> DataFrame:
    """Pairs with their rare words' classes, ``cp`` and ``cn``, and the second one's count ``c``
    (null: not rare). A pair's frequent word has no hash; such pairs are spread and take nothing."""
    few = lexicon.where(F.col("c") < least).groupBy(F.col("h").alias("key")).agg(F.min("cls").alias("found"), F.sum("c").alias("times"))  # words of equal hash as one
    for h, c in (("hp", "cp"), ("hn", "cn")):
        rare = F.isnotnull(h)
        pairs = pairs.withColumn("key", F.coalesce(h, F.xxhash64("hp", "cp", "hn", "cn", "spread"))).join(few, "key", "left")
        times = {"c": F.when(rare, F.coalesce("times", F.lit(0)))} if h == "hn" else {}
        pairs = pairs.withColumns({c: F.when(rare, F.coalesce("found", c)).otherwise(F.col(c)), **times}).drop("key", "found", "times")
    return pairs


def class_moves(train: DataFrame, own: Lexicon, lexicon: DataFrame, classes: int) -> np.ndarray:
    """Class-transition counts of the training texts under the lexicon's classes."""
    shared = train.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", SCORE_SLICE):
                s = shared.value.stream(part.column("t"))
                sure = s.sure()
                times = np.bincount(s.cls[s.prev[sure]].astype(np.int64) * classes + s.cls[s.now[sure]], minlength=classes**2)
                code = np.flatnonzero(times)
                times = times[code]
                pairs = s.pairs().flatten()
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.nulls(len(code), pa.int64()), pairs.field("hp")]), pa.concat_arrays([pa.array((code // classes).astype(np.int32)), pairs.field("cp")]),
                     pa.concat_arrays([pa.nulls(len(code), pa.int64()), pairs.field("hn")]), pa.concat_arrays([pa.array((code % classes).astype(np.int32)), pairs.field("cn")]),
                     pa.array(np.concatenate([times, np.ones(len(pairs), np.int64)]))], ["hp", "cp", "hn", "cn", "n"])

    pairs = train.select("t").mapInArrow(run, "hp long, cp int, hn long, cn int, n long").withColumn("spread", F.col("n"))
    m = np.zeros((classes, classes))
    for r in with_lexicon(pairs, lexicon, own.least).groupBy("cp", "cn").agg(F.sum("n").alias("n")).collect():  # classes squared
        m[r.cp, r.cn] = r.n
    return m


def train_model(train: DataFrame, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model, and the saved lexicon: ``word``, ``c``, ``h``, ``cls``."""
    ship(train.sparkSession)
    counts = word_counts(train)
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    n, v = (sums.n or 0) + ends, sums.v + (ends > 0)
    heads = counts.where(F.col("c") >= max(1, SHARE * n)).orderBy(F.desc("c"), "word").toArrow()  # at most 1 / SHARE words
    types = Types(heads["word"].combine_chunks())
    cls, m = cluster(bigram_counts(train, types), len(types), classes)
    lexicon = lexicon_table(counts, rarer_classes(train, types, cls, m), types, cls)
    least = least_known(counts)
    known = lexicon.where(F.col("c") >= least).select("word", "c", "cls").toArrow()  # at most KNOWN_WORDS
    own = Lexicon(types, cls, known["word"].combine_chunks(), known["cls"].to_numpy(), known["c"].to_numpy(), least)
    m = class_moves(train, own, lexicon, classes)
    size = np.full(classes, ADDED)
    for r in lexicon.groupBy("cls").agg(F.sum("c").alias("tokens"), F.count("*").alias("kinds")).collect():  # classes
        size[r.cls] += r.tokens + ADDED * r.kinds
    if ends:
        size[0] += ends + ADDED
    log_move = np.log10((m + ADDED) / (m.sum(1, keepdims=True) + ADDED * classes))
    return Model(own, log_move, np.log10(size), ends, n, v), lexicon


def local_scores(docs: DataFrame, model: Model) -> DataFrame:
    """What a document's own task can tell: sums over its frequent words, and the pairs
    with a word whose class and count are not broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "t", SCORE_SLICE):
                s = m.lexicon.stream(part.column("t"))
                cp, cn, rare = s.cls[s.prev], s.cls[s.now], s.rare[s.now]
                move = np.where(s.sure(), m.log_move[cp, cn] - m.log_size[cn], 0.0)
                own = s.counts.copy()
                own[0] = m.end_count
                logs = np.where(s.rare, 0.0, np.log10(own + ADDED))[s.now]
                seen = ~rare & (own > 0)[s.now]
                sums = [np.add.reduceat(x, s.at[:-1]) if part.num_rows else x for x in (move, logs, seen.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(s.at)), *map(pa.array, sums), s.pairs()],
                                                 ["id", "n_tokens", "model_part", "count_part", "n_here", "pairs"])

    id_type = docs.schema["id"].dataType.simpleString()
    scored = docs.select("id", "t").mapInArrow(run, f"id {id_type}, n_tokens long, model_part double, count_part double, n_here long, pairs {PAIRS}")
    return save(scored.withColumn("uid", F.monotonically_increasing_id()), "scores")


def score(docs: DataFrame, model: Model, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``n_tokens``, ``n_known``, ``base_score`` (unigrams), ``score`` and ``perplexity``."""
    ship(docs.sparkSession)
    local = local_scores(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")), model)
    pairs = local.select("uid", F.posexplode("pairs").alias("spread", "p")).select("uid", "spread", "p.*")
    classes = len(model.log_size)
    steps = model.log_move - model.log_size  # classes squared numbers
    step = F.element_at(F.lit([float(x) for x in steps.ravel()]), F.col("cp") * classes + F.col("cn") + 1)
    rest = with_lexicon(pairs, lexicon, model.lexicon.least).groupBy("uid").agg(
        F.sum(step).alias("rare_moves"), F.sum(F.log10(F.col("c") + ADDED)).alias("rare_counts"),
        F.count_if(F.col("c") > 0).alias("n_rare"))
    counted = F.col("count_part") + F.coalesce("rare_counts", F.lit(0.0))
    total = float(np.log10(model.n + ADDED * (model.v + 1)))
    out = local.join(rest, "uid", "left").select(
        "id", "n_tokens", (F.col("n_here") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), (counted - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (counted + F.col("model_part") + F.coalesce("rare_moves", F.lit(0.0))).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op6_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.where(fold(F.col("doc_id")) != HELD_OUT).select(F.col("text").alias("t"))
    model, lexicon = train_model(train)
    done = score(docs, model, lexicon)
    return done.select(F.col("id").alias("doc_id"), (fold(F.col("id")) == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                       F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")

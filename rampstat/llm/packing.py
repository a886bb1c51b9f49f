"""Packing documents into training sequences: best fit, then local search.

Texts become token ids in Arrow batches; a document longer than a sequence is
cut, and each piece is one row. Full pieces are sequences already. The others
are dealt at random into groups of about ``GROUP_BINS`` sequences' worth of tokens
(so tasks are bounded at every input size), packed by best fit in decreasing
order, and improved by local search: a piece of the emptiest bin moves to, or one
or two pieces are exchanged one-for-one, two-for-one or one-for-two with, an
underfull bin, whenever the sum of squared fills rises; bins that end empty go.
What lies in bins that still have much room is dealt again, into groups of the
same size, until one group is left or a turn empties next to no bins, so grouping
costs next to no sequences.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
each by itself; a null id stays null; an empty table gives no rows. Very long
texts are tokenised whole and cut only at multiples of ``max_len``.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.arrow_text import CACHES, slices, whole, word_hash, words
from rampstat.llm.common import given_id, known_id, save, ship, table

MAX_LEN = 4096
END_ID = 1
#: Sequences' worth of tokens in a group that one task packs.
GROUP_BINS = 1500
#: A bin with this part of a sequence free, or more, is packed again.
LOOSE = 16
#: Bins are dealt again while a turn empties at least one in so many of them, for so many turns at most.
LEAST_EMPTIED = 100
TURNS = 99
#: Words whose ids a Python worker keeps (some 40 bytes each); beyond that it forgets rare ones.
CACHE_WORDS = 700_000
#: Bytes of text that are tokenised at a time: more, and more words repeat.
TOKEN_SLICE = 4 << 20

PIECE = "did long, piece int, start long, length long, ids_crc32 long"


#: Words of printable ASCII and Latin-1 letters: lower-casing them is the same
#: everywhere and they compose with nothing, so they can be cut into runs here.
PLAIN = "^[\\x21-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
RUN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: The steps of the tokenizer for which RUN does what its own steps do.
STEPS_KNOWN = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Token ids of white-space words. For tokenizers that drop white space, a
    text's ids are those of its words one after the other, and most words
    repeat, so each is encoded once. Plain words are cut into the tokenizer's
    runs here and encoded many in one call, a run ending at a token that ends
    words; the others are set apart by a special token and take every step."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = max(special.items(), key=lambda x: x[1])
        self.opens = self.mark[:2]
        spec = json.loads(self.tok.to_str())
        steps = [[x["type"] for x in (spec[k] or {}).get(part, [])] for k, part in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        suffix = spec["model"].get("end_of_word_suffix")
        if (steps[0], steps[1]) != STEPS_KNOWN or not suffix or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": SPLIT}:
            raise ValueError(f"{path}: words can't be encoded apart for this tokenizer")
        self.runs = Tokenizer.from_str(self.tok.to_str())
        self.runs.normalizer = None
        self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)])
        self.ends_word = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        """Known words with their hashes (sorted, with each one's number), where their ids
        begin, how many they are, and in how many slices the word came."""
        self.words = pa.array([], pa.large_string())
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.start, self.size, self.hits = np.zeros(0, np.uint32), *(np.zeros(0, np.int32) for _ in range(3))

    def shrink(self) -> None:
        """Forget the words that came in one slice only, or all if most came again."""
        kept = np.flatnonzero(self.hits > 1)
        if len(kept) > CACHE_WORDS // 2:
            kept = kept[:0]
        words, hits, hashes = self.words.take(pa.array(kept)), np.ones(len(kept), np.int32), np.empty(len(self.words), np.uint64)
        hashes[self.number] = self.hashes
        ids, size = gathered(self.ids, self.start[kept], self.size[kept]), self.size[kept]
        self.clear()
        self.add(words, hashes[kept], ids, size)
        self.hits = hits

    def add(self, words: pa.Array, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.number = np.insert(self.number, at, (len(self.words) + order).astype(np.int32))
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.words = pa.concat_arrays([self.words, words])
        self.start = np.append(self.start, (len(self.ids) + np.cumsum(size) - size).astype(np.int32))
        self.size, self.hits = np.append(self.size, size.astype(np.int32)), np.append(self.hits, np.zeros(len(size), np.int32))
        self.ids = np.append(self.ids, ids)

    def encode_plain(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [[w] if w.isalpha() else RUN.findall(w) for w in plain]
        texts = [" ".join([" ".join(x) for x in parts[i:i + 250]]) for i in range(0, len(parts), 250)]
        got = self.runs.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in got])
        ends = np.flatnonzero(self.ends_word[ids])[np.cumsum([len(x) for x in parts]) - 1] + 1
        return ids, np.diff(ends, prepend=0)

    def encode_others(self, others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tok.encode_batch_fast([self.mark.join(others) + self.mark], add_special_tokens=False)[0].ids, np.uint32)
        mark = ids == self.mark_id
        return ids[~mark], np.diff(np.flatnonzero(mark), prepend=-1) - 1

    def encode(self, words: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' order of encoding, their ids one after the other in that order, and
        how many each has. A word that may hold a special token goes alone."""
        odd = np.array([self.opens in w for w in words], bool)
        places = [np.flatnonzero(plain), np.flatnonzero(~plain & ~odd), np.flatnonzero(odd)]
        done = [self.encode_plain([words[i] for i in places[0]])] if len(places[0]) else []
        for k in range(0, len(places[1]), 10_000):
            done.append(self.encode_others([words[i] for i in places[1][k:k + 10_000]]))
        for i in places[2]:
            ids = np.array(self.tok.encode(words[i], add_special_tokens=False).ids, np.uint32)
            done.append((ids, np.array([len(ids)])))
        return np.concatenate(places), np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])

    def lookup(self, u: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``self.ids`` the ids of each distinct word begin, and how many they are."""
        plain = pc.and_(pc.match_substring_regex(u, PLAIN), pc.invert(pc.match_substring(u, self.opens)))
        # lower-casing a plain word before the tokenizer does changes nothing
        lowered = pc.if_else(plain, pc.utf8_lower(whole(u)), u).dictionary_encode()
        u, back = lowered.dictionary, lowered.indices.to_numpy(zero_copy_only=False)
        is_plain = np.zeros(len(u), bool)
        is_plain[back] = plain.to_numpy(zero_copy_only=False)
        if len(self.words) + len(u) > CACHE_WORDS:
            self.shrink()
        hashes = word_hash(u)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(u), bool)
        number = np.where(known, self.number[at], 0) if len(self.hashes) else np.zeros(len(u), np.int32)
        here = np.flatnonzero(known)
        clash = here[~pc.equal(self.words.take(pa.array(number[here])), u.take(pa.array(here))).to_numpy(zero_copy_only=False)]
        known[clash] = False
        self.hits[number[known]] += 1
        new = np.flatnonzero(~known)
        if len(new):
            order, ids, size = self.encode(u.take(pa.array(new)).to_pylist(), is_plain[new])
            new = new[order]
            number[new] = len(self.words) + np.arange(len(new))
            self.add(u.take(pa.array(new)), hashes[new], ids, size)
            self.hits[number[new]] = 1
            if len(clash):  # two words of one hash: neither can be told by it
                self.hashes, self.number = self.hashes[~np.isin(self.hashes, hashes[clash])], self.number[~np.isin(self.hashes, hashes[clash])]
        return self.start[number][back], self.size[number][back]


def gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``start``, one after the other."""
    to = np.cumsum(size, dtype=np.int32)
    at = np.repeat(start - (to - size), size)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at]


_LOADED: dict[str, WordIds] = {}
CACHES.append(_LOADED)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids one after the other, and where each text's ids begin and end."""
    enc = _LOADED.get(path) or _LOADED.setdefault(path, WordIds(path))
    row, u, ix = words(texts, lower=False)
    start, size = enc.lookup(u)
    size = size[ix]
    per_row = np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64)
    return gathered(enc.ids, start[ix], size), np.concatenate([[0], np.cumsum(per_row)])


def piece_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN,
               end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document; ``keep_ids`` adds the ids themselves as ``ids``."""
    schema = PIECE + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", TOKEN_SLICE, keep_caches=True):
                flat, at = token_ids(part.column("t"), path)
                out: list[list] = [[] for _ in range(6 if keep_ids else 5)]
                for i, d in enumerate(part.column("did").to_pylist()):
                    ids = np.append(flat[at[i]:at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), max_len)):
                        own = ids[s:s + max_len]
                        for to, x in zip(out, (d, k, s, len(own), zlib.crc32(own.tobytes()), own.astype(np.int32)), strict=False):
                            to.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["did", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=False)], names[:len(out)])

    ship(docs.sparkSession)
    return docs.select(known_id(F.col(id_col)).alias("did"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, cap: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # sorted distinct free spaces
    at: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        k = bisect_left(rooms, n)
        if k == len(rooms):
            b, room = len(bins), cap
            bins.append([])
        else:
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                del at[room], rooms[k]
        bins[b].append(i)
        if room > n:
            if room - n not in at:
                at[room - n] = []
                insort(rooms, room - n)
            at[room - n].append(b)
    return bins


#: Emptiest bins that the search tries to empty before it gives up.
TARGETS = 20
#: Of a bin with more pieces, pairs are formed of so many of the largest; a bin of
#: many small pieces is filled by moves anyway.
PAIRED = 40


def pair_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top = np.argsort(-x, kind="stable")[:PAIRED]
    i, j = np.triu_indices(len(top), 1)
    i, j = top[i], top[j]
    s = x[i] + x[j]
    order = np.argsort(s, kind="stable")
    return s[order], i[order], j[order]


def best_exchange(t: np.ndarray, a: np.ndarray, room: int) -> tuple[int, list[int], list[int]]:
    """What to take from bin ``t`` and give back from bin ``a`` so that ``a`` gains
    the most, up to its free ``room``: gain, places in ``t``, places in ``a``."""
    best: tuple[int, list[int], list[int]] = (0, [], [])
    zero = (np.zeros(1, np.int64), [[]])
    order_t, order_a = np.argsort(t, kind="stable"), np.argsort(a, kind="stable")
    one_t = (t[order_t], [[int(i)] for i in order_t])
    one_a = (a[order_a], [[int(i)] for i in order_a])
    two_t, ti, tj = pair_sums(t)
    two_a, ai, aj = pair_sums(a)
    forms = [(one_t, zero), (one_t, one_a), ((two_t, (ti, tj)), one_a), (one_t, (two_a, (ai, aj)))]

    def places(side, k: int) -> list[int]:
        return [int(side[1][0][k]), int(side[1][1][k])] if isinstance(side[1], tuple) else side[1][k]

    for take, give in forms:
        if not len(take[0]) or not len(give[0]):
            continue
        k = np.searchsorted(take[0], give[0] + room, side="right") - 1  # the largest that fits
        gain = np.where(k >= 0, take[0][np.maximum(k, 0)] - give[0], 0)
        g = int(gain.argmax())
        if gain[g] > best[0]:
            best = (int(gain[g]), places(take, int(k[g])), places(give, g))
        if best[0] == room:
            break
    return best


def local_search(bins: list[list[int]], lengths: np.ndarray, cap: int) -> list[list[int]]:
    """Empty bins by moves and exchanges; every step raises the sum of squared
    fills. Ends when the free space is less than a bin (no fewer bins can hold
    the items) or when none of the ``TARGETS`` emptiest bins can give anything away."""
    bins = [list(b) for b in bins]
    free = [cap - int(lengths[b].sum()) for b in bins]
    stuck: set[int] = set()
    while len(stuck) < TARGETS and sum(free[b] for b in range(len(bins)) if bins[b]) >= cap:
        under = sorted((b for b in range(len(bins)) if bins[b] and free[b]), key=lambda b: free[b])
        target = next((b for b in reversed(under) if b not in stuck), None)
        if target is None:
            break
        moved = False
        for b in under:
            if b == target or free[b] > free[target]:  # a fuller bin gains, so squares rise
                continue
            if not bins[target]:
                break
            gain, take, give = best_exchange(lengths[bins[target]], lengths[bins[b]], free[b])
            if gain <= 0:
                continue
            out, back = [bins[target][i] for i in take], [bins[b][i] for i in give]
            bins[target] = [x for i, x in enumerate(bins[target]) if i not in take] + back
            bins[b] = [x for i, x in enumerate(bins[b]) if i not in give] + out
            free[target] += gain
            free[b] -= gain
            moved = True
            stuck.discard(b)
        if not moved:
            stuck.add(target)
    return [b for b in bins if b]


def pack_group(rows: pd.DataFrame, cap: int, base: int) -> pd.DataFrame:
    lengths = rows["length"].to_numpy(np.int64)
    seq, off = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    room = np.zeros(len(rows), np.int64)
    for k, b in enumerate(local_search(best_fit(lengths, cap), lengths, cap)):
        ends = np.cumsum(lengths[b])
        seq[b], off[b], room[b] = base + k, ends - lengths[b], cap - ends[-1]
    return rows.assign(sequence_id=seq, offset=off, room=room)


def packer(cap: int, turn: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pack_group(rows.drop(columns="g").sort_values("uid"), cap, (turn << 55) + (int(key[0]) << 24))

    return run


def pack_pieces(pieces: DataFrame, cap: int = MAX_LEN, group_bins: int = GROUP_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces`` (a saved table
    with ``uid``, a unique number, and ``length``)."""
    cols = pieces.columns
    done = pieces.where(F.col("length") >= cap).select(*cols, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.where(F.col("length") < cap)
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long").add("room", "long")
    rest, bins = None, None  # what the turn before left in loose bins, and their number
    for turn in range(1, TURNS + 1):
        total = left.agg(F.sum("length")).first()[0] or 0
        if not total:
            return done
        groups = -(-total // (cap * group_bins))
        dealt = left.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)).cast("long"))

        packed = save(dealt.groupBy("g").applyInPandas(packer(cap, turn), schema), "packed")
        loose = packed.where(F.col("room") >= cap // LOOSE)
        now = packed.where(F.col("offset") == 0).agg(F.count("*").alias("all"), F.count_if(F.col("room") >= cap // LOOSE).alias("loose")).first()
        if bins is not None and now["all"] >= bins:
            return done.unionByName(rest)  # the bins of the turn before were as few
        done = done.unionByName(packed.where(F.col("room") < cap // LOOSE).drop("room"))
        rest = loose.drop("room")
        if groups == 1 or (bins is not None and (bins - now["all"]) * LEAST_EMPTIED < bins):
            break
        # bins with much room go through again with those of other groups
        left, bins = loose.select(cols), now["loose"]
    return done.unionByName(rest)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN,
                   end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row per piece: ``did``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``
    and ``offset`` (and ``ids``, to fill the sequences with)."""
    pieces = save(piece_rows(docs, path, id_col, text_col, max_len, end_id, keep_ids)
                  .withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces, max_len)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, of at most ``max_len`` ids, from rows with ``ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_columns(pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def packed_columns(packed: DataFrame) -> DataFrame:
    return packed.select(given_id(F.col("did")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

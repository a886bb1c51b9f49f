"""Fill-in-middle: documents cut into prefix, middle and suffix, and put together in
another order by a secondary sort.

A text's units are runs of ASCII letters and single other code points. Hashes of the
id say where it is cut and which form it gets: ``psm`` (``<P>`` prefix ``<S>`` suffix
``<M>`` middle), ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle) or ``plain``.
The text leaves its task as pieces of at most ``UNITS`` units and ``PIECE_BYTES`` bytes,
keyed by document and by their position in the output. A repartition by document
and a sort within the partitions by that key (the DataFrame form of
``repartitionAndSortWithinPartitions``, which spills and is not held in Python) bring
each output past one task as a stream, and its digest grows piece by piece. The
same stream is read as the output alone: the marks found in it, and the form, say
which part each byte belongs to, and the bytes go on, keyed by document and position in
the text. They lie in the right partition already, so for the restored text they
are only sorted again, without a second shuffle, and digested as they stream by.

No task holds more than a few pieces at a time, but for the texts of the input batch
that it cuts. Rows are keyed by a number of their own, so equal ids and copies of one
document spread over all tasks.

Defined cases: a null text is empty and plain; a text that holds a mark is plain; rows
that repeat an id, with or without the text, are cut alike and come out once each; a
null id is hashed as empty text and comes out null; an empty table gives an
empty result. Texts are cut whole; of a unit longer than a piece each piece but the
last holds ``PIECE_BYTES`` bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.arrow_text import slices, whole
from rampstat.llm.common import ship, table, text_of

#: A piece holds so many units and bytes at most.
UNITS = 4096
PIECE_BYTES = 1 << 16
SEED = 1
#: Of 100 documents so many stay plain, and of 100 others so many are spm.
PLAIN_PERCENT = 10
SPM_PERCENT = 20

P, S, M = b"<P>", b"<S>", b"<M>"
MARK = re.compile(b"<[PSM]>")
MARK_BEGUN = re.compile(b"<[PSM]?$")
#: Place in the text of the part that follows a mark.
PLACE = {P: 0, M: 1, S: 2}
ORDER = {"psm": (P, S, M), "spm": (S, P, M)}

HEAD = "n long, form string, prefix_chars long, middle_chars long"
PIECE = f"uid long, did long, pos long, {HEAD}, piece binary"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which units begin, over all texts of ``data`` that begin at ``at``, and
    the place among them of each text's first unit (and of the end)."""
    letter = _LETTER[data]
    after = np.zeros(len(data), bool)
    after[1:] = letter[:-1]
    after[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(((data & 0xC0) != 0x80) & ~(letter & after))
    return starts, np.searchsorted(starts, at)


def cut_pieces(text: bytes, starts: np.ndarray, a: int, b: int, most: tuple[int, int]) -> Iterator[bytes]:
    """The units ``a`` to ``b`` of a text whose units begin at ``starts`` (its end last),
    in pieces of at ``most`` so many units and bytes."""
    edges = [*starts[a:b:most[0]].tolist(), int(starts[b])]
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        for z in range(x, y, most[1]):
            yield text[z:min(z + most[1], y)]


def output_pieces(text: bytes, starts: np.ndarray, h: np.ndarray, marked: bool, most: tuple[int, int]) -> tuple[tuple, list[bytes]]:
    """``n``, form, code points of prefix and middle, and the output in pieces."""
    n = len(starts) - 1
    if not text or marked or h[2] % 100 >= 100 - PLAIN_PERCENT:
        return (n, "plain", None, None), list(cut_pieces(text, starts, 0, n, most)) or [b""]
    x, y = sorted((int(h[0] % (n + 1)), int(h[1] % (n + 1))))
    form = "spm" if h[3] % 100 < SPM_PERCENT else "psm"
    part = {P: (0, x), M: (x, y), S: (y, n)}
    out = [piece for mark in ORDER[form] for piece in (mark, *cut_pieces(text, starts, *part[mark], most))]
    chars = [len(text[starts[a]:starts[b]].decode()) for a, b in (part[P], part[M])]
    return (n, form, *chars), out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
           units: int = UNITS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The outputs as pieces: ``uid`` (the row), ``did``, ``pos`` (in the output), ``piece``, and
    on the first piece of each row ``n``, ``form``, ``prefix_chars``, ``middle_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                t = whole(part.column("t"))
                at = np.frombuffer(t.buffers()[1], np.int64)[:len(t) + 1]
                data = np.frombuffer(t.buffers()[2] or b"", np.uint8)[:at[-1]]
                starts, first = bounds(data, at)
                hashes = [np.frombuffer(x, ">u4").astype(np.int64) for x in part.column("h").to_pylist()]
                rows = []
                for i, (uid, did, marked) in enumerate(zip(*(part.column(c).to_pylist() for c in ("uid", "did", "marked")), strict=True)):
                    own = np.append(starts[first[i]:first[i + 1]], at[i + 1]) - at[i]
                    head, out = output_pieces(data[at[i]:at[i + 1]].tobytes(), own, hashes[i], marked, (units, piece_bytes))
                    rows += [(uid, did, pos, *(head if pos == 0 else (None,) * 4), piece) for pos, piece in enumerate(out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    ship(docs.sparkSession)
    t = text_of(F.col(text_col).cast("string"))
    marked = F.contains(t, F.lit("<P>")) | F.contains(t, F.lit("<S>")) | F.contains(t, F.lit("<M>"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")))
    d = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("did"), t.alias("t"),
                    F.substring(F.unhex(F.sha2(name, 256)), 1, 16).alias("h"), marked.alias("marked"))
    return d.mapInArrow(run, PIECE)


_NAMES = [x.split()[0] for x in PIECE.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in PIECE.split(", ")]


def assembled(parts: DataFrame) -> DataFrame:
    """The pieces of each output one after the other in one task."""
    return parts.repartition("uid").sortWithinPartitions("uid", "pos")


class Reader:
    """Takes an output piece by piece and says where in the text each byte belongs."""

    def __init__(self, form: str):
        self.form, self.place, self.held = form, 0, b""

    def feed(self, piece: bytes, end: bool = False) -> Iterator[tuple[int, bytes]]:
        """(place of the part in the text, bytes); the start of what may be a mark waits."""
        if self.form == "plain":
            yield 0, piece
            return
        data, done = self.held + piece, 0
        for found in MARK.finditer(data):
            if found.start() > done:
                yield self.place, data[done:found.start()]
            self.place, done = PLACE[found.group()], found.end()
        begun = None if end else MARK_BEGUN.search(data, done)
        self.held = data[begun.start():] if begun else b""
        rest = data[done:len(data) - len(self.held)]
        if rest:
            yield self.place, rest


SORTED_BACK = f"uid long, place int, pos long, did long, {HEAD}, output_sha256 string, piece binary"


def digest_outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the outputs: a row for each output with its digest
    (``place`` -1), and its bytes keyed by their place in the text."""
    head = reader = digest = None
    uid, pos, out = None, 0, []

    def end() -> None:
        for place, x in reader.feed(b"", end=True):
            if x:
                out.append((uid, place, pos + 1, None, None, None, None, None, None, x))
        out.append((uid, -1, 0, *head, digest.hexdigest(), None))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            if row[0] != uid:
                if uid is not None:
                    end()
                uid, pos = row[0], 0
                head, reader, digest = (row[1], *row[3:7]), Reader(row[4]), hashlib.sha256()
            digest.update(row[7])
            for place, x in reader.feed(row[7]):
                pos += 1
                out.append((uid, place, pos, None, None, None, None, None, None, x))
        yield _back(out)
        out = []
    if uid is not None:
        end()
        yield _back(out)


_BACK = [(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in SORTED_BACK.split(", ")]


def _back(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_BACK)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _BACK, strict=True)], names=[x for x, _ in _BACK])


RESULT = f"did long, {HEAD}, output_sha256 string, restored_sha256 string"


def digest_restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``digest_outputs`` in the order of the texts: a row for each document."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    head = digest = None
    done = []
    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x, _ in _BACK), strict=True):
            if row[1] == -1:
                if head is not None:
                    done.append((*head, digest.hexdigest()))
                head, digest = row[3:9], hashlib.sha256()
            else:
                digest.update(row[9])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done = []
    if head is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*head, digest.hexdigest()), types, strict=True)], names=names)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
            units: int = UNITS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per row: ``did``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, and the SHA-256 of its
    output and of the text restored from that."""
    out = assembled(pieces(docs, id_col, text_col, seed, units, piece_bytes)).mapInArrow(digest_outputs, SORTED_BACK)
    return out.sortWithinPartitions("uid", "place", "pos").mapInArrow(digest_restored, RESULT)


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The outputs themselves, one text per row: ``did``, ``n``, ``form``, ``output``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, head, parts = None, None, []

        def text() -> pa.RecordBatch:
            whole_text = b"".join(parts).decode()
            return pa.RecordBatch.from_arrays([pa.array([head[0]], pa.int64()), pa.array([head[1]], pa.int64()), pa.array([head[2]]), pa.array([whole_text])],
                                              names=["did", "n", "form", "output"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                if row[0] != uid:
                    if uid is not None:
                        yield text()
                    uid, head, parts = row[0], (row[1], row[3], row[4]), []
                parts.append(row[7])
        if uid is not None:
            yield text()

    return assembled(pieces(docs, id_col, text_col, seed)).mapInArrow(run, "did long, n long, form string, output string")


def restored(outputs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """All columns of ``outputs`` in ``row``, and ``text``, rebuilt from output and form."""
    o, form = F.col(output_col), F.col(form_col)
    between = lambda a, b: F.regexp_extract(o, f"(?s){a}(.*?){b}", 1)
    psm = F.concat(between("^<P>", "<S>"), between("<M>", r"\z"), between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), between("<M>", r"\z"), between("^<S>", "<P>"))
    row = F.struct(*[F.col(f"`{c}`") for c in outputs.columns]).alias("row")
    return outputs.select(row, F.when(form == "psm", psm).when(form == "spm", spm).otherwise(o).alias("text"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("did", "doc_id")


ORACLE = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || x[1:8])::UBIGINT AS h1,
      ('0x' || x[9:16])::UBIGINT AS h2, ('0x' || x[17:24])::UBIGINT AS h3, ('0x' || x[25:32])::UBIGINT AS h4 FROM h),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a,
      greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, array_to_string(units[1:a], '') AS p,
      array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM f
"""

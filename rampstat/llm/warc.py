"""WARC archives: writing with revisit records, and a salvage reader.

``write_archives`` writes a record per page, each its own gzip member, into
archives of bounded size in a shared folder. An archive's name is made anew by
every attempt of a task, and only the index rows of the attempt that Spark
commits name it, so lost executors, retries and speculative copies leave stray
files but never a wrong or half-written archive in the index.

``read_archives`` reads archives back, each as a stream in one task. A record
is checked (member decompresses, version line, header block, Content-Length,
block digest). After a failed check the reader looks for the next gzip member
or version line that begins a valid record, goes on from there, and logs the
bytes between as a quarantined gap.

Defined cases: a null html is an empty payload; of the pages with one payload
(of at least ``min_revisit`` bytes), those with the smallest page id are
responses and others revisits, so rows repeating that page id are
responses too; a null page id ranks as the largest one and comes back null; an
empty table writes no archive and gives no rows. One payload must fit memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.common import NO_ID, known_id, save, scratch_path, ship, table

ARCHIVE_BYTES = 32 << 20
#: Tasks that archives are dealt to, at most.
MOST_TASKS = 1 << 15
MIN_REVISIT = 0
#: Bytes read at a time.
CHUNK = 1 << 20
#: A length beyond this is taken for damage, not read into memory.
MAX_RECORD = 1 << 30
MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: Date of the written records: fixed, so the archives depend on the pages alone.
DATE = "2024-01-01T00:00:00Z"

INDEX = "archive string, size long, records long"
RECORD = ("archive string, offset long, length long, record_type string, record_id string, target_uri string, "
          "refers_to string, payload_digest string, payload_bytes long, payload binary, gap_reason string")


# -- writing -----------------------------------------------------------------


def record_name(pid: int) -> str:
    return f"<urn:page:{'none' if pid == NO_ID else pid}>"


def page_of(name: str) -> Column:
    """The page id within a column of record names; ``none`` gives null."""
    n = F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1)
    return F.when(n != "", n).cast("long")


def record_bytes(kind: str, pid: int, uri: str, payload: bytes, digest: str, first: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_name(pid),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]+", "%0A", uri),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        head |= {"WARC-Refers-To": record_name(first), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def sha1(x: bytes) -> str:
    return base64.b32encode(hashlib.sha1(x).digest()).decode()  # noqa: S324 - the archive format's digest


def member(x: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(x) + z.flush()


def filesystem(folder: str):
    """The file system of a folder that executors share, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else re.sub(r"^(file:)?/*", "file:///", folder))


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit: int) -> DataFrame:
    """Pages with ``first``, the page whose payload a revisit refers to, else null.
    Payload digests alone are grouped; the pages themselves move once, by id."""
    p = pages.select(known_id(F.col(id_col)).alias("pid"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("uri"),
                     F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload")))
    own = p.where(F.octet_length("payload") >= min_revisit).select("pid", "sha")
    firsts = own.groupBy("sha").agg(F.min("pid").alias("first"), F.max("pid").alias("last")).where("first < last").drop("last")
    again = own.distinct().join(firsts, "sha").where("pid <> first").select(
        F.col("pid").alias("rpid"), F.col("sha").alias("rsha"), "first")
    return p.join(again, (p.pid == again.rpid) & (p.sha == again.rsha), "left").select("pid", "uri", "payload", "first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES, compress: bool = True) -> DataFrame:
    """Write the archives and return their index (a saved table): ``archive`` (file
    name within ``folder``), ``size``, ``records``."""
    spark = pages.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "size": [size], "records": [count]})

        for batch in batches:
            for pid, uri, payload, first in zip(*(batch.column(c) for c in ("pid", "uri", "payload", "first")), strict=True):
                pid, uri, payload, first = pid.as_py(), uri.as_py(), payload.as_py(), first.as_py()
                if out is not None and size >= archive_bytes:
                    yield closed()
                    out = None
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                kind = "response" if first is None else "revisit"
                x = record_bytes(kind, pid, uri, payload, sha1(payload), first)
                x = member(x) if compress else x
                out.write(x)
                size, count = size + len(x), count + 1
        if out is not None:
            yield closed()

    return save(with_revisits(pages, id_col, url_col, html_col, min_revisit).mapInArrow(run, INDEX), "warc-index")


# -- reading -----------------------------------------------------------------


class Window:
    """Random access to the part of a stream from ``start`` on; what lies before
    is forgotten, so an archive of any length needs memory for a record or two."""

    def __init__(self, stream):
        self.stream, self.start, self.data, self.ended = stream, 0, bytearray(), False

    def upto(self, n: int) -> bool:
        """Whether bytes up to offset ``n`` of the file are there."""
        while self.start + len(self.data) < n and not self.ended:
            got = self.stream.read(CHUNK)
            self.ended = not got
            self.data += got
        return self.start + len(self.data) >= n

    def forget(self, n: int) -> None:
        del self.data[:n - self.start]
        self.start = n

    def bytes(self, a: int, b: int) -> bytes:
        self.upto(b)
        return bytes(self.data[a - self.start:b - self.start])

    def find(self, marks: tuple[bytes, ...], a: int) -> int:
        """Offset of the next mark at or after ``a``, or -1; forgets what it passes."""
        while True:
            hits = [h for h in (self.data.find(m, a - self.start) for m in marks) if h >= 0]
            if hits:
                return self.start + min(hits)
            a = max(a, self.start + len(self.data) - max(map(len, marks)) + 1)
            if self.ended:
                return -1
            self.upto(self.start + len(self.data) + 1)


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("version line")
    fields = [x.split(":", 1) for x in lines[1:]]
    if any(len(x) != 2 for x in fields):
        raise ValueError("header line")
    return {k.strip().lower(): v.strip() for k, v in fields}


def checked(head: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    want = head.get("warc-block-digest")
    if want and want != f"sha1:{sha1(block)}":
        raise ValueError("block digest")
    return head, block


def header_end(w: Window, at: int) -> int:
    """Offset of the end of the header block that begins at ``at``, however long its fields
    are; a line that begins another record is damage."""
    seen = at
    while True:
        end = w.data.find(b"\r\n\r\n", seen - w.start)
        if w.data.find(b"\r\n" + VERSION, seen - w.start, end if end >= 0 else len(w.data)) >= 0:
            raise ValueError("header block")
        if end >= 0:
            return w.start + end
        read = w.start + len(w.data)
        if read - at > MAX_RECORD or not w.upto(read + 1):
            raise ValueError("header block")
        seen = max(at, read - len(VERSION) - 1)


def plain_record(w: Window, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields and block of the record at ``at``, and where it ends."""
    end = header_end(w, at)
    head = parsed(w.bytes(at, end))
    size = int(head["content-length"])
    if not 0 <= size <= MAX_RECORD or not w.upto(end + 4 + size + 4):
        raise ValueError("record is cut short")
    if w.bytes(end + 4 + size, end + 8 + size) != b"\r\n\r\n":
        raise ValueError("record end")
    return *checked(head, w.bytes(end + 4, end + 4 + size)), end + 8 + size


def gzip_record(w: Window, at: int) -> tuple[dict[str, str], bytes, int]:
    z, out, pos = zlib.decompressobj(31), bytearray(), at
    while not z.eof:
        if not w.upto(pos + 1):
            raise ValueError("member is cut short")
        part = w.bytes(pos, min(pos + CHUNK, w.start + len(w.data)))
        try:
            out += z.decompress(part)
        except zlib.error as e:
            raise ValueError(f"member: {e}") from e
        pos += len(part)
    pos -= len(z.unused_data)
    cut = out.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("header block")
    head = parsed(bytes(out[:cut]))
    size = int(head["content-length"])
    if len(out) != cut + 8 + size or out[cut + 4 + size:] != b"\r\n\r\n":
        raise ValueError("record length")
    return *checked(head, bytes(out[cut + 4:cut + 4 + size])), pos


def salvage(stream) -> Iterator[tuple]:
    """``("record", offset, length, fields, block)`` for each valid record, and
    ``("gap", offset, length, reason)`` for each run of bytes in quarantine."""
    w, at, gap, why = Window(stream), 0, None, ""
    while w.upto(at + 1):
        try:
            begins = w.bytes(at, at + len(VERSION))
            if begins[:len(MEMBER)] == MEMBER:
                head, block, end = gzip_record(w, at)
            elif begins == VERSION:
                head, block, end = plain_record(w, at)
            else:
                raise ValueError("no record begins here")
        except (ValueError, KeyError) as e:
            if gap is None:
                gap, why = at, str(e) or type(e).__name__
            at = w.find((MEMBER, VERSION), at + 1)
            if at < 0:
                break
            w.forget(at)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why
            gap = None
        yield "record", at, end - at, head, block
        w.forget(end)
        at = end
    if gap is not None:
        yield "gap", gap, w.start + len(w.data) - gap, why


def read_archives(index: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """A row per record and per quarantined gap (``record_type`` ``gap``) of the
    archives that ``index`` names. Each archive is a task's unit of work."""
    ship(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]
        store, base = filesystem(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for x in salvage(stream):
                        if x[0] == "gap":
                            rows.append((name, x[1], x[2], "gap", *[None] * 4, None, None, x[3]))
                        else:
                            rows.append((name, x[1], x[2], *record_row(x[3], x[4], keep_payload), None))
                            held += len(x[4]) if keep_payload else 0
                        if len(rows) >= 2000 or held >= 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    # a number of partitions of their own: by size alone, names would all be put in one task
    tasks = max(1, min(index.count(), MOST_TASKS))
    return index.select("archive").repartition(tasks, "archive").mapInArrow(run, RECORD)


def record_row(head: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    """Type, id, target, reference, digest, size and bytes of the payload. The
    payload of a revisit is elsewhere; its HTTP header still tells its size."""
    kind = head.get("warc-type", "")
    http, _, body = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    payload = body if kind == "response" else None
    size = int(said[1]) if said else len(body)
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if payload is not None:
        size, digest = len(payload), sha1(payload)
    return (kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest, size,
            payload if keep_payload else None)


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    back = read_archives(index, folder, keep_payload=False).where("record_type <> 'gap'")
    return back.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       page_of("refers_to").alias("refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(s, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

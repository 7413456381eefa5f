"""WARC archives as a chunked record table.

A record is one or more rows (record, chunk number, bytes). Payloads are cut into
chunks once, as they are read, with the SHA-1 and the length so far; the chunk
rows go into files of bounded size in the shared folder. Which record revisits
which is decided on narrow rows (number, size, digest). Archives are then written
from the chunk files, a chunk at a time, into gzip members, and the chunks of
revisits are passed over; readers hand out rows of at most ``chunk`` payload bytes.
Payloads are never shuffled, and past the scan of ``pages``, which holds a batch of
them, no task holds more than a few chunks.

Files are written and read through ``pyarrow.fs`` by URI, on the executors, in
the folder that the cluster shares. A task writes a file under a name of its own
and reports it when it is complete; only reported files are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, steps

CHUNK = 1 << 20
#: A file of chunks ends beyond so many bytes or records.
FILE_BYTES, FILE_RECORDS = 64 << 20, 100_000
SALTS = 16
URN = "urn:page:"
DATE = "1970-01-01T00:00:00Z"
FIELDS = "file string, record string, chunk_no int, record_type string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, last boolean"


ROWS = pa.schema([("number", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("payload", pa.binary()), ("size", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])
RECORDS = "file string, number long, page_id long, size long, digest string"


def _opened_output(name: str):
    store, path = fs.FileSystem.from_uri(name)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


class Chunks:
    """A file of chunk rows that is being written, in batches of a few chunks."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.arrow"
        self.raw = _opened_output(self.name)
        self.out = pa.ipc.new_stream(self.raw, ROWS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3)))
        self.rows: list[tuple] = []
        self.held = self.bytes = self.records = 0

    def add(self, page: int | None, url: str | None, payload: memoryview, chunk: int) -> tuple:
        """Write one record; its row of RECORDS."""
        digest, number = hashlib.sha1(usedforsecurity=False), self.records
        for no, at in enumerate(range(0, max(len(payload), 1), chunk)):
            part = payload[at : at + chunk]
            digest.update(part)
            done = at + len(part)
            self.rows.append((number, page, url, no, part, done, digest.hexdigest(), done == len(payload)))
            self.held += len(part) + 128
            if self.held >= 4 * CHUNK:
                self.flush()
        self.records, self.bytes = number + 1, self.bytes + len(payload)
        return self.name, number, page, len(payload), digest.hexdigest()

    def flush(self) -> None:
        if self.rows:
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), ROWS.types, strict=True)], schema=ROWS))
        self.rows, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()
        self.raw.close()


def chunked(pages: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Write the chunk rows of (page_id, url, payload) below ``folder``; the narrow rows of RECORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Chunks | None = None
        for batch in batches:
            made = []
            for page, url, payload in zip(batch.column("page_id"), batch.column("url"), batch.column("payload"), strict=True):
                out = out or Chunks(folder)
                made.append(out.add(page.as_py(), url.as_py(), memoryview(payload.as_buffer() or b""), chunk))
                if out.bytes >= FILE_BYTES or out.records >= FILE_RECORDS:
                    out.close()
                    out = None
            if made:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])
        if out:
            out.close()

    return pages.select("page_id", "url", "payload").mapInArrow(run, RECORDS)


def decided(records: DataFrame, least: int = 1000) -> DataFrame:
    """(file, number, refers_to): the records that revisit a page, and which.

    Of records with equal payloads of at least ``least`` bytes, that with the
    largest page number is the response; records with another number refer to it. A
    payload that very many records share meets its response in SALTS tasks.
    """
    again = records.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("c")).where("c > 1 and keeper is not null").drop("c")
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = records.where(F.col("size") >= least).withColumn("salt", F.pmod(F.xxhash64("file", "number"), F.lit(SALTS)).cast("int"))
    rows = rows.join(again.hint("merge"), ["digest", "size", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("keeper")))
    return rows.select("file", "number", F.col("keeper").alias("refers_to"))


def _line(name: str, value: object) -> bytes:
    return b"" if value is None else f"{name}: {str(value).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n".encode()


def _head(r: dict) -> bytes:
    size, digest, refers = r["size"], r["digest"], r["refers_to"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", size) + b"\r\n"
    ident = "" if r["page_id"] is None else r["page_id"]
    out = b"WARC/1.1\r\n" + _line("WARC-Type", "response" if refers is None else "revisit") + _line("WARC-Record-ID", f"<{URN}{ident}>") + _line("WARC-Date", DATE) + _line("WARC-Target-URI", r["url"])
    out += _line("WARC-Payload-Digest", f"sha1:{digest}") + _line("X-Payload-Length", size) + _line("Content-Type", "application/http; msgtype=response")
    if refers is not None:
        out += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") + _line("WARC-Refers-To", f"<{URN}{refers}>")
    return out + _line("Content-Length", len(http) + (size if refers is None else 0)) + b"\r\n" + http


def write(records: DataFrame, revisits: DataFrame, uri: str, *, level: int = 3) -> DataFrame:
    """Write the files of chunk rows that ``records`` name as gzipped archives below ``uri``; (file, records), one row for each archive.

    The revisits of a file come to it as one row, which is as bounded as the file.
    """
    files = records.groupBy("file").agg(F.count("*").alias("n"))
    told = revisits.groupBy("file").agg(F.collect_list(F.struct("number", "refers_to")).alias("revisits"))
    rows = files.join(told.hint("merge"), "file", "left")
    rows = rows.repartition(max(1, 2 * files.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _archive(row["file"], {x["number"]: x["refers_to"] for x in row["revisits"] or ()})

    def _archive(chunks: str, refers: dict[int, int]) -> pa.RecordBatch:
        # headers need the size and digest of the whole payload, which the last chunk carries
        store, path = fs.FileSystem.from_uri(chunks)
        totals = {}
        with store.open_input_stream(path) as raw, pa.ipc.open_stream(raw) as got:
            for part in got:
                part = part.filter(part.column("last"))
                totals.update(zip(part.column("number").to_pylist(), zip(part.column("size").to_pylist(), part.column("digest").to_pylist(), strict=True), strict=True))
        name, packer = f"{uri}/{uuid.uuid4().hex}.warc.gz", None
        with _opened_output(name) as out, store.open_input_stream(path) as raw, pa.ipc.open_stream(raw) as got:
            for part in got:
                payload = part.column("payload")
                heads = part.select(["number", "page_id", "url", "chunk_no", "last"]).to_pylist()
                for i, r in enumerate(heads):
                    number = r["number"]
                    if r["chunk_no"] == 0:
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        size, digest = totals[number]
                        out.write(packer.compress(_head(r | {"size": size, "digest": digest, "refers_to": refers.get(number)})))
                    if number not in refers:
                        out.write(packer.compress(payload[i].as_buffer()))
                    if r["last"]:
                        out.write(packer.compress(b"\r\n\r\n"))
                        out.write(packer.flush())
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(totals)], pa.int64())], names=["file", "records"])

    return rows.mapInArrow(run, "file string, records long")


def _fields(f: io.BufferedReader) -> dict[str, str] | None:
    """The first line (under the empty name) and the named fields of a header block, or None at the end of the file."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    got = {"": line.decode().strip()}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        k, _, v = line.decode().partition(":")
        got[k.strip().lower()] = v.strip()
    return got


def records(f: io.BufferedReader, chunk: int = CHUNK) -> Iterator[tuple]:
    """The chunk rows of one archive: (record, chunk_no, type, uri, refers_to, payload, bytes so far, digest so far, last)."""
    while (head := _fields(f)) is not None:
        left, kind = int(head["content-length"]), head.get("warc-type")
        common = (head.get("warc-record-id", "").strip("<>"), kind, head.get("warc-target-uri"), (head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None))
        if head.get("content-type", "").startswith("application/http"):
            while left and (line := f.readline()):
                left -= len(line)
                if line in (b"\r\n", b"\n"):
                    break
        if kind == "revisit":
            while left:
                left -= len(f.read(min(left, chunk)))
            size = head.get("x-payload-length")
            yield (common[0], 0, *common[1:], b"", int(size) if size else None, head.get("warc-payload-digest", "").removeprefix("sha1:") or None, True)
            continue
        digest, done, no = hashlib.sha1(usedforsecurity=False), 0, 0
        while True:
            part = f.read(min(left, chunk))
            if len(part) < min(left, chunk):
                raise EOFError(f"{common[0]}: {left - len(part)} bytes are missing")
            digest.update(part)
            left, done = left - len(part), done + len(part)
            yield (common[0], no, *common[1:], part, done, digest.hexdigest(), not left)
            no += 1
            if not left:
                break


def read(files: DataFrame, *, chunk: int = CHUNK, with_payload: bool = True) -> DataFrame:
    """The chunked record table of the archives named in the column ``file``, streamed; ``with_payload=False`` leaves the bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                rows, held = [], 0
                with store.open_input_stream(path) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as f:
                    for r in records(f, chunk):
                        rows.append((name, *r[:5], r[5] if with_payload else None, *r[6:]))
                        held += len(r[5]) if with_payload else 64
                        if held >= 4 * CHUNK:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return files.select("file").repartition(max(1, 2 * files.count()), "file").mapInArrow(run, FIELDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FIELDS.split(", ")])


@steps("warc")
def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, chunk: int = CHUNK, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Write ``pages`` as WARC archives into the shared folder; the table of archives and their records as read back (without bytes).

    A null payload counts as empty, a null URL is left out of the header, and line
    breaks in a URL are escaped. Rows with a null id become records without a
    page number; they may revisit, and are never referred to. Rows that repeat an
    id are records of their own; of equal payloads those with the largest id are
    all responses. An empty table gives no archives. Other columns are not read, so
    they may have any name.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    records = scratch.write(chunked(rows, scratch.path("chunks"), chunk), "records")
    files = scratch.write(write(records, decided(records, least), scratch.path("archives")), "files")
    scratch.close("archives", "files")
    return files, read(files, chunk=chunk, with_payload=False)


def summary(chunks: DataFrame) -> DataFrame:
    """One row for each record of a table of chunks."""
    page = lambda c: F.regexp_extract(c, f"^{URN}(-?[0-9]+)$", 1).try_cast("long")
    return chunks.where("last").select(page("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))

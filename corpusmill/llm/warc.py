"""WARC files: a sequential reader and a writer.

A ``.warc.gz`` file holds one gzip member for each record.  The reader takes the file as a stream: it
inflates it piece by piece, starts a new inflater where a member ends, cuts records by Content-Length and
checks digests.  It never holds more than one record and one piece of input.  Behind a bad record it goes back
to where that one's member starts and takes the next member that begins with a record.  A file is one unit of work,
as records can only be found by reading from the start; a crawl of many files is read by as many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.llm.common import filesystem, map_arrow, scratch, table

PIECE = 1 << 16
#: Most bytes of a header block; a longer one is a broken record.
MOST_HEADER = 1 << 20

SCHEMA = "file string, record long, type string, record_id string, uri string, date string, headers map<string,string>, payload binary, digest_ok boolean, error string"


class _Members:
    """Inflated bytes of a stream of gzip members, or the bytes as they are if it isn't gzip."""

    def __init__(self, source: IO[bytes]) -> None:
        self.source, self.raw, self.out, self.ended = source, b"", bytearray(), False
        self.base = source.tell() if source.seekable() else None
        #: Where the current member starts, and how far the source is read, from the base.
        self.start = self.at = 0
        while len(self.raw) < 2 and (more := self._read()):
            self.raw += more
        self.gzip = self.raw[:2] == b"\x1f\x8b"
        self.inflater = zlib.decompressobj(31) if self.gzip else None

    def _read(self) -> bytes:
        data = self.source.read(PIECE)
        self.at += len(data)
        return data

    def _seek(self, to: int) -> None:
        self.source.seek(self.base + to)
        self.at = to

    def again(self, start: int) -> bool:
        """Goes to the first member after the offset ``start`` that begins with a record; False if there is none or the source can't go back."""
        if not self.gzip or self.base is None:
            return False
        self._seek(start + 1)
        held = b""
        while True:
            if (i := held.find(b"\x1f\x8b\x08")) < 0:
                held = held[-2:]
                if not (more := self._read()):
                    return False
                held += more
                continue
            here = self.at - len(held) + i
            if self._begins(here):
                break
            self._seek(here + 1)
            held = b""
        self._seek(here)
        self.start, self.raw, self.out, self.ended = here, b"", bytearray(), False
        self.inflater = zlib.decompressobj(31)
        return True

    def _begins(self, here: int) -> bool:
        """Whether the bytes at an offset inflate to the beginning of a record; three bytes may look like a member by chance."""
        self._seek(here)
        probe, found = zlib.decompressobj(31), b""
        try:
            while len(found) < 5 and not probe.eof and (data := probe.unconsumed_tail or self._read()):
                found = (found + probe.decompress(data, 16)).lstrip(b"\r\n")
        except zlib.error:
            return False
        return found.startswith(b"WARC/")

    def more(self) -> bool:
        """Adds some bytes to ``out``; False at the end."""
        while not self.ended:
            if not self.raw:
                self.raw = self._read()
                if not self.raw:
                    self.ended = True
                    if self.inflater is not None and not self.inflater.eof:
                        raise ValueError("the last gzip member is cut short")
                    return False
            if self.inflater is None:
                self.out += self.raw
                self.raw = b""
                return True
            if self.inflater.eof:
                self.raw = self.raw.lstrip(b"\0")
                if not self.raw:
                    continue
                self.inflater, self.start = zlib.decompressobj(31), self.at - len(self.raw)
            data = self.inflater.decompress(self.raw, PIECE * 16)
            self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if data:
                self.out += data
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes | None:
        """The bytes before ``mark``, which is taken too; None at the end."""
        at = 0
        while (i := self.out.find(mark, at)) < 0:
            if len(self.out) > most:
                raise ValueError("a header is too long")
            at = max(0, len(self.out) - len(mark) + 1)
            if not self.more():
                return None
        found = bytes(self.out[:i])
        del self.out[: i + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise ValueError(f"a record ends after {len(self.out)} of {n} bytes")
        found = bytes(self.out[:n])
        del self.out[:n]
        return found

    def skip_newlines(self) -> None:
        while True:
            n = len(self.out) - len(self.out.lstrip(b"\r\n"))
            del self.out[:n]
            if self.out or not self.more():
                return

    def at_record(self) -> bool:
        """Whether a record or the end comes next."""
        self.skip_newlines()
        while len(self.out) < 5 and self.more():
            pass
        return not self.out or self.out.startswith(b"WARC/")


def _digest_ok(wanted: str | None, block: bytes) -> bool | None:
    """Whether the block has this digest (sha1, sha256 or md5, in base 32 or hex); None if there is none to check."""
    if not wanted or ":" not in wanted:
        return None
    name, _, value = wanted.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return None
    got = hashlib.new(name.lower(), block).digest()
    value = value.strip()
    return value.lower() == got.hex() or value.upper().rstrip("=") == base64.b32encode(got).decode().rstrip("=")


def _payload(headers: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """(HTTP header, body) of a record that holds an HTTP message, else (nothing, the block)."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return b"", block
    head, found, body = block.partition(b"\r\n\r\n")
    return (head, body) if found else (block, b"")


def _unchunked(body: bytes) -> bytes:
    """An HTTP body without its transfer chunks; as far as they go."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        try:
            n = int(size, 16)
        except ValueError:
            break
        if n <= 0:
            break
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(parts)


def digests_ok(headers: dict[str, str], block: bytes) -> bool | None:
    """Whether the digests that a record states are right; None if it states none that can be checked.

    The block digest is of the block, the payload digest of the body of an HTTP message, with its transfer chunks or without them, else of the
    block as well.  A revisit's payload digest is of another record's payload.
    """
    found = [_digest_ok(headers.get("warc-block-digest"), block)]
    if headers.get("warc-type", "").lower() != "revisit":
        head, body = _payload(headers, block)
        ok = _digest_ok(headers.get("warc-payload-digest"), body)
        if ok is False and b"chunked" in head.lower():
            ok = _digest_ok(headers.get("warc-payload-digest"), _unchunked(body))
        found.append(ok)
    return False if False in found else True if True in found else None


def read_records(source: IO[bytes]) -> Iterator[dict]:
    """The records of one WARC stream in their order.

    Each has ``record`` (its number from 0), ``headers`` (names in lower case), ``payload`` and ``digest_ok`` (None without a
    digest).  Where the stream is broken a record with ``error`` says so, and reading goes on at the next gzip member that begins
    with a record; members between them that don't inflate even to its first bytes are part of the same error.  Without
    gzip, or where the source can't seek, reading ends there: what comes after can't be framed.  An empty stream has no records.
    """
    members, n = _Members(source), 0
    while True:
        at = None
        try:
            members.skip_newlines()
            at = members.start
            head = members.until(b"\r\n\r\n", MOST_HEADER)
            if head is None:
                if bytes(members.out).strip(b"\r\n\0"):
                    raise ValueError("bytes after the last record")
                return
            lines = head.decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("a record doesn't start with WARC/")
            headers: dict[str, str] = {}
            last = ""
            for line in lines[1:]:
                if line[:1] in (" ", "\t") and last:
                    headers[last] += " " + line.strip()
                elif ":" in line:
                    last, _, value = line.partition(":")
                    last = last.strip().lower()
                    headers[last] = value.strip()
            length = headers.get("content-length", "")
            if not length.isdigit():
                raise ValueError("a record has no Content-Length")
            block = members.take(int(length))
            ok = digests_ok(headers, block)
            # a wrong length would take the records of the next members for its own
            if members.start != at and not ok and (ok is False or not members.at_record()):
                raise ValueError("a record runs beyond its gzip member")
            row = {"record": n, "headers": headers, "payload": block, "digest_ok": ok, "error": None}
        except (ValueError, zlib.error) as e:
            yield {"record": n, "headers": {}, "payload": None, "digest_ok": None, "error": str(e)}
            n += 1
            if not members.again(members.start if at is None else at):
                return
            continue
        yield row
        n += 1


def record_bytes(payload: bytes, uri: str | None, kind: str = "resource", record_id: str | None = None, date: str = "1970-01-01T00:00:00Z", extra: dict[str, str] | None = None) -> bytes:
    """One record as one gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id or f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}", f"WARC-Block-Digest: sha1:{digest}"]
    if uri is not None:
        clean = uri.replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {clean}")
    lines += [f"{k}: {v}" for k, v in (extra or {}).items()]
    head = "\r\n".join([*lines, f"Content-Length: {len(payload)}", "", ""]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + payload + b"\r\n\r\n") + packer.flush()


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``: a row for each record of the folder's ``.warc`` and ``.warc.gz`` files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _WarcReader:
        return _WarcReader(self.options["path"])


class _WarcReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        fs, at = filesystem(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return [_File(i.path) for i in sorted(found, key=lambda i: i.path) if i.type == pafs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as stream:
            rows: list[dict] = []
            held = 0
            for r in read_records(stream):
                rows.append(r)
                held += len(r["payload"] or b"")
                if held > 4 << 20 or len(rows) >= 1000:
                    yield _batch(partition.path, rows)
                    rows, held = [], 0
            if rows:
                yield _batch(partition.path, rows)


def _batch(path: str, rows: list[dict]) -> pa.RecordBatch:
    h = [r["headers"] for r in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path] * len(rows)),
            pa.array([r["record"] for r in rows], pa.int64()),
            *[pa.array([x.get(k) for x in h], pa.string()) for k in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date")],
            pa.array([list(x.items()) for x in h], pa.map_(pa.string(), pa.string())),
            pa.array([r["payload"] for r in rows], pa.binary()),
            pa.array([r["digest_ok"] for r in rows], pa.bool_()),
            pa.array([r["error"] for r in rows], pa.string()),
        ],
        ["file", "record", "type", "record_id", "uri", "date", "headers", "payload", "digest_ok", "error"],
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files at ``path``; a broken file gives its sound records and a row with ``error`` for each bad one, as ``read_records`` says.

    Repeated records are rows each, in the order of ``record`` within a file; one record is held at a time, however long; empty files and
    folders give no rows; headers that a record repeats have their last value.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def write_warc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One ``.warc.gz`` file for each partition of ``pages``.

    A file appears under its final name only when it is whole, and a task that is run again writes the same file.
    Null urls have no target URI; null texts are records of type ``metadata`` with an empty block, so that they can be
    told from empty texts.  The id is kept in the header ``X-Row-Id``; a null id has none.  Repeated rows are records each, in the order they come;
    texts are written whole; an empty table gives files without records.  Other columns, whatever their names, are not written.
    """
    fs, at = filesystem(path)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        to, where = filesystem(path)
        part = TaskContext.get().partitionId()
        final, own = f"{where}/part-{part:06d}.warc.gz", f"{where}/.part-{part:06d}-{uuid.uuid4().hex}"
        n = 0
        with to.open_output_stream(own) as out:
            for batch in batches:
                for i, u, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    out.write(record_bytes((h or "").encode(), u, "metadata" if h is None else "resource", f"<urn:row:{part}:{n}>", extra={} if i is None else {"X-Row-Id": str(i)}))
                    n += 1
        to.move(own, final)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    map_arrow(pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")), write, "n long").agg(F.sum("n")).collect()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC files and read from them: its id, url, length and digest as the reader found them."""
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    text = F.when(F.col("type") == "resource", F.col("payload"))
    return read_warc(spark, path).select(
        F.col("headers")["x-row-id"].cast("bigint").alias("page_id"), F.col("uri").alias("url"),
        F.octet_length(text).cast("bigint").alias("n_bytes"), F.md5(text).alias("md5"), "digest_ok", "error",
    )


OP9_SQL = "SELECT page_id, url, strlen(html)::BIGINT AS n_bytes, md5(html) AS md5, true AS digest_ok, NULL::VARCHAR AS error FROM pages"


def records_of(data: bytes) -> list[dict]:
    """The records of a file's bytes."""
    return list(read_records(io.BytesIO(data)))

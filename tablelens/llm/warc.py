"""WARC archives: writer with revisit records, and a salvage reader.

Tasks write gzip archives (a member per record) into the shared folder; only
archives in the manifest of the attempts that succeeded are read. The reader
checks every record (gzip checks, version line, block length, payload digest).
Where a check fails it searches for the next gzip member or version line that
yields a valid record, goes on from there and logs the gap in bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, new_folder, partitions, ship

#: Payloads of fewer bytes are always stored.
MIN_REVISIT = 1000
#: An archive is closed when it exceeds this many bytes.
ROLL = 64 << 20
#: Duplicate payloads whose list goes to every executor; beyond, it is joined by shuffle.
BROADCAST_PAYLOADS = 200_000
_STEP = 1 << 20
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest_hex: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit has the HTTP header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode(),
             f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}",
                 f"WARC-Block-Digest: {_digest(block)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:id:{quote(str(page_id), safe='')}>"


def _from_urn(urn: str | None) -> str | None:
    m = re.fullmatch(r"<urn:page:id:(.*)>", urn or "")
    return unquote(m[1]) if m else None


class BadRecord(ValueError):
    pass


def parse(data: bytes) -> list[dict]:
    """The records of one member, all checked."""
    out, at = [], 0
    while at < len(data):
        rec, at = _parse_one(data, at)
        out.append(rec)
    if not out:
        raise BadRecord("no record")
    return out


def _parse_one(data: bytes, at: int) -> tuple[dict, int]:
    if not _VERSION.match(data, at):
        raise BadRecord("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise BadRecord("header without end")
    fields = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord("header line without colon")
        fields[name.strip().lower()] = value.strip()
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        raise BadRecord("no content length") from None
    end = stop + 4 + length
    if length < 0 or data[end:end + 4] != b"\r\n\r\n":
        raise BadRecord("block of another length")
    block = data[stop + 4:end]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _digest(block):
        raise BadRecord("block digest differs")
    body = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
    digest = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and digest and digest != _digest(body):
        raise BadRecord("payload digest differs")
    return {"fields": fields, "payload": body}, end + 4


class _Window:
    """Bytes of a file by position; one step is read at a time."""

    def __init__(self, file):
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def at(self, pos: int, n: int = _STEP) -> bytes:
        if not (self.start <= pos and pos + min(n, self.size - pos) <= self.start + len(self.data)):
            self.file.seek(pos)
            self.start, self.data = pos, self.file.read(max(n, _STEP))
        return self.data[pos - self.start:pos - self.start + n]


def _member(w: _Window, pos: int) -> tuple[list[dict], int]:
    """The checked records at ``pos`` and where they end."""
    if w.at(pos, 3) == b"\x1f\x8b\x08":
        z, parts, at = zlib.decompressobj(31), [], pos
        while not z.eof:
            chunk = w.at(at, 1 << 16)
            if not chunk:
                raise BadRecord("member without end")
            try:
                parts.append(z.decompress(chunk))
            except zlib.error as e:
                raise BadRecord(str(e)) from None
            at += len(chunk)
            if len(parts) == 1 and not parts[0].startswith(b"WARC/1."[:len(parts[0])]):
                raise BadRecord("no version line")
        return parse(b"".join(parts)), at - len(z.unused_data)
    n = _STEP
    head = w.at(pos, n)
    whole = _VERSION.match(head)
    while whole and (stop := head.find(b"\r\n\r\n")) < 0 and len(head) == n:
        n *= 2  # a url may be of any length
        head = w.at(pos, n)
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,12})\s*\r\n", head[:stop + 2]) if whole and stop >= 0 else None
    if not m:
        raise BadRecord("neither member nor version line")
    n = stop + 4 + int(m[1])
    if w.at(pos + n, 4) != b"\r\n\r\n":  # a damaged length must not load the rest of the file
        raise BadRecord("block of another length")
    rec, n = _parse_one(w.at(pos, n + 4), 0)
    return [rec], pos + n


def salvage(file) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, bytes, record, None) or, for a gap, (offset, bytes, None, reason)."""
    w, pos = _Window(file), 0
    while pos < w.size:
        try:
            records, end = _member(w, pos)
        except BadRecord as e:
            gap, why, at = pos, str(e), pos + 1
            while True:
                at = _next_start(w, at)
                if at is None:
                    yield gap, w.size - gap, None, why
                    return
                try:
                    records, end = _member(w, at)
                    break
                except BadRecord:
                    at += 1
            yield gap, at - gap, None, why
            pos = at
        for rec in records:
            yield pos, end - pos, rec, None
        pos = end


def _next_start(w: _Window, at: int) -> int | None:
    while at < w.size:
        data = w.at(at)
        m = _START.search(data)
        if m:
            return at + m.start()
        if at + len(data) >= w.size:
            return None
        at += max(1, len(data) - 16)
    return None


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``id``, ``url``, ``payload`` (binary), ``digest`` (hex SHA-1) and
    ``response`` (for payloads met twice or more: the largest id that has it)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = cut(rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
                .agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return rows.join(F.broadcast(again) if again.count() <= BROADCAST_PAYLOADS else again, "digest", "left")


def write_archives(rows: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write the rows of ``with_revisits`` and return the manifest (``path``,
    ``records``, ``bytes``), checkpointed. Names hold the task attempt, so what
    a lost attempt left is never read."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        done, out, n, size = [], None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, response = (c[i].as_py() for c in batch.columns)
                if out is None:
                    path = f"{base}/{name}-{len(done):05d}.warc.gz"
                    out, n, size = system.open_output_stream(path, compression=None), 0, 0
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record(page, url, payload, digest, response, revisit=response is not None and response != page)
                member = z.compress(data) + z.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= roll:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    rows = rows.select("id", "url", "payload", "digest", "response")
    return cut(rows.mapInArrow(run, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record (``gap`` null) and every quarantined gap (``gap``: why) of the
    archives: ``path``, ``offset``, ``bytes``, ``record_type``, ``id`` and
    ``refers_to`` (strings), ``url``, ``payload_bytes``, ``digest`` (hex), and
    ``payload`` unless switched off. Damage never stops a read."""
    ship(manifest.sparkSession)
    names = ["path", "offset", "bytes", "gap", "record_type", "id", "refers_to", "url", "payload_bytes", "digest"] + ["payload"] * with_payload
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for offset, size, rec, gap in salvage(file):
                        if rec is None:
                            rows.append((path, offset, size, gap, *[None] * (len(names) - 4)))
                        else:
                            f, payload = rec["fields"], rec["payload"]
                            revisit = f.get("warc-type") == "revisit"
                            digest = f.get("warc-payload-digest", "")
                            digest = base64.b32decode(digest[5:]).hex() if revisit and digest.startswith("sha1:") else hashlib.sha1(payload).hexdigest()
                            length = int(f.get("x-payload-length", 0)) if revisit else len(payload)
                            rows.append((path, offset, size, None, f.get("warc-type"), _from_urn(f.get("warc-record-id")),
                                         _from_urn(f.get("warc-refers-to")), f.get("warc-target-uri"), length, digest, *[payload] * with_payload))
                            held += len(payload)
                        if len(rows) >= 2000 or held >= 32 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    schema = ("path string, offset long, bytes long, gap string, record_type string, id string, refers_to string, url string, "
              "payload_bytes long, digest string" + ", payload binary" * with_payload)
    spread = manifest.select("path").repartition(max(1, partitions(manifest.sparkSession)), "path")
    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """Write all pages and read the archives back. Null html is an empty
    payload, a null id stays null; rows that repeat an id and payload are all
    responses; an empty table gives no rows."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(with_revisits(pages, id_col), folder), folder, with_payload)

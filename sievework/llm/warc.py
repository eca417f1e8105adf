"""Operator 4, WARC: archives of pages, written and read as a table of chunks.

Writing: Spark deals each payload out in rows of at most CHUNK bytes, (record, chunk number, bytes), in order and beside the whole
payload's length and SHA-1, which a head needs first. Each task streams its rows into compressed WARC 1.1 files (a gzip member per
record) in the shared folder, checks the digest as it goes, and returns rows that name the files; that manifest is a written
table, so a task run twice leaves a file that nobody names. Of equal payloads one record is a response, the others are revisits that
refer to it and carry its HTTP head only.

Reading: files are dealt out one a task, up to MOST_TASKS tasks. A task streams a file and gives a row for each chunk of a payload:
record, chunk number, bytes, length and SHA-1 of the payload so far. A record's last chunk has its whole length and
digest; a revisit has one empty chunk with those that its head states.

A worker that writes or reads holds one chunk of a record; the cell of the pages table that Spark reads a payload from is whole.

Edge cases: a null payload is empty and has one empty chunk; a null url has no target field; a null id is written as
such and read as null, and its record is always a response, as nothing could refer to it; rows that repeat an id and
a payload are all responses if the id is the group's smallest; an empty table gives no records; a very long payload
becomes more chunks; extra columns are ignored, whatever their names. Ids are integers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

CHUNK = 1 << 20
FILE_BYTES = 256 << 20
MOST_TASKS = 100_000
ID = "urn:sievework:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id bigint, record_type string, target_uri string, refers_to bigint, chunk_no int, chunk binary, bytes_so_far bigint, digest_so_far string, is_last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload another page with a smaller id has; a row for each such page_id and payload."""
    p = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).alias("html")).select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("n"))
    first = p.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return p.join(first, "sha").where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()


class Archive:
    """A compressed WARC file being written, chunk by chunk."""

    def __init__(self, folder: str):
        base, path = filesystem(folder)
        base.create_dir(path, recursive=True)
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self.out, self.records, self.bytes = base.open_output_stream(f"{path}/{self.name.rpartition('/')[2]}", compression=None), 0, 0

    def begin(self, fields: list[tuple[str, str]], head: bytes, size: int) -> None:
        """Starts a record whose head is followed by ``size`` bytes."""
        self.gz, self.left = zlib.compressobj(1, zlib.DEFLATED, 31), size
        lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(head) + size))])
        self.send(self.gz.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + head))

    def add(self, part: memoryview | bytes) -> None:
        self.left -= len(part)
        self.send(self.gz.compress(part))

    def end(self) -> None:
        if self.left:
            raise ValueError(f"a record lacks {self.left} bytes")
        self.send(self.gz.compress(b"\r\n\r\n"))
        self.send(self.gz.flush())
        self.records += 1

    def record(self, fields: list[tuple[str, str]], head: bytes, body: memoryview) -> None:
        self.begin(fields, head, len(body))
        for i in range(0, len(body), CHUNK):
            self.add(body[i : i + CHUNK])
        self.end()

    def send(self, data: bytes) -> None:
        self.bytes += len(data)
        self.out.write(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.name, self.records, self.bytes


def field_value(text: str) -> str:
    """A value without line breaks and other control characters, those percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def payload_chunks(pages: DataFrame, min_bytes: int = 0, size: int = CHUNK) -> DataFrame:
    """(page_id, url, refers_to, sha, length, chunk_no, chunk) in order: the chunks of each row's payload, one empty one for a revisit."""
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1("html")).join(roles(pages, min_bytes), ["page_id", "sha"], "left").withColumn("length", F.octet_length("html").cast("long"))
    last = F.when(F.col("refers_to").isNotNull() | (F.col("length") == 0), 0).otherwise(F.floor((F.col("length") - 1) / size)).cast("int")
    p = p.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    chunk = F.when(F.col("refers_to").isNull(), F.substring(F.col("html").cast("binary"), F.col("chunk_no") * size + 1, F.lit(size)))
    return p.select("page_id", "url", "refers_to", "sha", "length", "chunk_no", chunk.alias("chunk"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", chunk: int = CHUNK) -> DataFrame:
    """Writes one record for each row of (page_id, url, html); the manifest (file, records, bytes)."""
    p = payload_chunks(pages, min_bytes, chunk)
    target = f"{folder}/archives"

    def run(batches):
        a, done, digest = None, [], None
        for b in batches:
            cols = [b.column(i) for i in range(6)]
            for i, part in enumerate(b.column(6)):
                page, url, refers, sha, length, number = (c[i].as_py() for c in cols)
                if a is None:
                    a = Archive(target)
                if number == 0:
                    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<{ID}{'' if page is None else page}>"), ("WARC-Date", date)]
                    fields += [("WARC-Target-URI", field_value(url))] if url is not None else []
                    fields += [("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(sha))}"), ("Content-Type", "application/http; msgtype=response")]
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{refers}>")] if refers is not None else []
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
                    a.begin(fields, head, length if refers is None else 0)
                    digest = hashlib.sha1()
                if part.is_valid:
                    body = memoryview(part.as_buffer())
                    digest.update(body)
                    a.add(body)
                if a.left:
                    continue
                a.end()
                if refers is None and digest.hexdigest() != sha:
                    raise ValueError(f"the chunks of page {page} are not its payload")
                if a.bytes >= FILE_BYTES:
                    done.append(a.close())
                    a = None
        if a:
            done.append(a.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    return written(p.mapInArrow(run, "file string, records bigint, bytes bigint"), folder, "manifest")


class Stream:
    """Bytes of a file of gzip members (or of a plain file), read a piece at a time."""

    def __init__(self, raw, packed: bool = True):
        self.raw, self.packed, self.rest, self.have = raw, packed, b"", bytearray()
        self.gz = zlib.decompressobj(31) if packed else None

    def more(self) -> bool:
        data = self.rest or self.raw.read(1 << 16)
        self.rest = b""
        if not data:
            return False
        if not self.packed:
            self.have += data
            return True
        self.have += self.gz.decompress(data, CHUNK)
        self.rest = self.gz.unconsumed_tail or self.gz.unused_data
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        return True

    def upto(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """Bytes before ``mark``, which is taken too; None at the end of the file."""
        while (at := self.have.find(mark)) < 0:
            if len(self.have) > most:
                raise ValueError("a header is too long")
            if not self.more():
                return None
        out = bytes(self.have[:at])
        del self.have[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        """At most ``n`` bytes, at least one unless the file ends."""
        while not self.have and self.more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def fields_of(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def page_of(record_id: str | None) -> int | None:
    text = (record_id or "").strip("<>").removeprefix(ID)
    return int(text) if re.fullmatch(r"-?\d+", text) else None


def chunks_of(stream: Stream, size: int = CHUNK) -> Iterator[tuple]:
    """Rows as in CHUNKS, of all response and revisit records."""
    while (head := stream.upto(b"\r\n\r\n")) is not None:
        if not head.lstrip(b"\r\n").startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        f = fields_of(head.lstrip(b"\r\n"))
        kind, left = f.get("warc-type"), int(f["content-length"])
        known = kind in ("response", "revisit")
        row = (page_of(f.get("warc-record-id")), kind, f.get("warc-target-uri"), page_of(f.get("warc-refers-to")))
        stated = {}
        if known and f.get("content-type", "").startswith("application/http"):
            http = stream.upto(b"\r\n\r\n")
            left, stated = left - len(http) - 4, fields_of(http)
        if kind == "revisit":
            yield *row, 0, b"", int(stated.get("content-length", 0)), f.get("warc-payload-digest", "").removeprefix("sha1:"), True
            known = False
        digest, n, total = hashlib.sha1(), 0, 0
        while known:
            part = bytearray()
            while len(part) < size and left:
                got = stream.take(min(size - len(part), left))
                if not got:
                    raise ValueError("a record is cut off")
                part += got
                left -= len(got)
            digest.update(part)
            total += len(part)
            yield *row, n, bytes(part), total, base32(digest.digest()), not left
            n += 1
            known = bool(left)
        while left:
            got = stream.take(left)
            if not got:
                raise ValueError("a record is cut off")
            left -= len(got)
        if stream.upto(b"\r\n\r\n") is None:
            raise ValueError("a record has no end")


def read(manifest: DataFrame, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table (see CHUNKS) of the files that ``manifest`` names; without payloads, only each record's last chunk, its bytes null."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.strip().split()[0] for x in CHUNKS.split(", ")]

    def run(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for uri in b.column("file").to_pylist():
                base, path = filesystem(uri)
                rows, held = [], 0
                with base.open_input_stream(path, compression=None) as raw:
                    for r in chunks_of(Stream(raw, uri.endswith(".gz")), chunk):
                        if not payload:
                            if not r[-1]:
                                continue
                            r = (*r[:5], None, *r[6:])
                        rows.append(r)
                        held += len(r[5] or b"") + 200
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = manifest.select("file")
    return files.repartitionByRange(max(1, min(files.count(), MOST_TASKS)), "file").mapInArrow(run, CHUNKS)  # a number: adaptive execution leaves it


def query(spark, sf_dir: str) -> DataFrame:
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark))
    return read(manifest, payload=False).select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")

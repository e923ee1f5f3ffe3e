"""WARC archives and a two-level capture index over them.

A record is a gzip member of an archive; payloads seen before become revisit records. The index is sorted
by reversed-host keys (com,example,www)/path page) into compressed blocks, a file for each range of keys; a
sparse directory beside each file has its blocks' first keys. A look-up finds the file, then the
block, then the line by binary search, and reads the block's and the record's byte ranges only. Files
are named by attempt, and rows refer to those of the attempts that ended: a lost or repeated task leaves
at most files that nothing refers to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import new_folder, slices, table

#: Lines of a block of the index, and bytes after which a task begins another archive.
BLOCK_LINES, ARCHIVE_BYTES = 512, 1 << 30
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def disk_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a uri and the path there. s3a, as Spark calls it, is s3 to pyarrow."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def _uri(url: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def surt(url: str | None) -> str:
    """Reversed host, then what follows the host: com,example,www)/path. Urls without :// keep their form."""
    scheme, found, rest = _uri(url or "").partition("://")
    if not found:
        return scheme
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{surt(url)} {'' if page_id is None else format(page_id + (1 << 63), '016x')}"


def _gzip(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(url: str | None, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>"


def record(kind: str, url: str | None, page_id: int | None, digest: str, size: int, payload: bytes, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """A WARC 1.1 record, uncompressed; a revisit has the HTTP header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Record-ID: {record_id(url, page_id)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_url, refers_to)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_url)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers, payload and payload size; its lengths and a response's digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("a payload differs from its record's digest")
    return {
        "page_id": int(headers["X-Page-ID"]) if "X-Page-ID" in headers else None, "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"],
        "refers_to": int(headers["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in headers else None, "url": headers.get("WARC-Target-URI"), "payload": payload,
    }


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns key, file, offset, length.

    Payloads meet by digest and length: the smallest page_id's record is the response, as are records of the
    same page_id; a payload whose rows have no page_id is always a response. Only payloads that recur are looked up, and
    what a record is to be is known before it is compressed.
    """
    key = [F.unhex(F.sha2("payload", 256)).alias("sha"), F.octet_length("payload").cast("long").alias("size")]
    own = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")).select("*", *key)
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    first = own.where(F.col("size") >= min_revisit).groupBy("sha", "size").agg(least, F.count("*").alias("n")).where("n > 1 AND first is not null")
    first = table(first.select("sha", "size", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "recurring-payloads")
    rows = own.join(first, ["sha", "size"], "left").select("page_id", "url", "payload", "first", "first_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = disk_of(folder)
        out = name = None
        at = 0
        try:
            for batch in slices(batches):
                lines = []
                for r in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = disk.open_output_stream(f"{root}/{name}", compression=None)
                    payload = r["payload"]
                    kind = ("response", payload) if r["first"] is None or r["first"] == r["page_id"] else ("revisit", b"", r["first"], r["first_url"])
                    data = _gzip(record(kind[0], r["url"], r["page_id"], base32_sha1(payload), len(payload), *kind[1:]))
                    out.write(data)
                    lines.append((capture_key(r["url"], r["page_id"]), name, at, len(data)))
                    at += len(data)
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*lines, strict=True)], ["key", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    disk, root = disk_of(folder)
    disk.create_dir(root, recursive=True)
    return table(rows.mapInArrow(write, "key string, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Writes captures (key, file, offset, length), sorted; returns each index file's first key and name, in order.

    The list has an entry for each range of keys, that is for each shuffle partition.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = disk_of(folder)
        name, directory, held, at = f"{uuid.uuid4().hex}.idx", [], [], 0
        with disk.open_output_stream(f"{root}/{name}", compression=None) as out:

            def close(lines: list[list]) -> None:
                nonlocal at
                data = zlib.compress(json.dumps(lines).encode())
                out.write(data)
                directory.append([lines[0][0], at, len(data)])
                at += len(data)

            for batch in slices(batches):
                held += [list(r.values()) for r in batch.to_pylist()]
                while len(held) >= BLOCK_LINES:
                    close(held[:BLOCK_LINES])
                    held = held[BLOCK_LINES:]
            if held:
                close(held)
        if directory:
            with disk.open_output_stream(f"{root}/{name}.dir", compression=None) as out:
                out.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["key", "name"])

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    found = table(ordered.mapInArrow(write, "key string, name string"), "index-files")
    return sorted(((r.key, r.name) for r in found.collect()), key=lambda r: (r[0].encode(), r[1]))


class Reader:
    """Finds captures by key. Keys that come in order find the same block again."""

    def __init__(self, folder: str, files: list[tuple[str, str]]):
        self.disk, self.root = disk_of(folder)
        self.files, self.firsts = files, [k.encode() for k, _ in files]
        self.open, self.directory, self.block = {}, {}, {}

    def _range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                for file in self.open.values():
                    file.close()
                self.open.clear()
            self.open[name] = self.disk.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, offset)

    def _directory(self, name: str) -> tuple[list[bytes], list[list]]:
        if name not in self.directory:
            self.directory.clear()
            with self.disk.open_input_file(f"{self.root}/{name}.dir") as file:
                entries = json.loads(zlib.decompress(file.read()))
            self.directory[name] = [e[0].encode() for e in entries], entries
        return self.directory[name]

    def _block(self, name: str, entry: list) -> tuple[list[bytes], list[list]]:
        if (name, entry[1]) not in self.block:
            self.block.clear()
            lines = json.loads(zlib.decompress(self._range(name, entry[1], entry[2])))
            self.block[name, entry[1]] = [line[0].encode() for line in lines], lines
        return self.block[name, entry[1]]

    def captures(self, key: str) -> Iterator[list]:
        """All lines with the key. Equal keys may go over blocks and files."""
        want = key.encode()
        for number in range(max(0, bisect.bisect_left(self.firsts, want) - 1), bisect.bisect_right(self.firsts, want)):
            name = self.files[number][1]
            firsts, entries = self._directory(name)
            for at in range(max(0, bisect.bisect_left(firsts, want) - 1), bisect.bisect_right(firsts, want)):
                keys, lines = self._block(name, entries[at])
                yield from lines[bisect.bisect_left(keys, want) : bisect.bisect_right(keys, want)]

    def read(self, line: list) -> dict:
        return parse(zlib.decompress(self._range(line[1], line[2], line[3]), 31))


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(pages: DataFrame, folder: str, files: list[tuple[str, str]], payloads: bool = False) -> DataFrame:
    """The records of the distinct (page_id, url) of pages, each looked up in the index and read from its archive."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True)], pa.string())], ["key"])

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, files)
        for batch in slices(batches):
            found = [reader.read(line) for key in batch.column("key").to_pylist() for line in reader.captures(key)]
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in found], kinds)

    keys = pages.select(F.col("page_id").cast("long"), "url").mapInArrow(keyed, "key string").distinct()
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(read, RESULT + ", payload binary" * payloads)


def archive(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes archives and index of all pages to the shared folder, and returns what reading every record back gives.

    A null html is an empty payload; a null url has an empty key and no target header; a null page_id has
    no page header and comes back null. Repeated rows are records each, responses if their page_id is the
    smallest of their payload. A payload of any length is one record. An empty table gives an empty result. Extra columns
    are ignored.
    """
    folder = new_folder(pages.sparkSession, "warc")
    return read_back(pages, folder, write_index(write_archives(pages, folder, min_revisit), folder))

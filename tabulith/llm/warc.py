"""WARC archives with a two-level capture index.

Archives: one gzip member per record. Of equal payloads of ``LEAST`` bytes or more the
one with the smallest page id is a response, the others are revisits of it without a
payload of their own. Every writing task makes files of its own name and hands back one
capture per record; only captures that were committed count, so files of a lost or
repeated task are never read.

Index: captures are sorted by reversed-host URL key (and page id, so that one host or
URL may own any share of them) into compressed blocks; the directory keeps the first key
of each block. Blocks grow with the table, so the directory stays below ``DIRECTORY``
entries and may be held by every task. A look-up searches the directory, reads and
searches the blocks that can hold the key, then reads the records' byte ranges.

Edge cases: a null payload is empty; a null URL has the empty key and no target header;
control characters in a URL are percent-encoded in headers; a page without id is a
response that nothing refers to; rows with one id are records of their own (equal
payloads under one id are both responses); an empty table writes no archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import os
import uuid
import zlib
from urllib.parse import quote, urlsplit

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.joins import by_ids
from tabulith.llm.words import arrow, batch, pieces
from tabulith.session import cut_lineage, shared_folder

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Captures in a block at least, entries of the directory at most, bytes read from an archive at once.
BLOCK, DIRECTORY, RANGE = 3000, 500_000, 8 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"

CAPTURES = "key string, page_id bigint, file string, offset bigint, length bigint, kind string"
BLOCKS = "key string, last string, file string, offset bigint, length bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target string"


def file_system(folder: str):
    """The file system of a shared folder and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def capture_key(url: str | None) -> str:
    """``http://www.a.example.com/x?y`` gives ``com,example,a)/x?y``."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return (url or "").strip().lower()
    if not host:
        return (url or "").strip()
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits and digits != "none" else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One response, or a revisit without payload, as WARC 1.1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _name(page_id), "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="".join(map(chr, range(33, 127)))),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": _name(refers_to) if revisit else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of (page_id, url, html, digest, refers_to); the captures, committed as a table."""
    schema = arrow(CAPTURES)

    def run(batches):
        fs, path = file_system(folder)
        fs.create_dir(path)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        offset, out = 0, None
        try:
            for rows, data, at in pieces(batches, "html"):
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                raw, found = data.tobytes(), []
                columns = (rows.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
                for i, (page, url, digest, refers) in enumerate(zip(*columns, strict=True)):
                    member = gzip.compress(record(page, url, raw[at[i] : at[i + 1]], digest, refers), LEVEL, mtime=0)
                    out.write(member)
                    found.append((capture_key(url), page, name, offset, len(member), "response" if refers is None else "revisit"))
                    offset += len(member)
                yield batch(schema, *zip(*found, strict=True))
        finally:
            if out is not None:
                out.close()

    return cut_lineage(pages.mapInArrow(run, CAPTURES))


def write_index(captures: DataFrame, folder: str, block: int = BLOCK, most: int = DIRECTORY) -> DataFrame:
    """Sort captures into compressed blocks; the directory of the blocks."""
    schema, total = arrow(BLOCKS), captures.count()
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = max(block, -(-2 * total // most))

    def run(batches):
        fs, path = file_system(folder)
        fs.create_dir(path)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.index"
        press, held, offset, out = zstandard.ZstdCompressor(level=3), [], 0, None

        def flush():
            nonlocal offset, out
            out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
            raw = press.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in held).encode())
            out.write(raw)
            row = batch(schema, [held[0][0]], [held[-1][0]], [name], [offset], [len(raw)])
            offset += len(raw)
            held.clear()
            return row

        try:
            for rows in batches:
                for row in zip(*(rows.column(c.name).to_pylist() for c in arrow(CAPTURES)), strict=True):
                    held.append(row)
                    if len(held) == lines:
                        yield flush()
            if held:
                yield flush()
        finally:
            if out is not None:
                out.close()

    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return cut_lineage(ordered.mapInArrow(run, BLOCKS))


def read_block(fs, path: str, file: str, offset: int, length: int) -> list[tuple]:
    with fs.open_input_file(f"{path}/{file}") as source:
        raw = source.read_at(length, offset)
    text = zstandard.ZstdDecompressor().decompressobj().decompress(raw).decode()
    return [tuple(json.loads(line)) for line in text.split("\n") if line]


def all_captures(directory: DataFrame, folder: str) -> DataFrame:
    """Every capture, read back from the blocks of the index."""
    schema = arrow(CAPTURES)

    def run(batches):
        fs, path = file_system(folder)
        for rows in batches:
            for file, offset, length in zip(*(rows.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                yield batch(schema, *zip(*read_block(fs, path, file, offset, length), strict=True))

    return directory.mapInArrow(run, CAPTURES)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Read the records at the captures' byte ranges; captures near each other share a read."""
    schema = arrow(RECORDS)
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        fs, path = file_system(folder)
        source = begin = raw = None
        opened = ""
        for rows in batches:
            out = []
            for file, offset, length in zip(*(rows.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != opened:
                    if source is not None:
                        source.close()
                    source, opened, raw = fs.open_input_file(f"{path}/{file}"), file, b""
                    begin, size = 0, source.size()
                if offset < begin or offset + length > begin + len(raw):
                    begin = offset
                    raw = source.read_at(min(max(RANGE // 8, length), size - offset), offset)
                headers, payload = parse(zlib.decompress(raw[offset - begin : offset - begin + length], 31))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                refers = _page(headers.get("WARC-Refers-To"))
                if headers["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{file} at {offset}: the payload is not that of its digest")
                out.append((_page(headers["WARC-Record-ID"]), None if headers["WARC-Type"] == "revisit" else len(payload), digest, headers["WARC-Type"], refers, headers.get("WARC-Target-URI")))
            if out:
                yield batch(schema, *zip(*out, strict=True))
        if source is not None:
            source.close()

    near = captures.repartition(parts, "file", F.floor(F.col("offset") / RANGE)).sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, RECORDS)


class CaptureIndex:
    """Archives and their index in one folder."""

    def __init__(self, spark: SparkSession, folder: str, directory: DataFrame):
        self.spark, self.folder, self.directory = spark, folder, directory

    def records(self) -> DataFrame:
        """Every record, read back; a revisit has the size of the response that it refers to."""
        found = cut_lineage(read_records(all_captures(self.directory, self.folder), self.folder))
        sizes = found.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
        plain = found.filter("record_type = 'response'")
        again = found.filter("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"]).withColumn("payload_bytes", F.col("full"))
        return plain.select(*found.columns).unionByName(again.select(*found.columns))

    def find(self, urls: DataFrame) -> DataFrame:
        """The records whose URL key is that of a row of ``urls`` (column ``url``)."""
        blocks = sorted(tuple(r) for r in self.directory.collect())
        sent, folder, schema = self.spark.sparkContext.broadcast(blocks), self.folder, arrow(CAPTURES)

        def run(batches):
            fs, path = file_system(folder)
            firsts = [b[0] for b in sent.value]
            for rows in batches:
                for key in sorted({capture_key(u) for u in rows.column("url").to_pylist()}):
                    at, found = max(bisect.bisect_left(firsts, key) - 1, 0), []
                    while at < len(firsts) and firsts[at] <= key:
                        if sent.value[at][1] >= key:
                            lines = read_block(fs, path, *sent.value[at][2:])
                            keys = [x[0] for x in lines]
                            found += lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                        at += 1
                    if found:
                        yield batch(schema, *zip(*found, strict=True))

        return read_records(urls.mapInArrow(run, CAPTURES).distinct(), self.folder)


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST, block: int = BLOCK, most: int = DIRECTORY) -> CaptureIndex:
    """Write the archives and the index of (page_id, url, html)."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    sizes = cut_lineage(rows.select("page_id", "digest").filter(F.octet_length("html") >= least).filter("page_id is not null"))
    firsts = sizes.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    again = cut_lineage(sizes.distinct().join(firsts, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to"))
    captures = write_archives(by_ids(rows, again, "left", ["page_id", "digest"]).select("page_id", "url", "html", "digest", "refers_to"), folder)
    return CaptureIndex(spark, folder, write_index(captures, folder, block, most))

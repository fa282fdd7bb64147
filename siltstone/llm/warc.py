"""WARC files: a sequential reader, and the writer that its round trip needs.

A file is a row of gzip members, one for each record (or several). The reader feeds fixed-size chunks to an incremental zlib
decompressor, frames each record by its Content-Length, and compares the block with the digest that the
record states. Files are distributed over tasks; a file is read from front to end by one, which holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir

CHUNK = 1 << 16
PIECE = 1 << 16  # of a member's content at a time, however well it is compressed
MOST_HEADER = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
SCHEMA = "file string, at long, place long, status string, type string, record_id string, uri string, length long, digest string, digest_ok boolean, block binary"


def record(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member, with its length and digest."""
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", *(f"{k}: {_one_line(v)}" for k, v in headers), f"WARC-Block-Digest: sha1:{sha1}", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


class Members:
    """The gzip members of a stream, decompressed piece by piece. After a corrupt member reading goes on at the next gzip header
    behind the place where that member began, for which the stream is read again from there, so that nothing has to be held."""

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK):
        self.stream, self.chunk, self.held, self.at = stream, chunk, b"", 0  # at: of the first byte in held

    def __iter__(self) -> Iterator["Member"]:
        while True:
            if not self.held:
                self.held = self.stream.read(self.chunk)
                if not self.held:
                    return
            member = Member(self)
            yield member
            for _ in member:  # what the reader left
                pass
            if member.status == "truncated":
                return
            if member.status == "corrupt" and not self.seek_header(member.start + 1):
                return

    def seek_header(self, at: int) -> bool:
        self.stream.seek(at)
        self.at, self.held = at, b""
        while True:
            found = self.held.find(MAGIC)
            if found >= 0:
                self.at, self.held = self.at + found, self.held[found:]
                return True
            keep = self.held[-2:]
            more = self.stream.read(self.chunk)
            if not more:
                return False
            self.at += len(self.held) - len(keep)
            self.held = keep + more


class Member:
    """Yields the decompressed pieces of one member; ``status`` is then ok, truncated (the file ends in it) or corrupt."""

    def __init__(self, source: Members):
        self.source, self.start, self.status = source, source.at, ""
        self.pieces = self._read()

    def __iter__(self) -> Iterator[bytes]:
        return self.pieces

    def _read(self) -> Iterator[bytes]:
        source, unzip = self.source, zlib.decompressobj(31)
        while not unzip.eof:
            if not source.held:
                source.held = source.stream.read(source.chunk)
                if not source.held:
                    self.status = "truncated"
                    return
            try:
                piece = unzip.decompress(source.held, PIECE)
            except zlib.error:
                self.status = "corrupt"
                return
            rest = unzip.unconsumed_tail or unzip.unused_data
            source.at += len(source.held) - len(rest)
            source.held = rest
            if piece:
                yield piece
        self.status = "ok"


def _digest(stated: str | None, block: bytes | None) -> bool | None:
    """Whether a digest ("sha1:" or another algorithm, in base 32 or hexadecimal) is the block's; null if none is stated or the algorithm isn't known."""
    if stated is None or block is None:
        return None
    kind, _, value = stated.partition(":")
    name = kind.strip().lower().replace("-", "")
    if name not in DIGESTS:
        return None
    own, value = hashlib.new(name, block).digest(), value.strip()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _headers(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}


def records(member: Member) -> Iterator[tuple[dict[str, str], bytes | None, str]]:
    """Headers, block and status of the records of a member, one after the other: ok, or what framing lacks, or the member's fault.

    No more than one record is held. What can't be framed ends the member, except that after a wrong end
    reading goes on if a record follows.
    """
    held, n = bytearray(), 0

    def fill(least: int) -> bool:
        for piece in member:
            held.extend(piece)
            if len(held) >= least:
                return True
        return len(held) >= least

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0 and len(held) < MOST_HEADER:
            before = len(held)
            if not fill(before + 1):
                break
            end = held.find(b"\r\n\r\n", max(0, before - 3))
        if not held and n:
            if member.status != "ok":
                yield {}, None, member.status
            return
        headers = _headers(bytes(held[:end])) if end >= 0 else None
        if headers is None:
            yield {}, None, member.status if member.status not in ("", "ok") else "no header"
            return
        n += 1
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError):
            size = None
        if size is None:
            yield headers, None, "no length"
            return
        begin = end + 4
        whole = size >= 0 and fill(begin + size)
        if not whole:
            yield headers, bytes(held[begin:]), member.status if member.status not in ("", "ok") else "short block"
            return
        fill(begin + size + 4)
        block, tail = bytes(held[begin : begin + size]), bytes(held[begin + size : begin + size + 4])
        held = held[begin + size :]  # a piece at most is left
        if tail == b"\r\n\r\n":
            held = held[4:]
            yield headers, block, "ok"
            continue
        yield headers, block, member.status if member.status not in ("", "ok") else "bad end"
        while held[:2] == b"\r\n":
            del held[:2]
        if not fill(5) or held[:5] != b"WARC/":
            return


def read_stream(stream: BinaryIO, name: str, chunk: int = CHUNK) -> Iterator[dict]:
    for member in Members(stream, chunk):
        for place, (headers, block, status) in enumerate(records(member)):
            digest = headers.get("warc-block-digest")
            yield {
                "file": name, "at": member.start, "place": place, "status": status, "type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"),
                "uri": headers.get("warc-target-uri"), "length": len(block) if block is not None else None, "digest": digest, "digest_ok": _digest(digest, block), "block": block,
            }


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a record of the files, in columns SCHEMA.

    at is where a record's gzip member begins, place its number within it. status is "ok" or names the fault; the records
    before and after a faulty one are read. digest_ok is null where a record states no digest or one by an algorithm that isn't
    known; base 32 and hexadecimal are understood. An empty file has no records. Headers may come in any case and order.
    """
    if not paths:
        return spark.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                where, at = _open(path)
                with where.open_input_file(at) as stream:
                    held, size = [], 0
                    for row in read_stream(stream, path):
                        held.append(row)
                        size += len(row["block"] or b"")
                        if size > 8 << 20:
                            yield _frame(held)
                            held, size = [], 0
                    if held:
                        yield _frame(held)

    files = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k long, path string").repartitionByRange(len(paths), "k").select("path")
    return files.mapInPandas(run, SCHEMA)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    return out.astype({"length": "Int64", "digest_ok": "object"})


def write_pages(pages: DataFrame, folder: str) -> list[str]:
    """Writes pages (page_id, url, html) as WARC files under a folder that all executors share; returns their paths.

    A task writes under a name of its own attempt and then renames, so that a retried task leaves one file.
    A page without html becomes a metadata record without a block.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"{folder.rstrip('/')}/part-{task.partitionId():06d}.warc.gz"
        where, at = _open(name)
        where.create_dir(at.rpartition("/")[0], recursive=True)
        temp, n = f"{at}.{uuid.uuid4().hex}", 0
        with where.open_output_stream(temp, compression=None) as out:
            for batch in batches:
                for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                    headers = [("WARC-Type", "metadata" if html is None else "resource"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "text/html; charset=utf-8")]
                    if page_id is not None:
                        headers.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
                    if url is not None:
                        headers.append(("WARC-Target-URI", url))
                    out.write(record(headers, (html or "").encode()))
                    n += 1
        where.move(temp, at)
        yield pd.DataFrame({"path": [name], "n": [n]})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return sorted(r["path"] for r in rows.mapInPandas(run, "path string, n long").collect())


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, length, sha1, digest_ok of every page, written to WARC files in the shared folder and read from them.

    Null html comes back null with length 0, a null page_id or url null; an empty html is an empty block.
    Repeated rows are records each. Line breaks in a url come back percent-encoded. Other columns
    don't matter; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    got = read_warc(spark, write_pages(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1)
    return got.select(
        F.when(page != "", page).cast("long").alias("page_id"),
        F.col("uri").alias("url"),
        F.when(F.col("type") != "metadata", F.col("block").cast("string")).alias("html"),
        "length",
        F.sha1("block").alias("sha1"),
        F.coalesce("digest_ok", F.lit(False)).alias("digest_ok"),
    )


WARC_SQL = """
select page_id, url, html, octet_length(encode(coalesce(html, ''))) as length, sha1(coalesce(html, '')) as sha1, true as digest_ok
from pages
"""

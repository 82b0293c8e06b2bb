"""WARC archives: writing pages with deduplicated payloads, and reading them in splits.

Where a record begins inside a split cannot be told from the bytes alone: a payload may hold the magic
of a record. Tasks therefore emit, for every place of a split that parses as a record, where its
successor begins. Pointer jumping over these links, first inside a split and then from split to split,
starts at the front of each file and keeps only what it reaches; the splits are then read from the
places found in this way.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from boxoffice.functions.scale import materialize, shared_dir
from boxoffice.llm.batches import small_batches
from boxoffice.llm.files import open_input, open_output, unique_name

GZIP, PLAIN = b"\x1f\x8b\x08", b"WARC/1."
_CANDIDATE = re.compile(re.escape(GZIP) + b"|" + re.escape(PLAIN))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
FEED, MORE = 1 << 14, 1 << 20
NO_ID = "none"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{NO_ID if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page ``refers_to``, whose HTTP head alone is stored."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    block = http + payload if refers_to is None else http
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def file_info() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:info>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 1000, compress: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row and return the manifest: path, bytes and records of each file.

    Among rows with equal payloads of at least ``least_bytes`` the one with the largest id is written
    whole, as are rows that repeat its id; the others refer to it. A null html is an empty payload; a
    null id never is the one that others refer to; a null url is left out. An empty table gives no
    file. Other columns are ignored. Payloads equal in length and SHA-1 count as equal.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    equal = rows.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("whole"))
    # A small table is then known to be small: pages are only shuffled if equal payloads are many.
    chosen = materialize(equal.filter(F.col("n") > 1).select(F.col("digest").alias("d"), F.col("size").alias("s"), "whole"), "payloads")
    other = F.when(F.coalesce(F.col("id") != F.col("whole"), F.lit(True)), F.col("whole"))
    assigned = rows.join(chosen, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left").select("id", "url", "html", "digest", other.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at, count = unique_name(folder, "pages") + (".warc.gz" if compress else ".warc"), None, 0, 0
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in columns), strict=True):
                blobs = [file_info()] if out is None else []
                out = out or open_output(path)
                for blob in (*blobs, record(page_id, url, html, digest, refers_to)):
                    if compress:
                        coder = zlib.compressobj(6, zlib.DEFLATED, 31)
                        blob = coder.compress(blob) + coder.flush()
                    out.write(blob)
                    at += len(blob)
                count += 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([at], pa.int64()), pa.array([count], pa.int64())], names=["path", "bytes", "records"])

    with small_batches(pages.sparkSession):
        return materialize(assigned.mapInArrow(write, "path string, bytes long, records long"), "warc-manifest")


class Window:
    """The bytes of a file from ``start`` on, read further as they are needed."""

    def __init__(self, path: str, start: int, end: int, size: int):
        self.file, self.start, self.size = open_input(path), start, size
        self.file.seek(start)
        self.data = bytearray(self.file.read(end - start))

    def reach(self, to: int) -> bool:
        """Whether there are bytes up to the file offset ``to``."""
        while self.start + len(self.data) < min(to, self.size):
            self.data += self.file.read(max(MORE, to - self.start - len(self.data)))
        return to <= self.size

    def cut(self, at: int, to: int) -> bytes:
        self.reach(to)
        return bytes(self.data[at - self.start : to - self.start])


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def parse_at(window: Window, at: int) -> tuple[int, dict[str, str], bytes] | None:
    """The successor's offset, headers and block of the record at ``at``, if one parses there."""
    if window.cut(at, min(at + 3, window.size)) == GZIP:
        coder, parts, to = zlib.decompressobj(31), [], at
        try:
            parts.append(coder.decompress(window.cut(to, min(to + FEED, window.size)), 16))
            if not parts[0].startswith(PLAIN):
                return None
            to += FEED
            parts.append(coder.decompress(coder.unconsumed_tail))
            while not coder.eof:
                if to >= window.size:
                    return None
                parts.append(coder.decompress(window.cut(to, min(to + FEED, window.size))))
                to += FEED
        except zlib.error:
            return None
        raw = b"".join(parts)
        following = min(to, window.size) - len(coder.unused_data)
        border = raw.find(b"\r\n\r\n")
        if border < 0:
            return None
        headers = _headers(raw[:border])
        length = headers.get("content-length", "")
        body = border + 4 + int(length) if length.isdecimal() else -1
        return (following, headers, raw[border + 4 : body]) if raw[body:] == b"\r\n\r\n" and body > 0 else None
    if window.cut(at, min(at + len(PLAIN), window.size)) != PLAIN:
        return None
    to = at + FEED
    while (border := window.cut(at, min(to, window.size)).find(b"\r\n\r\n")) < 0:
        # A head of a megabyte is none.
        if to >= min(window.size, at + MORE):
            return None
        to += FEED
    headers = _headers(window.cut(at, at + border))
    length = headers.get("content-length", "")
    if not length.isdecimal():
        return None
    body = at + border + 4
    following = body + int(length) + 4
    if not window.reach(following) or window.cut(following - 4, following) != b"\r\n\r\n":
        return None
    return following, headers, window.cut(body, following - 4)


def local_exits(offsets: np.ndarray, successors: np.ndarray, end: int) -> np.ndarray:
    """The first offset at or beyond ``end``, or that is no candidate, from each candidate on, by
    pointer jumping."""
    out = successors.copy()
    while len(offsets):
        place = np.minimum(np.searchsorted(offsets, out), len(offsets) - 1)
        inside = (offsets[place] == out) & (out < end)
        if not inside.any():
            break
        out = np.where(inside, out[place], out)
    return out


def _splits(files: list, split_bytes: int) -> list[tuple[str, int, int, int, int]]:
    return [(f.path, k, at, min(at + split_bytes, f.bytes), f.bytes) for f in files for k, at in enumerate(range(0, f.bytes, split_bytes))]


def boundary_links(spark: SparkSession, splits: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """Of every candidate: path, at and exit, its first successor in another split."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, _, start, end, size in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                window = Window(path, start, min(end + len(PLAIN), size), size)
                # The magic may run over the split's end; matches may overlap.
                places, at = [], 0
                found = bytes(window.data)
                while (hit := _CANDIDATE.search(found, at)) and hit.start() < end - start:
                    places.append(start + hit.start())
                    at = hit.start() + 1
                pairs = [(p, parsed[0]) for p in places if (parsed := parse_at(window, p))]
                offsets, successors = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
                exits = local_exits(offsets, successors, end)
                yield pa.record_batch([pa.array([path] * len(pairs), pa.string()), pa.array(offsets), pa.array(exits)], names=["path", "at", "exit"])

    table = spark.createDataFrame(splits, "path string, split long, start long, end long, size long")
    return table.repartition(max(1, len(splits))).mapInArrow(find, "path string, at long, exit long")


def reachable_entries(links: DataFrame, splits: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """path and at of the first record of each split, by pointer jumping from the front of each file:
    every round doubles the number of splits a link leaps over."""
    spark = links.sparkSession
    reached = spark.createDataFrame([(s[0], 0) for s in splits if s[1] == 0], "path string, at long")
    hops, leap = max([s[1] for s in splits], default=0), 1
    jumps = materialize(links, "links")
    while leap <= hops:
        onward = reached.join(jumps, ["path", "at"]).select("path", F.col("exit").alias("at"))
        reached = materialize(reached.unionByName(onward).distinct(), "reached")
        if 2 * leap <= hops:
            then = jumps.select("path", F.col("at").alias("exit"), F.col("exit").alias("far"))
            jumps = materialize(jumps.join(then, ["path", "exit"]).select("path", "at", F.col("far").alias("exit")), "links")
        leap *= 2
    return reached


def read_warc(manifest: DataFrame, split_bytes: int = 64 << 20, payload: bool = True, id_col: str = "page_id") -> DataFrame:
    """Per response or revisit record: ``id_col``, url, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload (null for revisits).

    A revisit's size is that of its stored HTTP head, its digest that of its header; a response whose
    payload does not have the digest of its header raises. Files may be gzipped by record or plain. A
    task holds a split and the last record it begins. The driver lists files and splits, not records.
    """
    spark = manifest.sparkSession
    splits = _splits(manifest.collect(), split_bytes)
    entries = reachable_entries(boundary_links(spark, splits), splits)
    table = spark.createDataFrame(splits, "path string, split long, start long, end long, size long")
    starts = entries.withColumn("split", F.floor(F.col("at") / split_bytes)).join(table, ["path", "split"]).select("path", "at", "end", "size")
    starts = starts.repartition(max(1, len(splits)), "path", "at")
    number = lambda name: None if name in (None, _name(None)) else int(name.rpartition(":")[2].rstrip(">"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, end, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                window, rows, held = Window(path, at, end, size), [], 0
                while at < end:
                    parsed = parse_at(window, at)
                    if parsed is None:
                        raise ValueError(f"{path}: no record at {at}")
                    at, headers, block = parsed
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    border = block.find(b"\r\n\r\n") + 4
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    length = int(_headers(block[:border])["content-length"])
                    body = block[border:] if kind == "response" else None
                    if body is not None and (hashlib.sha1(body).hexdigest() != digest or len(body) != length):
                        raise ValueError(f"{path}: payload of {headers['warc-record-id']} is damaged")
                    rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), length, digest, kind, number(headers.get("warc-refers-to")), body if payload else None))
                    held += len(body or b"") if payload else 100
                    if held > MORE:
                        yield from _record_rows(rows, id_col, payload)
                        rows, held = [], 0
                yield from _record_rows(rows, id_col, payload)

    schema = f"`{id_col}` long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return starts.mapInArrow(read, schema)


def _record_rows(rows: list[tuple], id_col: str, payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payload]
    names = [id_col, "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payload]
    if rows:
        yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def warc_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return unique_name(shared_dir(spark), "warc")


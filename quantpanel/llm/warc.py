"""WARC (10): write archives, read them back by boundary-chain verification.

Readers take byte ranges. Each task lists every place in its range that looks like the start of a record, with the place
where that record would end: payloads may hold the magic bytes too. Within a range chains are followed at once, so what
is left is one pointer from a range's candidate to the first place beyond the range; pointer jumping from the start of
each file (doubling, so the logarithm of the ranges of a file) marks the candidates that the chain really enters a range
by. Records are then read from those places only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_classes, join_ids, map_rows, shared_path, small_batches, store, width

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes of an archive before the next is begun, of a range that one task scans, and of one read behind a range for the header that ends there.
FILE_BYTES, RANGE_BYTES, HEADER_BYTES = 256 << 20, 8 << 20, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP header alone, whose Content-Length is still the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page))}>",
        "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if url:
        head.append("WARC-Target-URI: " + _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(refers_to))}>", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_of(raw: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Fields and length of the record header that raw begins with."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].split(b"\r\n")[1:]
    fields = dict(x.split(b": ", 1) for x in lines if b": " in x)
    ok = fields.get(b"Content-Length", b"").isdigit() and b"WARC-Type" in fields
    return (fields, end + 4) if ok else None


class _Archives:
    """The archives of one task, each written under another name and renamed when whole."""

    def __init__(self, root: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(root)
        self.scheme = root[: len(root) - len(self.root)]
        self.n, self.out, self.done = 0, None, []

    def add(self, raw: bytes):
        if self.out is None:
            self.path = f"{self.root}/part-{TaskContext.get().partitionId():06d}-{self.n:04d}.warc"
            self.part, self.size, self.n = f"{self.path}.{uuid.uuid4().hex}", 0, self.n + 1
            self.out = self.fs.open_output_stream(self.part)
        self.out.write(raw)
        self.size += len(raw)
        if self.size >= FILE_BYTES:
            self.close()

    def close(self):
        if self.out is not None:
            self.out.close()
            self.fs.move(self.part, self.path)
            self.done.append((self.scheme + self.path, self.size))
            self.out = None


def _written(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    archives = _Archives(root)
    for pdf in batches:
        for page, url, html, to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
            archives.add(record(None if pd.isna(page) else int(page), url, (html or "").encode(), None if pd.isna(to) else int(to)))
    archives.close()
    yield pd.DataFrame(archives.done, columns=["uri", "size"])


def write_archives(pages: DataFrame, root: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns the manifest (uri, size).

    Of rows with equal payloads of at least least_bytes, the one with the largest page_id is the response and the others
    revisit it. A null html is an empty payload, a null url is left out; rows that repeat a page_id and payload are all
    responses unless a larger page_id has that payload; rows with a null page_id are responses that none refers to.
    """
    spark = pages.sparkSession
    small_batches(spark)
    root = root or shared_path(spark, "warc")
    fs, path = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    seen = store(pages.where("page_id is not null").select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("bytes")), "payloads")
    last = seen.where(f"bytes >= {least_bytes}").groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first")).where("first < refers_to")
    revisits = store(join_classes(seen, last.drop("first"), ["digest", "bytes"], "inner").where("page_id < refers_to").select("page_id", "refers_to").distinct(), "revisits")
    rows = join_ids(pages, revisits, "page_id", "left").select("page_id", "url", "html", "refers_to")
    return store(map_rows(rows, partial(_written, root=root), "uri string, size long"), "archives")


def _last_field(raw: bytes, start: int, end: int, name: bytes) -> tuple[int, bytes]:
    """Place and value of the last line between start and end that has the field; -1 if none has."""
    key = b"\r\n" + name + b": "
    at = raw.rfind(key, start, end)
    return (at, raw[at + len(key) : raw.find(b"\r\n", at + 2, end + 2)]) if at >= 0 else (-1, b"")


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of each range: off, next (its successor) and exit (the first place beyond the range that it leads to)."""
    for pdf in batches:
        for uri, lo, hi, size in zip(pdf["uri"], pdf["lo"], pdf["hi"], pdf["size"], strict=True):
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                f.seek(lo)
                raw = f.read(min(size, hi + HEADER_BYTES) - lo)
                # the header that begins last may be longer: on to a blank line behind it
                last = max((m.start() for m in MAGIC.finditer(raw) if m.start() < hi - lo), default=-1)
                more, tail = [], raw[last:] if last >= 0 else b"\r\n\r\n"
                while b"\r\n\r\n" not in tail and (part := f.read(HEADER_BYTES)):
                    more.append(part)
                    tail = tail[-3:] + part
                raw = b"".join([raw, *more])
            rows, blank = {}, -1
            for m in MAGIC.finditer(raw):
                at = m.start()
                if at >= hi - lo:
                    break
                if blank < at:  # magics up to a blank line have the header fields that follow them before it
                    blank = raw.find(b"\r\n\r\n", at)
                    if blank < 0:
                        break
                    length_at, length = _last_field(raw, at, blank, b"Content-Length")
                    type_at, _ = _last_field(raw, at, blank, b"WARC-Type")
                    known = length.isdigit() and len(length) < 19
                if known and at < length_at and at < type_at:
                    after = lo + blank + 8 + int(length)
                    if after <= size:
                        rows[lo + at] = after
            exits: dict[int, int] = {}
            for off in sorted(rows, reverse=True):
                after = rows[off]
                exits[off] = after if after >= hi else exits.get(after, -1)
            off = list(rows)
            yield pd.DataFrame({"uri": uri, "lo": lo, "off": np.array(off, dtype=np.int64), "next": np.array([rows[o] for o in off], dtype=np.int64), "exit": np.array([exits[o] for o in off], dtype=np.int64)})


def _chained(key, found: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
    if not len(entered) or not len(found):
        return pd.DataFrame(columns=["uri", "off", "next"])
    after = dict(zip(found["off"].tolist(), found["next"].tolist(), strict=True))
    out, at = [], int(entered["off"].min())
    while at in after:
        out.append((key[0], at, after[at]))
        at = after[at]
    return pd.DataFrame(out, columns=["uri", "off", "next"])


def record_places(manifest: DataFrame) -> DataFrame:
    """(uri, off, next) of the records that the chain from each file's start reaches; fails if a chain breaks off."""
    spark = manifest.sparkSession
    ranges = manifest.where("size > 0").select("uri", "size", F.explode(F.expr(f"sequence(0L, size - 1, {RANGE_BYTES}L)")).alias("lo"))
    ranges = ranges.withColumn("hi", F.least("size", F.col("lo") + RANGE_BYTES)).repartition(width(spark), "uri", "lo")
    found = store(map_rows(ranges, _scanned, "uri string, lo long, off long, next long, exit long"), "candidates")
    starts = manifest.where("size > 0").select("uri", F.lit(0).cast("long").alias("off"))
    targets = found.select("uri", F.col("exit").alias("off")).union(starts).distinct()
    jump = store(found.join(targets, ["uri", "off"]).select("uri", "off", F.col("exit").alias("to")), "jumps")
    reached, n = store(starts, "reached"), 0
    while (m := reached.count()) > n:
        n = m
        more = reached.join(jump, ["uri", "off"]).where("to >= 0").select("uri", F.col("to").alias("off"))
        reached = store(reached.union(more).distinct(), "reached")
        jump = store(jump.join(jump.select("uri", F.col("off").alias("to"), F.col("to").alias("far")), ["uri", "to"]).select("uri", "off", F.col("far").alias("to")), "jumps")
    whole = manifest.where("size > 0").join(reached.withColumnRenamed("off", "size"), ["uri", "size"], "left_anti")
    if not whole.isEmpty():
        raise ValueError(f"the records of {whole.first()[0]} do not reach its end")
    entered = reached.withColumn("lo", F.expr(f"off - off % {RANGE_BYTES}"))
    return found.groupBy("uri", "lo").cogroup(entered.groupBy("uri", "lo")).applyInPandas(_chained, "uri string, off long, next long")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for uri, group in pdf.groupby("uri", sort=False):
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                for off, after in zip(group["off"].tolist(), group["next"].tolist(), strict=True):
                    f.seek(off)
                    raw = f.read(after - off)
                    fields, start = header_of(raw)
                    block = raw[start:-4]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, to = fields[b"WARC-Type"].decode(), fields.get(b"X-Refers-To-Page-Id")
                    said = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (digest32(payload) != said or len(payload) != n):
                        raise ValueError(f"the payload at {off} of {uri} is not the one that was written")
                    page = fields.get(b"X-Page-Id")
                    out.append((page and int(page), n, said, kind, to and int(to)))
        page, n, said, kind, to = zip(*out, strict=True) if out else ((), (), (), (), ())
        yield pd.DataFrame({"page_id": pd.array(page, dtype="Int64"), "payload_bytes": n, "payload_digest": said, "record_type": kind, "refers_to": pd.array(to, dtype="Int64")})


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; payloads are checked."""
    places = record_places(manifest)
    # dealt by range: what a row of a few numbers names is a record of any size
    places = places.withColumn("lo", F.expr(f"off - off % {RANGE_BYTES}")).repartition(4 * width(manifest.sparkSession), "uri", "lo").sortWithinPartitions("uri", "off")
    return map_rows(places, _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

"""WARC records in ZIP packages, and a reader that takes records out by byte range.

A package is a ZIP of stored (uncompressed) members: `archive/data.warc.gz`, in which
every record is a gzip member of its own, and `indexes/index.cdxj`, a JSON line for each
record with its offset and length in that archive. The reader parses the end records
(ZIP64 where used), the central directory and the local headers by itself, reads all
indexes, in whatever order their lines are, and fetches the records of all members of
archive/ by their ranges; nothing is extracted.

Payload rules: of records with equal payloads of at least `least` bytes, the one with
the smallest page_id is a response and the others are revisits of it; smaller ones are
all responses. Null html is an empty payload; a null page_id never is revisited unless
no other has the payload; rows that share page_id and payload are responses alike; pages
of any length are one record; an empty table gives no packages and no rows. Columns besides
page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_dir, publish, read_range, store

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes of a package, and record bytes that one task reads, about.
PACKAGE, SPLIT = 24 << 20, 8 << 20
MANIFEST = "path string, size long"
DATE = "2024-01-01T00:00:00Z"


# writing --------------------------------------------------------------------------


def record(page: dict, digest: str) -> bytes:
    """A WARC/1.1 response or revisit with its HTTP head; the page_id is in the record id."""
    revisit, payload = page["refers_to"] is not None, page["payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page['page_id'] is None else page['page_id']}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page["url"] is not None:
        head.append("WARC-Target-URI: " + page["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{page['refers_to']}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def package(pages: list[dict], zip64: bool = False) -> bytes:
    """The bytes of a package of these pages (page_id, url, payload, refers_to)."""
    data, index = io.BytesIO(), []
    for p in pages:
        digest = base64.b32encode(hashlib.sha1(p["payload"]).digest()).decode()
        raw = gzip.compress(record(p, digest), 3, mtime=0)
        index.append(json.dumps({"url": p["url"], "digest": f"sha1:{digest}", "offset": data.tell(), "length": len(raw), "filename": ARCHIVE}))
        data.write(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in ((ARCHIVE, data.getvalue()), (INDEX, "".join(x + "\n" for x in index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(body)
    return out.getvalue()


#: Bytes of repeated digests that are sent to all executors at most, and what one takes there.
BROADCAST, REPEAT_BYTES = 64 << 20, 160


def with_referents(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to. The digest of every payload is grouped, and the
    smallest page_id of those that occur twice is joined back to the pages. If these take
    at most BROADCAST bytes by their count, they are sent to the pages; else the pages are
    shuffled by digest."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    size = F.octet_length("html")
    keyed = rows.withColumns({"_sha": F.sha1(F.col("html").cast("binary")), "_size": size})
    first = keyed.where(F.col("_size") >= least).groupBy("_sha", "_size").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = cut(first, "warc-repeats")
    if first.count() * REPEAT_BYTES <= BROADCAST:
        first = F.broadcast(first)
    joined = keyed.join(first, ["_sha", "_size"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, base: str, least: int = 0) -> DataFrame:
    """Write packages under `base`; the manifest (path, size) of those that count."""

    def run(batches):
        held, size = [], 0

        def flush():
            data = package(held)
            return pa.RecordBatch.from_arrays([pa.array([publish(base, "pages.wacz", data)]), pa.array([len(data)], pa.int64())], names=["path", "size"])

        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"].encode()
                held.append({"page_id": row["page_id"], "url": row["url"], "payload": payload, "refers_to": row["refers_to"]})
                size += len(payload)
                if size >= PACKAGE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return cut(with_referents(pages, least).mapInArrow(run, MANIFEST), "warc-manifest")


# reading --------------------------------------------------------------------------


def members(fs, path: str, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, offset of its local header, stored size), from the central directory."""
    tail_at = max(0, size - (22 + 0xFFFF))
    tail = read_range(fs, path, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError(f"{path}: no end of central directory")
    n, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF in (n,) or 0xFFFFFFFF in (length, offset):
        locator = tail_at + at - 20
        sign, _, end64, _ = struct.unpack("<4sIQI", read_range(fs, path, locator, 20))
        if sign != b"PK\x06\x07":
            raise ValueError(f"{path}: no ZIP64 locator")
        head = read_range(fs, path, end64, 56)
        if head[:4] != b"PK\x06\x06":
            raise ValueError(f"{path}: no ZIP64 end record")
        n, length, offset = struct.unpack_from("<QQQ", head, 32)
    directory, out, at = read_range(fs, path, offset, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError(f"{path}: broken central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        stored, full = struct.unpack_from("<II", directory, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, at + 28)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        wide, place = {}, 0
        while place + 4 <= len(extra):
            kind, k = struct.unpack_from("<HH", extra, place)
            wide[kind] = extra[place + 4 : place + 4 + k]
            place += 4 + k
        big = iter(struct.unpack(f"<{len(wide.get(1, b'')) // 8}Q", wide.get(1, b"")[: len(wide.get(1, b"")) // 8 * 8]))
        full = next(big) if full == 0xFFFFFFFF else full
        stored = next(big) if stored == 0xFFFFFFFF else stored
        local = next(big) if local == 0xFFFFFFFF else local
        out[name] = (method, local, stored)
        at += 46 + n_name + n_extra + n_comment
    return out


def member_range(fs, path: str, found: dict, name: str) -> tuple[int, int]:
    """Where a stored member's bytes are."""
    method, local, stored = found[name]
    if method:
        raise ValueError(f"{path}: {name} is not stored")
    head = read_range(fs, path, local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{path}: no local header of {name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + 30 + n_name + n_extra, stored


def parse(raw: bytes) -> dict:
    """Page id, type, digest, payload size and referent of one record; the payload of a
    response is checked against its digest. Records of other writers have no page id; what
    they do not say is null, and their payload is the block without an HTTP head."""
    head, _, block = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode(errors="replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    kind = fields.get("warc-type")
    block = block[: int(fields["content-length"])]
    http, payload = b"", block
    if block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload does not match its digest")

    def page(name: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None

    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("warc-refers-to"), "payload": payload}


def index_rows(fs, path: str, found: dict) -> dict[str, list[tuple[int, int]]]:
    """Archive member -> (offset, length) of its records in file order, from all indexes of
    the package: JSON lines, with or without a sort key before the object, plain or gzipped.
    A line's filename is that of a member of archive/; without one it is the only archive."""
    archives = sorted(n for n in found if n.startswith("archive/") and not n.endswith("/"))
    out: dict[str, set[tuple[int, int]]] = {n: set() for n in archives}
    for name in sorted(n for n in found if n.startswith("indexes/") and n.removesuffix(".gz").endswith((".cdx", ".cdxj"))):
        data = read_range(fs, path, *member_range(fs, path, found, name))
        if name.endswith(".gz"):
            data = gzip.decompress(data)
        for line in data.splitlines():
            at = line.find(b"{")
            if at < 0:
                continue  # a header line
            r = json.loads(line[at:])
            name_ = r.get("filename") or (archives[0] if len(archives) == 1 else None)
            member = next((n for n in (name_, f"archive/{name_}") if n in out), None)
            if member is None:
                raise ValueError(f"{path}: an index line names no archive of the package: {name_}")
            out[member].add((int(r["offset"]), int(r["length"])))
    return {n: sorted(v) for n, v in out.items()}


def splits(manifest: DataFrame, base: str, size: int = SPLIT) -> DataFrame:
    """Byte ranges of records that follow each other, of about `size` each: path, place of
    the range in the package, its bytes, and where its records begin in it. A range ends
    where the index leaves more than `size` bytes out; an archive that no index names is one
    range whose records are found by reading."""

    def run(batches):
        fs, root = store(base)
        for batch in batches:
            for m in batch.to_pylist():
                path = f"{root}/{m['path']}"
                found = members(fs, path, m["size"])
                for name, rows in index_rows(fs, path, found).items():
                    at, stored = member_range(fs, path, found, name)
                    if not rows:
                        yield row(m["path"], at, stored, [])
                        continue
                    offsets, lengths = np.array(rows, dtype=np.int64).T
                    ends = np.maximum.accumulate(offsets + lengths)
                    if ends[-1] > stored:
                        raise ValueError(f"{path}: an index line goes beyond {name}")
                    group = np.cumsum(lengths) // size + np.cumsum(np.diff(offsets, prepend=offsets[0]) > size)
                    edges = np.flatnonzero(np.diff(group, prepend=-1))
                    for a, b in zip(edges, np.append(edges[1:], len(group))):
                        start = int(offsets[a])
                        yield row(m["path"], at + start, int(ends[b - 1]) - start, (offsets[a:b] - start).tolist())

    def row(path, at, length, starts):
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([length], pa.int64()), pa.array([starts], pa.list_(pa.int64()))], names=["path", "at", "length", "starts"])

    return manifest.mapInArrow(run, "path string, at long, length long, starts array<long>")


def records_of(data: bytes, starts: list[int]) -> list[bytes]:
    """The records of a range: each a gzip member of its own (or plain, in a plain archive)."""

    def one(at: int) -> tuple[bytes, int]:
        if data[at : at + 2] != b"\x1f\x8b":
            head = data.index(b"\r\n\r\n", at) + 4
            length = next(int(x.split(b":")[1]) for x in data[at:head].split(b"\r\n") if x.lower().startswith(b"content-length:"))
            return data[at : head + length], head + length + 4
        d = zlib.decompressobj(31)
        out = d.decompress(data[at:]) + d.flush()
        return out, len(data) - len(d.unused_data)

    if starts:
        ends = [*starts[1:], len(data)]
        return [zlib.decompress(data[a:b], 31) if data[a : a + 2] == b"\x1f\x8b" and b > a else one(a)[0] for a, b in zip(starts, ends)]
    out, at = [], 0
    while at < len(data):
        raw, at = one(at)
        out.append(raw)
    return out


def read(spark: SparkSession, manifest: DataFrame, base: str, payload: bool = False) -> DataFrame:
    """One row for each record of the packages in the manifest, in any order: of all members
    of archive/, whatever the order of the index."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payload:
        names, kinds, schema = [*names, "payload"], [*kinds, pa.binary()], schema + ", payload binary"

    def run(batches):
        fs, root = store(base)
        for batch in batches:
            for s in batch.to_pylist():
                data = read_range(fs, f"{root}/{s['path']}", s["at"], s["length"])
                rows = [parse(raw) for raw in records_of(data, s["starts"])]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names=names)

    n = max(1, manifest.count())
    ranges = cut(splits(manifest.repartition(n, "path"), base), "warc-splits")
    return ranges.repartition(max(1, ranges.count())).mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    spark = pages.sparkSession
    base = new_dir(spark, "warc")
    return read(spark, write(pages, base, least), base).drop("url")

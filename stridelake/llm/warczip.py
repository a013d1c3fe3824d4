"""WARC records in ZIP packages: write them, and read them by byte range.

A package is a ZIP with stored members ``archive/data.warc.gz`` (one gzip member a
record) and ``indexes/index.cdxj`` (a line a record: offset and length within the
archive member).  The reader fetches the tail of the file, finds the end-of-central-
directory record (ZIP64 if need be), walks the central directory, locates the stored
members, reads the index, and then each record by its byte range; nothing is extracted.
Packages live in the folder that the cluster shares.  ``read_records`` reads packages of other
makers too: several archives, indexes of ``key timestamp {json}`` lines, compressed or not.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stridelake.operators.scratch import Scratch

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ROWS = 20_000  # records a package
BYTES = 256 << 20  # payload bytes a package


def open_store(uri: str):
    """The file system and the path behind a URI or a plain path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


# ---- ZIP directories


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int  # offset of the local header


def _at(f, offset: int, n: int) -> bytes:
    f.seek(offset)
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"the file ends within the {n} bytes at {offset}")
    return got


def members(f, length: int) -> list[Member]:
    """The central directory of the ZIP file ``f``, ZIP64 or not.  ValueError if there is none."""
    tail_at = max(0, length - 65_557)
    tail = _at(f, tail_at, length - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    while k >= 0 and (len(tail) - k < 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(b"PK\x05\x06", 0, k)
    if k < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, k + 10)
    if (count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF) and k + tail_at >= 20:
        locator = _at(f, tail_at + k - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            end = _at(f, struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points to no ZIP64 end record")
            count, size, start = struct.unpack_from("<QQQ", end, 32)
    raw, out, at = _at(f, start, size), [], 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", raw, at + 10)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
        (header,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8")
        extra, e = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: only the fields that overflowed, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            e += 4 + n
        out.append(Member(name, method, full, packed, header))
        at += 46 + n_name + n_extra + n_note
    return out


def stored_range(f, m: Member) -> tuple[int, int]:
    """Offset and length of a stored member's bytes; ValueError if it is compressed."""
    if m.method != 0:
        raise ValueError(f"{m.name} is compressed, so that its records have no byte ranges")
    head = _at(f, m.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {m.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + n_name + n_extra, m.packed


def whole_member(f, m: Member) -> bytes:
    """A small member's bytes, stored or deflated; gunzipped if its name says so."""
    head = _at(f, m.header, 30)
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    raw = _at(f, m.header + 30 + n_name + n_extra, m.packed)
    if m.method == 8:
        raw = zlib.decompress(raw, -15)
    elif m.method:
        raise ValueError(f"{m.name} is packed by a method that is not known here ({m.method})")
    return gzip.decompress(raw) if m.name.endswith(".gz") else raw


def index_entries(f, inside: dict[str, Member]) -> list[tuple[str, int, int]]:
    """``(archive member, offset, length)`` of every line of every index, in order.

    A line ends in a JSON object with ``offset``, ``length`` and, where there are several archives, ``filename``.
    """
    archives = [n for n in inside if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))]
    by_name = {n.rsplit("/", 1)[-1]: n for n in archives}
    out = []
    for name in sorted(n for n in inside if n.startswith("indexes/") and n.removesuffix(".gz").endswith((".cdxj", ".cdx"))):
        for line in whole_member(f, inside[name]).decode("utf-8").splitlines():
            at = line.find("{")
            if at < 0 or line.startswith("!"):
                continue
            entry = json.loads(line[at:])
            if "offset" not in entry or "length" not in entry:
                continue
            if "filename" not in entry and len(archives) != 1:
                raise ValueError(f"{name}: a line names no archive, and there are {len(archives)}")
            own = by_name.get(entry["filename"].rsplit("/", 1)[-1]) if "filename" in entry else archives[0]
            if own is None:
                raise ValueError(f"{name}: no archive {entry['filename']}")
            out.append((own, int(entry["offset"]), int(entry["length"])))
    return out


# ---- WARC records


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One gzipped WARC record; a revisit (``refers_to`` given) has no payload of its own."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def read_record(raw: bytes) -> dict:
    """Parse one record and check its lengths and, for a response, its digest."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(field["Content-Length"])]
    page = lambda v: (int(x) if (x := v.removeprefix("<urn:page:").removesuffix(">")) else None)
    out = {"page_id": page(field["WARC-Record-ID"]), "url": field.get("WARC-Target-URI"), "record_type": field["WARC-Type"], "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(field["X-Payload-Length"]), "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = page(field["WARC-Refers-To"])
    else:
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if len(out["payload"]) != out["payload_bytes"] or payload_digest(out["payload"]) != out["payload_digest"]:
            raise ValueError(f"record {out['page_id']}: its payload doesn't match its digest")
    return out


def parse_record(raw: bytes) -> dict:
    """Any WARC record, gzipped or not: ``record_id, record_type, url, date, payload_digest, payload``.

    The payload of an HTTP record is what follows its header, else the block; a digest that the
    record states is checked if it is one of SHA-1 and the record has its payload.
    """
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(field["content-length"])]
    http = field.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    digest = field.get("warc-payload-digest")
    kind = field.get("warc-type")
    if kind == "response" and digest and digest.startswith("sha1:") and payload_digest(payload) != digest[5:]:
        raise ValueError(f"record {field.get('warc-record-id')}: its payload doesn't match its digest")
    return {"record_id": field.get("warc-record-id", "").strip("<>") or None, "record_type": kind, "url": field.get("warc-target-uri"), "date": field.get("warc-date"), "payload_digest": digest, "payload": None if kind == "revisit" else payload}


# ---- Spark


def _writer(root: str):
    def run(batches):
        task = TaskContext.get()
        store, base = open_store(root)
        store.create_dir(base, recursive=True)
        k = 0
        held: list[bytes] = []
        size = 0

        def close():
            nonlocal k, held, size
            lines, at = [], 0
            for raw in held:
                lines.append(json.dumps({"offset": at, "length": len(raw)}))
                at += len(raw)
            # a name of its own for each attempt: the manifest names the ones that count
            name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{k}.zip"
            with store.open_output_stream(name) as sink, zipfile.ZipFile(io.BufferedWriter(_Raw(sink)), "w", zipfile.ZIP_STORED, allowZip64=True) as out:
                with out.open(ARCHIVE, "w", force_zip64=True) as f:
                    for raw in held:
                        f.write(raw)
                out.writestr(INDEX, "\n".join(lines))
                out.writestr("datapackage.json", json.dumps({"profile": "data-package", "records": len(held)}))
            k, n, held, size = k + 1, len(held), [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["package", "records"])

        for b in batches:
            for i, url, html, to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                held.append(write_record(i, url, (html.as_py() or "").encode("utf-8", "surrogatepass"), to))
                size += len(held[-1])
                if len(held) >= ROWS or size >= BYTES:
                    yield close()
        if held:
            yield close()

    return run


class _Raw(io.RawIOBase):
    """A write-only view of an Arrow stream for zipfile, which then writes without seeking."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self):
        return True

    def write(self, data):
        self.sink.write(bytes(data))
        return len(data)


def write_packages(pages: DataFrame, root: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row into packages under ``root``; returns the manifest plan ``package, records``.

    The payload is the html in UTF-8 (null: empty).  Of rows whose payloads are equal and
    have at least ``min_bytes`` bytes, those with the smallest key are responses and the
    others revisits; smaller payloads are all responses.  A null key is never referred to:
    such a row is a revisit if an equal payload has a key, else a response.  Rows that repeat
    the smallest key are all responses.  A null url leaves the target out.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("i"), F.col(url).cast("string").alias("u"), body.alias("h"), F.sha1(body).alias("d"))
    same = rows.where(F.octet_length("h") >= min_bytes).groupBy("d").agg(F.min("i").alias("low"), F.count("*").alias("n")).where("n > 1").select("d", "low")
    to = F.when((F.octet_length("h") >= min_bytes) & ~F.col("i").eqNullSafe(F.col("low")), F.col("low"))
    linked = rows.join(same.hint("shuffle_hash"), "d", "left").select("i", "u", "h", to.alias("to"))
    return linked.mapInArrow(_writer(root), "package string, records bigint")


def read_packages(manifest: DataFrame, root: str, payload: bool = False) -> DataFrame:
    """Records of the packages that ``manifest`` names, read by byte range.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and, with
    ``payload``, the bytes of responses.  Responses are checked against their digests.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        store, _ = open_store(root)
        for b in batches:
            for name, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                length = store.get_file_info(name).size
                with store.open_input_file(name) as f:
                    inside = {m.name: m for m in members(f, length)}
                    at, n = stored_range(f, inside[INDEX])
                    lines = [json.loads(x) for x in _at(f, at, n).decode().splitlines()]
                    if len(lines) != expected:
                        raise ValueError(f"{name}: {len(lines)} records, {expected} were written")
                    at, n = stored_range(f, inside[ARCHIVE])
                    for k in range(0, len(lines), 500):
                        got = [read_record(_at(f, at + x["offset"], x["length"])) for x in lines[k : k + 500]]
                        yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in zip(names, kinds)], names=names)

    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload
    spread = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "package")
    return spread.mapInArrow(run, ddl)


def read_records(packages: DataFrame, root: str, package: str = "package") -> DataFrame:
    """Records of the ZIP packages named in ``packages``, in the store of ``root``: a row for each index line.

    ``package, record_id, record_type, url, date, payload_digest, payload``; a package without an
    index has no rows, null names none.  Indexes are read whole, archives by byte range.
    """
    names = ["package", "record_id", "record_type", "url", "date", "payload_digest", "payload"]
    kinds = [pa.string()] * 6 + [pa.binary()]

    def run(batches):
        store, _ = open_store(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                if name is None:
                    continue
                with store.open_input_file(name) as f:
                    inside = {m.name: m for m in members(f, f.size())}
                    lines = index_entries(f, inside)
                    starts = {n: stored_range(f, inside[n])[0] for n in {n for n, _, _ in lines}}
                    for k in range(0, len(lines), 500):
                        got = [parse_record(_at(f, starts[n] + at, size)) | {"package": name} for n, at, size in lines[k : k + 500]]
                        yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in zip(names, kinds)], names=names)

    spread = packages.select(package).repartition(max(1, int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))), package)
    return spread.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'payload' else 'string'}" for n in names))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into packages in the shared folder and read the records back.

    One row for each row of ``pages``; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    root = scratch.path("packages")
    manifest = scratch.keep(write_packages(pages, root, min_bytes), "manifest")
    return read_packages(manifest, root)

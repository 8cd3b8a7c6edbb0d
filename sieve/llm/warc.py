"""WARC archives: writing with revisits, parallel reading, and transaction assembly.

Writing: each page is a capture of three records: ``request``, ``response`` (or ``revisit``, when an equal payload has its response
elsewhere) and ``metadata``; request and metadata name the response in ``WARC-Concurrent-To``. Every record is a gzip
member of its own, as WARC readers expect. Tasks write files named by attempt into the shared folder and return a manifest
row for each finished file; the manifest is a written table, so lost executors and speculative attempts leave only files that
nobody reads.

Reading: files are dealt to tasks by the manifest, streamed and cut by Content-Length.

Assembly: request, response and metadata records are joined through the concurrent-to identifiers into one nested
row per capture.

Cases: a null html is an empty payload; empty payloads are payloads like any other; a null url is written as ``urn:none``, and
white space and control characters in one are percent-encoded; a null page_id is kept as null, sorts last among equal payloads,
and revisits of it have a null refers_to; repeated rows are captures of their own (numbered by their place in the input); an empty table gives an
empty manifest and no captures; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import as_uri, attempt_name, join_staged, open_input, open_output, scratch_path, stage

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20

MANIFEST = "uri string, records long, bytes long"
RECORDS = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
           "content_type string, digest string, payload_bytes long, payload binary, fields map<string,string>")


def base32_of_hex(hex_col) -> F.Column:
    """Upper-case base32 (RFC 4648) of a 40-digit hex string: ten hex digits are eight base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex_col, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with their capture number, payload digest and the capture that an equal payload is stored under.

    ``min_bytes``: payloads shorter than this are always stored."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("capture"), F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), payload.alias("html"))
    # Written once: the digests are grouped and the rows joined with the groups, and both must see the same capture numbers.
    rows = stage(rows.withColumn("digest", base32_of_hex(F.sha1(F.col("html").cast("binary")))), "captures")
    order = F.struct(F.col("page_id").isNull().alias("late"), "page_id", "capture")
    equal = (rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("digest", F.col("first.page_id").alias("first_page"), F.col("first.capture").alias("first_capture")))
    rows = join_staged(rows, stage(equal, "equal-payloads"), ["digest"])
    again = (F.octet_length("html") >= min_bytes) & F.col("first_capture").isNotNull() & (F.col("first_capture") != F.col("capture"))
    return rows.select("capture", "page_id", "url", "html", "digest", again.alias("again"), "first_page", "first_capture")


def record_id(page_id, capture, kind: str) -> str:
    return f"<urn:capture:{'none' if page_id is None else page_id}:{capture}:{kind}>"


def _member(kind: str, ident: str, fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def capture_records(row: dict, level: int = 4) -> list[bytes]:
    """The three gzip members of a capture."""
    page, number = row["page_id"], row["capture"]
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]) if row["url"] else "urn:none"
    me, body = record_id(page, number, "response"), row["html"].encode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("Content-Type", "application/http; msgtype=response")]
    if row["again"]:
        refers = ("WARC-Refers-To", record_id(row["first_page"], row["first_capture"], "response"))
        main = _member("revisit", me, [*common, refers, ("WARC-Profile", REVISIT_PROFILE)], head, level)
    else:
        main = _member("response", me, common, head + body, level)
    request = _member("request", record_id(page, number, "request"),
                      [("WARC-Target-URI", uri), ("WARC-Concurrent-To", me), ("Content-Type", "application/http; msgtype=request")],
                      f"GET {uri} HTTP/1.1\r\n\r\n".encode(), level)
    notes = f"page-id: {'' if page is None else page}\r\npayload-length: {len(body)}\r\n"
    meta = _member("metadata", record_id(page, number, "metadata"),
                   [("WARC-Target-URI", uri), ("WARC-Concurrent-To", me), ("Content-Type", "application/warc-fields")], notes.encode(), level)
    return [request, main, meta]


def write_warc(rows: DataFrame, path: str, *, file_bytes: int = 64 << 20) -> DataFrame:
    """Write ``captures`` rows as ``.warc.gz`` files under ``path``; returns the manifest."""
    root = as_uri(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, uri, records, size, made = None, "", 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if sink is None:
                        uri = f"{root}/{attempt_name('pages', f'-{made:05d}.warc.gz')}"
                        sink, records, size, made = open_output(uri), 0, 0, made + 1
                    for member in capture_records(row):
                        sink.write(member)
                        records, size = records + 1, size + len(member)
                    if size >= file_bytes:
                        sink.close()
                        yield pa.RecordBatch.from_pylist([{"uri": uri, "records": records, "bytes": size}], schema=schema)
                        sink = None
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"uri": uri, "records": records, "bytes": size}], schema=schema)

    schema = pa.schema([("uri", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    return stage(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class _Stream:
    """Bytes of concatenated gzip members (or of a plain file) with exact reads."""

    def __init__(self, source):
        self.source, self.held, self.packed, self.rest = source, b"", None, b""

    def _more(self) -> bool:
        data = self.rest or self.source.read(CHUNK)
        self.rest = b""
        if not data:
            return False
        if self.packed is None:
            self.packed = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else False
        if self.packed is False:
            self.held += data
            return True
        self.held += self.packed.decompress(data)
        if self.packed.eof:
            self.rest, self.packed = self.packed.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and without ``mark``; None at the end."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out, self.held = self.held[:at], self.held[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        parts, got = [], 0
        while got < n:
            if not self.held and not self._more():
                raise ValueError("archive ends within a record")
            part, self.held = self.held[:n - got], self.held[n - got:]
            parts.append(part)
            got += len(part)
        return b"".join(parts)


def parse_warc(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        stream.take(4)  # the empty lines that end a record
        yield fields, block


def read_warc(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """A row per record. ``digest`` is computed from the payload where the record has one, else taken from its header;
    without ``payloads`` the payload bytes are left out of the result (they are still read and digested)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_input(uri) as source:
                    for f, block in parse_warc(source):
                        kind, body, fields, digest = f.get("warc-type"), None, {}, f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        elif kind == "metadata":
                            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode(errors="replace").splitlines()) if k.strip()}
                        rows.append({"record_id": f.get("warc-record-id"), "record_type": kind, "concurrent_to": f.get("warc-concurrent-to"),
                                     "refers_to": f.get("warc-refers-to"), "target_uri": f.get("warc-target-uri"), "date": f.get("warc-date"),
                                     "content_type": f.get("content-type"), "digest": digest, "payload_bytes": None if body is None else len(body),
                                     "payload": body if payloads else None, "fields": list(fields.items())})
                        size += len(block) if payloads else 300
                        if size >= CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    text = [(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "date", "content_type", "digest")]
    schema = pa.schema([*text, ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
    files = manifest.select("uri").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (the response's or revisit's id), response, request, metadata (structs; null if absent).

    Requests and metadata that name no stored response are captures of their own. Should an archive hold several requests or metadata
    records for one response, the one with the smallest id is taken (aggregated before the join, so no identifier is hot in it)."""
    body = [c for c in records.columns if c not in ("record_type", "concurrent_to")]
    main = records.where(F.col("record_type").isin("response", "revisit") & F.col("record_id").isNotNull())
    main = main.select(F.col("record_id").alias("capture"), F.struct("record_type", *body).alias("response"))

    def part(kind: str) -> DataFrame:
        mine = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        row = F.struct(*[c for c in body if c != "fields"], *([F.map_entries("fields").alias("fields")] if kind == "metadata" else []))
        return mine.groupBy(F.col("concurrent_to").alias("capture")).agg(F.min_by(row, "record_id").alias(kind))

    return main.join(part("request"), "capture", "full_outer").join(part("metadata"), "capture", "full_outer")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The digest of op5: write all pages to archives in the shared folder, read them back, assemble the captures."""
    manifest = write_warc(captures(pages, min_bytes), scratch_path(pages.sparkSession, "warc"))
    records = stage(read_warc(manifest, payloads=False), "warc-records")
    # A payload's size and digest are those of the response read back, which a revisit names.
    stored = stage(records.where(F.col("record_type") == "response").select(F.col("record_id").alias("stored"), "payload_bytes", "digest"), "warc-stored")
    whole = assemble(records).withColumn("stored", F.coalesce("response.refers_to", "capture"))
    notes, page = F.map_from_entries("metadata.fields"), F.col("response.refers_to")
    return join_staged(whole, stored, ["stored"]).select(
        F.nullif(notes["page-id"], F.lit("")).cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), F.nullif(F.split(page, ":")[2], F.lit("none")).cast("long").alias("refers_to"),
        F.col("request.target_uri").alias("target_uri"))

"""WARC archives: write one capture a page, read them back, assemble transactions.

Writing: pages with equal payloads of at least MIN_REVISIT bytes form a group;
the one with the smallest id is a response and the others are revisits of it.
Each page gives a request, a response or revisit, and a metadata record, tied
by WARC-Concurrent-To.  Records are separate gzip members, as the format's
convention has it, so a reader can start at any of them.

Record ids are made of the page's id, url and payload digest and of a number
among equal rows, all known before anything is dealt out, so they are the same
in every attempt and under any partitioning.  A revisit names its response by
WARC-Refers-To.

Reading: every file is parsed from its bytes.  ``assemble`` joins request and
metadata records to their response through the concurrent-to identifiers, in
either direction, and emits one nested row a capture.  ``round_trip`` finds the
page that a revisit refers to by joining WARC-Refers-To to the record ids.

Defined results: a null html is an empty payload; a null url writes no target;
repeated rows are captures of their own, and of one id with several payloads
each belongs to the group of its payload; a null id comes last in its group, is
written as no page id and read back null; an empty table writes no archive.
Records that name no capture in the files come out as captures without a
response, and a revisit of a record that is not there refers to null.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, attach_unique, get_file, put_file, task_number

MIN_REVISIT = 100
ROLL_BYTES = 48 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "strata:capture")

RECORDS = ("record_id string, type string, concurrent_to string, refers_to string, uri string, date string, "
           "status int, payload_bytes long, payload_digest string, fields map<string,string>, payload binary")


def record_id(name: str, turn: int, role: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{name}/{turn}/{role}')}>"


def record(kind: str, rid: str, block: bytes, content_type: str, **more: str | None) -> bytes:
    """One gzip member: the headers, the block and the two closing line ends."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}",
             f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    lines += [f"WARC-{name.replace('_', '-')}: {value}" for name, value in more.items() if value is not None]
    return zlib.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, 31)


def _safe(url: str | None) -> str | None:
    if url is None:
        return None
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def capture(name: str, turn: int, page: int | None, url: str | None, payload: bytes, digest: str, first: str | None) -> list[bytes]:
    """The three records of a page; name: its row's; first: that of the response it repeats."""
    target = _safe(url)
    kind = "response" if first is None else "revisit"
    main = record_id(name, turn, "main")
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    more = {"Target_URI": target, "Payload_Digest": f"sha256:{digest}"}
    if first is not None:
        more |= {"Profile": PROFILE, "Refers_To": record_id(first, 0, "main")}
    ask = f"GET {target or '/'} HTTP/1.1\r\nAccept: text/html\r\n\r\n".encode()
    tell = b"" if page is None else f"page-id: {page}\r\n".encode()
    return [
        record("request", record_id(name, turn, "request"), ask, "application/http;msgtype=request",
               Target_URI=target, Concurrent_To=main),
        record(kind, main, http + (payload if first is None else b""), "application/http;msgtype=response", **more),
        record("metadata", record_id(name, turn, "metadata"), tell, "application/warc-fields",
               Target_URI=target, Concurrent_To=main)]


def write(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; one manifest row a file."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    wide = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    wide = wide.withColumn("name", F.sha2(F.to_json(F.struct("id", "url", "digest")), 256))
    # Equal rows are one here, whose number is ``times``.
    rows = scratch.keep(wide.groupBy("name", "id", "url", "digest", (F.octet_length("html") >= MIN_REVISIT).alias("large")).agg(
        F.count("*").alias("times")), "rows")
    large = rows.where("large").select("name", "id", "digest")
    groups = rows.where("large").groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull(), "id", F.col("url").isNull(), "url", "name")).alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = attach_unique(large, scratch.keep(groups, "groups"), "digest", "n", "inner").where(
        ~F.col("id").eqNullSafe(F.col("first.id"))).select("name", F.col("first.name").alias("first"))
    told = numbered(wide, rows.where("times > 1").select("name", "times")).join(revisits, "name", "left")
    folder = scratch.path("archives")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = record("warcinfo", f"<urn:uuid:{uuid.uuid5(_NAMES, 'info')}>", b"format: WARC File Format 1.1\r\n",
                      "application/warc-fields")
        parts, held, pages, files = [info], 0, 0, 0

        def finish() -> pa.RecordBatch:
            data = b"".join(parts)
            uri = f"{folder}/part-{task_number():06d}-{files:04d}-{zlib.crc32(data):08x}.warc.gz"
            put_file(uri, data)
            return pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([pages], pa.int64()), pa.array([len(data)], pa.int64())],
                names=["path", "captures", "bytes"])

        for batch in it:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                made = capture(*row)
                parts += made
                held, pages = held + sum(map(len, made)), pages + 1
                if held >= ROLL_BYTES:
                    yield finish()
                    parts, held, pages, files = [info], 0, 0, files + 1
        if pages:
            yield finish()

    return scratch.keep(told.select("name", "turn", "id", "url", "html", "digest", "first").mapInArrow(
        work, "path string, captures long, bytes long"), "manifest")


def numbered(wide: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows with their number among equal ones, ``turn``.

    Equal rows are alike, so their number is all there is to them: they are
    brought down to one, before any shuffle, and laid out again.
    """
    if repeated.isEmpty():
        return wide.withColumn("turn", F.lit(0))
    marked = wide.join(repeated, "name", "left")
    once = marked.where("times is null").drop("times").withColumn("turn", F.lit(0))
    fields = [c for c in wide.columns if c != "name"]
    many = marked.where("times is not null").groupBy("name").agg(*[F.first(c).alias(c) for c in [*fields, "times"]])
    return once.unionByName(many.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1))).drop("times"))


def members(data: bytes) -> Iterator[bytes]:
    """The records of a gzip archive, one after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            part = view[at:at + (1 << 14)]
            if not len(part):
                raise ValueError("the archive ends inside a record")
            out.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """A record's headers, its payload's length and digest, and its fields."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:20]!r}")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(named["content-length"])]
    out = {"record_id": named.get("warc-record-id"), "type": named.get("warc-type"),
           "concurrent_to": named.get("warc-concurrent-to"), "refers_to": named.get("warc-refers-to"),
           "uri": named.get("warc-target-uri"), "date": named.get("warc-date"), "status": None,
           "payload_bytes": None, "payload_digest": None, "fields": [], "payload": None}
    if out["type"] in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        answer = http.decode("latin-1").split("\r\n")
        length = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in answer[1:])}
        out["status"] = int(answer[0].split()[1])
        if out["type"] == "response":
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
        else:
            out["payload_bytes"] = int(length["content-length"]) if "content-length" in length else None
            out["payload_digest"] = named.get("warc-payload-digest", "").rpartition(":")[2] or None
    elif named.get("content-type") == "application/warc-fields":
        out["fields"] = [(k.strip(), v.strip()) for k, _, v in
                         (x.partition(":") for x in block.decode().split("\r\n") if x)]
    return out


def read(manifest: DataFrame, files: int, payloads: bool = False) -> DataFrame:
    """One row a record of the archives that the manifest names."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = ["record_id", "type", "concurrent_to", "refers_to", "uri", "date", "status",
                 "payload_bytes", "payload_digest", "fields", "payload"]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        for got in it:
            for uri in got.column(0).to_pylist():
                rows, held = [], 0
                for raw in members(get_file(uri)):
                    row = parse(raw)
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(raw) if payloads else 1000
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return manifest.select("path").repartition(max(1, files)).mapInArrow(work, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response, requests and metadata."""
    main = F.col("type").isin("response", "revisit", "resource")
    primary = records.where(main)
    others = records.where(~main & (F.col("type") != "warcinfo"))
    # A response may itself name the record that it is concurrent to.
    named = primary.where(F.col("concurrent_to").isNotNull()).groupBy(
        F.col("concurrent_to").alias("record_id")).agg(F.min("record_id").alias("owner"))
    tied = others.join(named, "record_id", "left").select(
        F.coalesce("concurrent_to", "owner", "record_id").alias("capture_id"), "type",
        F.struct("record_id", "uri", "date", "fields").alias("r"))
    sides = tied.groupBy("capture_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct(
            "r.record_id", "r.uri", "r.date", F.map_entries("r.fields").alias("fields"))))),
            lambda r: F.struct(r["record_id"].alias("record_id"), r["uri"].alias("uri"), r["date"].alias("date"),
                               F.map_from_entries(r["fields"]).alias("fields"))).alias(name)
        for kind, name in (("request", "requests"), ("metadata", "metadata"))])
    response = primary.select(F.col("record_id").alias("capture_id"), F.struct(
        "record_id", "type", "uri", "date", "status", "payload_bytes", "payload_digest", "refers_to", "payload").alias("response"))
    return response.join(sides, "capture_id", "full")


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages, read the archives back, and report each capture."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = write(pages, scratch, id_col, url, html)
    captures = scratch.keep(assemble(read(manifest, manifest.count())).select(
        "capture_id", page_id().alias("page"), "response.payload_bytes", "response.payload_digest",
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target")), "captures")
    return referred(captures, scratch).select(
        F.col("page").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("referred").alias("refers_to"))


def page_id() -> Column:
    """The page id that a capture's metadata names."""
    return F.col("metadata")[0]["fields"]["page-id"].cast("long")


def referred(captures: DataFrame, scratch: Scratch) -> DataFrame:
    """The captures with the page of the record that they refer to."""
    aimed = captures.where("target is not null")
    named = captures.select(F.col("capture_id").alias("target"), F.col("page").alias("referred"))
    # A response that many refer to is one row here.
    side = scratch.keep(aimed.groupBy("target").agg(F.count("*").alias("n")).join(named, "target", "left"), "targets")
    return attach_unique(aimed, side, "target", "n").drop("n").unionByName(
        captures.where("target is null").withColumn("referred", F.lit(None).cast("long")))

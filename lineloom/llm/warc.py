"""WARC archives as a chunked record table: written and read by Spark alone, on any store it knows.

A record is a row (record, chunk, ...) per WARC segment. Payloads are cut where they lie into chunks of at most
``chunk_bytes`` (at a character's end); each chunk row carries its record, its number and the size and digest of the
payload so far, so nothing holds a second copy of a payload and the last row has the whole one's digest. A payload above one
chunk becomes a first segment and ``continuation`` records (WARC-Segment-Number, WARC-Segment-Origin-ID).
Files are text, gzipped as a whole, one ``warcinfo`` record first. Readers cut at the version mark and put a block
together again up to its Content-Length, so payloads may hold the mark; archives of others (WARC/1.0, any record ids,
one gzip member a record) can be read too.

Edge cases: null payload is empty; every row has a record of its own, named by a UUID; of rows with equal payloads those
with the smallest page_id are responses, the others revisit one of them; a null page_id is always a response;
columns besides id, url and payload are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, Scratch

MARK = "WARC/1."
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK_BYTES, OUT_BYTES = 1 << 18, 4 << 20
PARTS = "record string, page_id long, url string, chunk int, last boolean, size long, digest string, data binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _typed(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def _batches(rows, schema: pa.Schema, weight):
    """Record batches of dict rows, each of about OUT_BYTES at most."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weight(r) + 200
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def chunks_of(payload: memoryview, chunk: int):
    """(bytes, last) parts of at most about `chunk` bytes that end with a whole character; one empty part for nothing."""
    at, n = 0, len(payload)
    while True:
        end = min(n, at + max(chunk, 4))
        while end < n and payload[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        yield payload[at:end], end == n
        if end == n:
            return
        at = end


def parts(pages: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of pages (page_id, url, payload): PARTS, size and digest being those of the payload so far."""
    schema = _typed(PARTS)

    def rows(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, urls, payload = b.column("page_id"), b.column("url"), b.column("payload").cast(pa.binary())
            for i in range(b.num_rows):
                page, n = ids[i].as_py(), n + 1
                name = f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}/{task}/{n}'.encode()).digest(), version=3)}"
                view = memoryview(payload[i].as_buffer()) if payload[i].is_valid else memoryview(b"")
                h, size = hashlib.sha1(), 0
                for k, (data, last) in enumerate(chunks_of(view, chunk)):
                    h.update(data)
                    size += len(data)
                    yield {"record": name, "page_id": page, "url": urls[i].as_py() if k == 0 else None, "chunk": k, "last": last, "size": size, "digest": base32(h.digest()), "data": bytes(data)}

    return pages.mapInArrow(lambda batches: _batches(rows(batches), schema, lambda r: len(r["data"])), PARTS)


def segments(table: DataFrame) -> DataFrame:
    """(value): WARC records of chunk rows with refers_to, total and whole (size and digest of the whole payload)."""
    schema = _typed("value string")

    def text(r: dict) -> str:
        first, revisit = r["chunk"] == 0, r["refers_to"] is not None
        kind = "continuation" if not first else "revisit" if revisit else "response"
        name = r["record"] if first else f"{r['record']}:{r['chunk'] + 1}"
        data = b"" if revisit else r["data"]
        block = HTTP + data if first else data
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
        if first:
            head += [f"WARC-Target-URI: {re.sub('[\x00-\x20]', '', r['url'] or 'urn:none')}", f"WARC-Payload-Digest: sha1:{r['whole']}", f"X-Payload-Length: {r['total']}"]
            head += [f"X-Page-ID: {r['page_id']}"] if r["page_id"] is not None else []
        if revisit:
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{r['refers_to']}>"]
        elif not (first and r["last"]):
            head += [f"WARC-Segment-Number: {r['chunk'] + 1}", f"X-Payload-Digest-So-Far: sha1:{r['digest']}"]
            head += [f"WARC-Segment-Origin-ID: <{r['record']}>"] if not first else []
            head += [f"WARC-Segment-Total-Length: {len(HTTP) + r['total']}"] if r["last"] else []
        head += [f"Content-Type: {'application/http; msgtype=response' if first else 'application/octet-stream'}", f"Content-Length: {len(block)}"]
        return f"{MARK}1\r\n" + "\r\n".join(head) + "\r\n\r\n" + block.decode("utf-8", "replace")

    def rows(batches):
        info = b"software: chunked record table\r\nformat: WARC File Format 1.1\r\n"
        yield {"value": f"{MARK}1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(int=TaskContext.get().partitionId())}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info.decode()}"}
        for b in batches:
            for i in range(b.num_rows):
                yield {"value": text({c: b.column(c)[i].as_py() for c in b.schema.names})}

    return table.mapInArrow(lambda batches: _batches(rows(batches), schema, lambda r: len(r["value"])), "value string")


def write_warc(pages: DataFrame, path: str, chunk: int = CHUNK_BYTES, min_revisit_bytes: int = 0) -> None:
    """Archive files of pages (page_id, url, payload) under path.

    Records whose payload another row has too, or that have several chunks, learn of it through a join; the others,
    which a bitmap of fixed size tells, go straight from the chunk table to the files.
    """
    scratch = Scratch(pages.sparkSession, "warc-parts")
    table = scratch.keep(parts(pages, chunk))
    whole = table.where("last").select("record", "page_id", "chunk", F.col("size").alias("total"), F.col("digest").alias("whole"))
    same = whole.where((F.col("total") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("whole", "total")
    same = same.agg(F.min(F.struct("page_id", "record")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    refers = whole.join(same, ["whole", "total"]).where("page_id > first.page_id").select("record", F.col("first.record").alias("refers_to"))
    special = whole.join(refers, "record", "left").where("chunk > 0 or refers_to is not null").select("record", "total", "whole", "refers_to")
    special = scratch.keep(special)
    bits = Bits(special.select(F.xxhash64("record").alias("h")))

    def straight(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[bits.passing(b.column("h").to_numpy())] = False
            yield b.filter(pa.array(keep)).select(fields)

    def others(batches):
        for b in batches:
            yield b.take(pa.array(bits.passing(b.column("h").to_numpy()))).select(fields)

    fields = [x.split()[0] for x in PARTS.split(", ")]
    hashed = table.withColumn("h", F.xxhash64("record"))
    alone = hashed.mapInArrow(straight, PARTS).select("*", F.lit(None).cast("string").alias("refers_to"), F.col("size").alias("total"), F.col("digest").alias("whole"))
    joined = hashed.mapInArrow(others, PARTS).join(special, "record", "left").where("refers_to is null or chunk = 0")
    joined = joined.select(*fields, "refers_to", F.coalesce("total", "size").alias("total"), F.coalesce("whole", "digest").alias("whole"))
    segments(alone.unionByName(joined)).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    scratch.clear()


READ = "record string, chunk int, parts int, page_id long, record_type string, refers_to string, payload_bytes long, payload_digest string, so_far string, data binary"


def read_warc(spark, path: str) -> DataFrame:
    """Chunk table READ of the response, revisit and continuation records of archives.

    refers_to is a record id; data is the segment's payload without HTTP headers. Page ids are those that write_warc put
    in, null in other archives. Blocks are put together within a file, so a mark in a payload cuts nothing.
    """
    raw = spark.read.option("lineSep", MARK).text(path)
    schema = _typed(READ)
    plain = lambda x: x.strip().strip("<>")

    def row(head: dict[str, str], block: bytes) -> dict | None:
        kind, n = head.get("warc-type", ""), int(head.get("warc-segment-number", 1)) - 1
        if kind not in ("response", "revisit", "continuation"):
            return None
        page, size = head.get("x-page-id"), head.get("x-payload-length")
        digest, so_far = head.get("warc-payload-digest", ""), head.get("x-payload-digest-so-far")
        http = n == 0 and head.get("content-type", "").startswith("application/http")
        return {
            "record": plain(head.get("warc-segment-origin-id") or head.get("warc-record-id", "")), "chunk": n,
            "parts": 1 if "warc-segment-number" not in head else n + 1 if "warc-segment-total-length" in head else None,
            "page_id": int(page) if page else None, "record_type": kind if n == 0 else None, "refers_to": plain(head["warc-refers-to"]) if "warc-refers-to" in head else None,
            "payload_bytes": int(size) if size else None, "payload_digest": digest.rpartition(":")[2] or None if n == 0 else None,
            "so_far": so_far.rpartition(":")[2] if so_far else None, "data": block.partition(b"\r\n\r\n")[2] if http else block,
        }

    def rows(batches):
        mark, held = MARK.encode(), None
        for b in batches:
            col = b.column(0).cast(pa.binary())
            for i in range(b.num_rows):
                piece = col[i].as_py() or b""
                # what follows a mark inside a block or a header belongs to it
                held = piece if held is None else held + mark + piece
                top, found, block = held.partition(b"\r\n\r\n")
                if not found or not re.match(rb"\d\r\n", top):
                    held = held if re.match(rb"\d\r\n", held) else None
                    continue
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("utf-8", "replace").split("\r\n")[1:])}
                need = int(head.get("content-length", 0))
                if len(block) < need:
                    continue
                held = None
                if (r := row(head, block[:need])) is not None:
                    yield r

    return raw.mapInArrow(lambda batches: _batches(rows(batches), schema, lambda r: len(r["data"])), READ)


OUT = "record string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to string"


def verify(chunks: DataFrame) -> DataFrame:
    """OUT of each record; sizes and digests of responses are computed from what was read. Records of one chunk are finished
    where they are; others are joined up in chunk order, with a running digest that must equal the one in each row."""
    schema = _typed(OUT)
    names = schema.names

    def single(batches):
        for b in batches:
            out = {c: b.column(c).to_pylist() for c in names}
            data = b.column("data")
            for i, kind in enumerate(out["record_type"]):
                if kind == "response":
                    view = memoryview(data[i].as_buffer())
                    out["payload_bytes"][i], out["payload_digest"][i] = len(view), base32(hashlib.sha1(view).digest())
            yield pa.RecordBatch.from_pydict(out, schema)

    def several(batches):
        def rows():
            held, h, size, nth = None, hashlib.sha1(), 0, 0
            for b in batches:
                for i in range(b.num_rows):
                    r = {c: b.column(c)[i].as_py() for c in (*names, "chunk", "parts", "so_far")}
                    if held is None or held["record"] != r["record"]:
                        held, h, size, nth = r, hashlib.sha1(), 0, 0
                    view = memoryview(b.column("data")[i].as_buffer())
                    h.update(view)
                    size += len(view)
                    if r["chunk"] != nth or (r["so_far"] and r["so_far"] != base32(h.digest())):
                        raise ValueError(f"segment {nth + 1} of record {r['record']} is missing or damaged")
                    nth += 1
                    if r["parts"] == nth:
                        yield {c: held[c] for c in names} | {"payload_bytes": size, "payload_digest": base32(h.digest())}

        return _batches(rows(), schema, lambda r: 100)

    alone = chunks.where("parts = 1 and chunk = 0").mapInArrow(single, OUT)
    more = chunks.where("parts is null or parts > 1").repartition("record").sortWithinPartitions("record", "chunk")
    return alone.unionByName(more.mapInArrow(several, OUT))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, chunk: int = CHUNK_BYTES, path: str | None = None) -> DataFrame:
    """Write pages as archives (under path, or the shared folder) and read them back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to) of each page, refers_to being the page of the response."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = path or f"{scratch.root}/archive"
    write_warc(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")), path, chunk, min_revisit_bytes)
    found = scratch.keep(verify(read_warc(spark, path)))
    # only records that are referred to, and those that refer, meet; responses pass by
    names = found.select(F.col("record").alias("refers_to"), F.col("page_id").alias("refers_page")).join(found.where("refers_to is not null").select("refers_to").distinct(), "refers_to", "left_semi")
    own = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    again = found.where("refers_to is not null").join(names, "refers_to", "left").select(*own, F.col("refers_page").alias("refers_to"))
    return found.where("refers_to is null").select(*own, F.lit(None).cast("long").alias("refers_to")).unionByName(again)

"""WARC archives: a writer of gzip members and a splittable reader.

The reader's tasks scan byte ranges for the gzip magic, validate each candidate by decoding the
member's header, and own the records that start inside their range, decoding past its end where the
last one needs it. Members of our writer state their own offset, so that an archive nested in a
payload cannot pass for one. Other writers' members don't; there a member found inside a range counts
only if one follows another up to the range's end, or to what looks like a member and is broken. An
archive nested whole in a range breaks off before; one that covers a range whole is taken for records.

Records of any kind are read: only those of HTTP messages have a payload apart from their block. A
stated payload digest is given as lower-case hex, also where it is written in base 32; where none is
stated, it is computed. A record shorter than it states, or longer than MAX_RECORD, gives a row that names
the problem; members that can't be decoded are no records.

Of records with equal payloads of at least min_bytes bytes, that with the largest page_id becomes a
response and the others become revisits of it, stored without payload.

Defined cases. A null payload is empty; a null URL is left out. Rows with equal payload and the
largest page_id are all responses (repeated rows); a null page_id counts as smaller than any other,
and if all are null, all are responses. Line breaks and controls in a URL are percent-encoded. An
empty table gives archives without records, and an empty result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, map_arrow, partitions, small_batches

MIN_REVISIT_BYTES = 1000
#: Bytes of an archive that one reading task owns, and bytes read at a time.
RANGE_BYTES, READ_BYTES = 8 << 20, 1 << 20
#: Bytes that one task reads, at least; and those of a record's text beyond which it isn't held.
TASK_BYTES, MAX_RECORD = 64 << 20, 1 << 30
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, offset: int) -> bytes:
    """One gzip member: a response, or a revisit of record refers_to (its payload isn't stored)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"Member-Offset: {offset}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """A record's fields, its headers in lower case, and its payload: that of the HTTP message, or the block. What is wrong is in `problem`."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    told = fields.get("content-length", "")
    size = int(told) if told.isdecimal() else len(rest)
    fields["problem"] = None if told.isdecimal() and len(rest) >= size else "shorter than stated" if told.isdecimal() else "no length"
    block = rest[:size]
    if fields.get("content-type", "").lower().startswith("application/http"):
        fields["http"], _, fields["payload"] = block.partition(b"\r\n\r\n")
    else:
        fields["http"], fields["payload"] = b"", block
    return fields


def stated_digest(text: str | None) -> str | None:
    """A SHA-1 digest as lower-case hex, or None."""
    kind, _, value = (text or "").strip().rpartition(":")
    if kind.lower() not in ("sha1", ""):
        return None
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except binascii.Error:
            return None
    return value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else None


def _decoded(more, held_from, at: int) -> tuple[bytes | None, int, bool]:
    """(text, place after it, does it state its offset) of the member at a place; None for a text that isn't held. more(n): are there bytes up to n?"""
    z, out, size, to, told = zlib.decompressobj(31), [], 0, at, None
    while not z.eof:
        more(to + 1)
        part = held_from(to)
        if not part:
            raise EOFError("the member is cut short")
        to += len(part)
        while part and not z.eof:  # a step gives a bounded text, however well it was packed
            new = z.decompress(part, READ_BYTES)
            part = z.unconsumed_tail
            size += len(new)
            if size <= MAX_RECORD:
                out.append(new)
            elif told is not None:
                out = out[:1]
            if told is None and (size >= 8192 or z.eof or b"\r\n\r\n" in new[:8192]) or size >= 7 and len(out) == 1:
                head = b"".join(out)[:8192]
                if not head.startswith(b"WARC/1."):
                    raise ValueError("not a record")
                offset = re.search(rb"\r\nMember-Offset: (\d+)", head.partition(b"\r\n\r\n")[0])
                if offset and int(offset[1]) != at:
                    raise ValueError("not a member of this archive")
                told = bool(offset)
        to -= len(z.unused_data)
    if not size:
        raise ValueError("an empty member")
    return (b"".join(out) if size <= MAX_RECORD else None), to, bool(told)


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(offset, text) of the members of an archive that start in [start, end); no text where it is longer than MAX_RECORD."""
    base, held = start, b""

    def more(to: int) -> None:
        """Read until held reaches offset to, or the file ends."""
        nonlocal held
        while base + len(held) < min(to, size):
            got = file.read_at(min(max(READ_BYTES, to - base - len(held)), size - base - len(held)), base + len(held))
            if not got:
                break
            held += got

    def held_from(at: int) -> bytes:
        return held[at - base : at - base + READ_BYTES]

    at, sure = start, start == 0
    chain: list[tuple[int, bytes | None]] = []  # found, but not sure yet
    after = -1  # the place after the member before
    while at < end:
        held, base = held[at - base :], at
        more(at + READ_BYTES)
        if chain and not held.startswith(MAGIC):
            chain = []  # they were part of something else
        found = held.find(MAGIC)
        if found < 0:
            if base + len(held) >= size:
                break
            at = base + max(1, len(held) - len(MAGIC) + 1)
            continue
        at = base + found
        if at >= end:
            break
        if at != after:
            sure = sure and after < 0 and at == start
        try:
            text, to, told = _decoded(more, held_from, at)
        except (zlib.error, ValueError, EOFError):
            yield from chain  # what follows them looks like a member
            chain, sure, after = [], False, -2
            at += 1
            continue
        sure = sure or told
        chain.append((at, text))
        if sure:
            yield from chain
            chain = []
        at = after = to
    if chain:
        held, base = held[at - base :] if at >= base else b"", max(at, base)
        more(at + len(MAGIC))
        if at >= size or held.startswith(MAGIC):
            yield from chain


def _write(folder: str):
    """Write each partition's records to one archive: under another name first, so that a lost task leaves none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        offset = n = 0
        with files.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    data = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["size"], row["digest"], row["refers_to"], offset)
                    out.write(data)
                    offset += len(data)
                    n += 1
        files.move(part, f"{path}/{name}")
        yield {"name": [name], "bytes": [offset], "records": [n]}

    return run


def write_warc(pages: DataFrame, scratch: Scratch, name: str = "warc", min_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write the archives, and return their folder."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html")), "size": F.octet_length("html").cast("long")})
    same = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null")
    same = scratch.table(same.select(F.col("digest").alias("d"), "top"), f"{name}_same")  # both sides of the join are read anew, so that a payload of many rows can be split
    refers = F.when(F.col("page_id").eqNullSafe(F.col("top")), F.lit(None)).otherwise(F.col("top")).alias("refers_to")
    rows = rows.join(same, F.col("digest") == F.col("d"), "left").select("page_id", "url", "html", "digest", "size", refers)
    folder = f"{scratch.path}/{name}"
    context = pages.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(path)  # an empty table writes no archive
    scratch.table(map_arrow(rows, _write(folder), "name string, bytes long, records long"), f"{name}_written")
    return folder


def _row(path: str, offset: int, data: bytes | None) -> dict:
    def number(urn: str | None) -> int | None:
        found = re.search(r"urn:page:(-?\d+)", urn or "")
        return int(found[1]) if found and len(found[1]) < 19 else None

    x = parse(data) if data is not None else {"problem": "too long", "http": b"", "payload": None}
    size = re.search(rb"(?i)\r\ncontent-length: *(\d{1,18})\b", x["http"])
    revisit = x.get("warc-type") == "revisit"
    payload = None if revisit else x["payload"]
    told = stated_digest(x.get("warc-payload-digest")) or (hashlib.sha1(payload).hexdigest() if payload is not None else None)  # noqa: S324 - the format's own
    n = int(size[1]) if size and revisit else None if x["payload"] is None else len(x["payload"])
    return {"path": path, "offset": offset, "record_id": x.get("warc-record-id"), "page_id": number(x.get("warc-record-id")), "url": x.get("warc-target-uri"), "record_type": x.get("warc-type"), "payload_digest": told, "refers_to": number(x.get("warc-refers-to")), "payload_bytes": n, "payload": payload, "problem": x["problem"]}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in batch.to_pylist():
            files, path = pafs.FileSystem.from_uri(row["path"])
            out, held = [], 0
            with files.open_input_file(path) as file:
                for offset, data in members(file, row["size"], row["start"], row["end"]):
                    out.append(_row(row["path"], offset, data))
                    held += len(data or b"")
                    if held >= 8 << 20:
                        yield {k: [r[k] for r in out] for k in out[0]}
                        out, held = [], 0
            if out:
                yield {k: [r[k] for r in out] for k in out[0]}


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per record: path, offset, record_id, page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload, problem."""
    small_batches(spark)
    # Spark lists the folder, and ranges are made by tasks
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("length").alias("size")).filter("size > 0")
    found = files.agg(F.sum("size").alias("bytes"), F.sum(F.ceil(F.col("size") / range_bytes)).alias("ranges")).first()
    tasks = max(1, min(found.ranges or 0, max(4 * partitions(spark), (found.bytes or 0) // TASK_BYTES)))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    table = files.select("path", "size", start).withColumn("end", F.least(F.col("start") + range_bytes, F.col("size"))).repartition(int(tasks))
    return map_arrow(table, _read, "path string, offset long, record_id string, page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary, problem string")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    back = read_warc(spark, write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch))
    # responses are digested anew from the payload that was read; a revisit states the digest of its response
    digest = F.when(F.col("payload").isNull(), F.col("payload_digest")).otherwise(F.sha1("payload"))
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to
FROM t
"""

"""WARC archives: written by tasks, read back from verified record boundaries only.

A record boundary looks the same inside a page that quotes an archive, so a reader that starts in the
middle of a file cannot trust the magic it finds. Tasks therefore emit, for every place where a record
could begin, where its successor would; pointer jumping from offset 0 keeps what a sequential reader
would have reached, and only that is read.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import files
from starloom.plans.durable import durable, new_path

MAGIC = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Most groups of equal payloads whose first page is broadcast (about 100 bytes each); beyond it a shuffled join.
BROADCAST_GROUPS = 100_000
#: Bytes read at a time to get at a header; longer headers are read on.
HEADER = 1 << 16
#: Chunks that one task reads.
CHUNKS_A_TASK = 8


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html plus payload_digest, payload_bytes, record_type and refers_to.

    Of equal payloads of at least 100 bytes, the smallest page_id is the response that the others refer
    to. Only groups of two or more are joined back, and each is one row however many pages it has.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    firsts = durable(pages.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first"), "firsts")
    side = F.broadcast(firsts) if firsts.count() <= BROADCAST_GROUPS else firsts
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    marked = pages.join(side, "payload_digest", "left")
    return marked.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, n_bytes: int, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has headers alone."""
    name = lambda i, d: uuid.uuid5(uuid.NAMESPACE_URL, f"{i}/{d}").urn
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name(page_id, digest)}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    block = HTTP + payload
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{name(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = HTTP
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_header(raw, at: int):
    """(headers, where the block begins, where the successor begins) of the record at ``at``; None if there is none."""
    end = raw.find(b"\r\n\r\n", at)
    if raw[at : at + len(MAGIC)] != MAGIC or end < 0:
        return None
    fields = {}
    for line in bytes(raw[at + len(MAGIC) : end]).split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip()
    length = fields.get("content-length", b"")
    if not length.isdigit():
        return None
    return fields, end + 4, end + 4 + int(length) + 4


def _unfinished(raw: bytes, at: int) -> bool:
    """Whether a header may begin at ``at`` that the bytes at hand do not end: the magic and nothing but ``key: value`` lines."""
    if raw.find(b"\r\n\r\n", at) >= 0:
        return False
    head, *lines = raw[at:].split(b"\r\n")
    return MAGIC.startswith(head + b"\r\n"[: len(MAGIC) - len(head)]) and all(b":" in line for line in lines[:-1])


def _read_on(f, raw: bytes, lo: int, at: int, size: int) -> bytes:
    """The bytes from ``lo``, read on until the header at ``at`` is whole; a longer piece each time."""
    while _unfinished(raw, at) and lo + len(raw) < size:
        raw += f.read_at(min(max(HEADER, len(raw) - at), size - lo - len(raw)), lo + len(raw))
    return raw


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write marked pages as WARC files, one per task that has rows: (path, n_bytes, n_records)."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def write(batches):
        from pyspark import TaskContext

        uri, out, n_bytes, n = None, None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    uri, out = files.create(folder, f"part-{TaskContext.get().partitionId():06d}", ".warc")
                raw = record(r["page_id"], r["url"], r["html"].encode(), r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"])
                out.write(raw)
                n_bytes, n = n_bytes + len(raw), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": uri, "n_bytes": n_bytes, "n_records": n}])

    # Kept as a table: a second run of the tasks would write other files.
    return durable(pages.mapInArrow(write, "path string, n_bytes long, n_records long"), "warc-files")


def _candidates(batches):
    """Every place of a chunk where a record could begin: its successor, and where and after how many records its chain leaves the chunk."""
    for batch in batches:
        for path, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            with files.open_random(path) as f:
                size = f.size()
                raw = f.read_at(max(0, min(hi + HEADER, size) - lo), lo)
                found, at = {}, raw.find(MAGIC)
                while 0 <= at < hi - lo:
                    raw = _read_on(f, raw, lo, at, size)
                    if parsed := parse_header(raw, at):
                        found[lo + at] = lo + parsed[2]
                    at = raw.find(MAGIC, at + 1)
            leaves: dict[int, tuple[int, int]] = {}
            for offset in sorted(found, reverse=True):
                target, n = leaves.get(found[offset], (found[offset], 0))
                leaves[offset] = target, n + 1
            rows = [{"path": path, "offset": o, "leaves": leaves[o][0], "records": leaves[o][1]} for o in found]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)


def _tasks(spark, warcs: DataFrame, chunk_bytes: int) -> int:
    """Tasks to read the archives with: by their bytes, not by the size of the pointers to them, which adaptive execution would go by."""
    chunks = warcs.agg(F.sum(F.ceil(F.col("n_bytes") / chunk_bytes))).first()[0] or 1
    return max(math.ceil(chunks / CHUNKS_A_TASK), min(chunks, spark.sparkContext.defaultParallelism))


def chunks(warcs: DataFrame, chunk_bytes: int, tasks: int) -> DataFrame:
    """(path, lo, hi) of every chunk, one small row each, dealt evenly."""
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long")))
    return warcs.where("n_bytes > 0").select("path", "n_bytes", lo.alias("lo")).select("path", "lo", F.least(F.col("lo") + chunk_bytes, F.col("n_bytes")).alias("hi")).repartition(tasks, "path", "lo")


def verified_entries(warcs: DataFrame, chunk_bytes: int, tasks: int) -> DataFrame:
    """(path, offset): the first true record of each chunk that has one, by pointer jumping from each file's start.

    Chains inside a chunk are followed by the task that scanned it, so the pointers to jump over are one
    or a few per chunk, and the rounds are the logarithm of the chunks of the longest file. A chain that comes to
    a place where no record begins and that is not its file's end, or that holds another number of records
    than the file was written with, is an error.
    """
    scanned = durable(chunks(warcs, chunk_bytes, tasks).mapInArrow(_candidates, "path string, offset long, leaves long, records long"), "candidates")
    entries = scanned.select("path", F.col("leaves").alias("offset")).union(warcs.where("n_bytes > 0").select("path", F.lit(0).cast("long"))).distinct()
    jumps = durable(entries.join(scanned, ["path", "offset"]).select("path", "offset", F.col("leaves").alias("target")).distinct(), "jumps")
    reached = warcs.where("n_bytes > 0").select("path", F.lit(0).cast("long").alias("offset"))
    longest = warcs.agg(F.max(F.ceil(F.col("n_bytes") / chunk_bytes))).first()[0] or 1
    for _ in range(max(1, math.ceil(math.log2(longest)) + 1)):
        hop = reached.join(jumps, ["path", "offset"]).select("path", F.col("target").alias("offset"))
        reached = durable(reached.union(hop).distinct(), "reached")
        further = jumps.select("path", F.col("offset").alias("target"), F.col("target").alias("next"))
        jumps = durable(jumps.join(further, ["path", "target"]).select("path", "offset", F.col("next").alias("target")), "jumps")
    lost = reached.join(scanned, ["path", "offset"], "left_anti").join(warcs.select("path", "n_bytes"), "path").where("offset <> n_bytes").first()
    if lost:
        raise ValueError(f"{lost.path}: the chain of records breaks at {lost.offset} of {lost.n_bytes}")
    true = durable(reached.join(scanned, ["path", "offset"]), "entries")
    if "n_records" in warcs.columns:
        n = true.groupBy("path").agg(F.sum("records").alias("read"))
        wrong = warcs.join(n, "path", "left").where(F.col("n_records") != F.coalesce("read", F.lit(0))).first()
        if wrong:
            raise ValueError(f"{wrong.path}: {wrong.read} records were reached, {wrong.n_records} were written")
    return true.select("path", "offset")


def read_records(f, path: str, at: int, hi: int, size: int) -> Iterator[dict]:
    """The records of an open archive that begin from ``at`` on and before ``hi``.

    That stretch is read at once and parsed in memory; what a record has beyond its end is read on for the last one only.
    """
    begin, held = at, f.read_at(min(hi, size) - at, at)
    while at < hi:
        raw = held[at - begin : at - begin + HEADER]
        if b"\r\n\r\n" not in raw:
            raw += f.read_at(min(HEADER, size - at - len(raw)), at + len(raw))
        raw = _read_on(f, raw, at, 0, size)
        parsed = parse_header(raw, 0)
        if parsed is None:
            raise ValueError(f"{path}: no record at {at}")
        head, body, after = parsed
        kind = head["warc-type"].decode()
        n, digest = int(head["x-payload-length"]), head["warc-payload-digest"].decode().partition(":")[2]
        if kind == "response":
            low, high = at - begin + body, at - begin + after - 4
            block = held[low:high] if high <= len(held) else held[low:] + f.read_at(high - max(low, len(held)), begin + max(low, len(held)))
            payload = block[block.find(b"\r\n\r\n") + 4 :]
            if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{path}: the payload at {at} differs from its digest")
        yield {"page_id": int(head["x-page-id"]) if "x-page-id" in head else None, "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": int(head["x-refers-to-page-id"]) if kind == "revisit" else None}
        at += after
        if at > size:
            raise ValueError(f"{path}: the last record is cut short")


def read_warc(warcs: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Read every verified record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    ``warcs`` is (path, n_bytes) and, where it is known, n_records. A response's length and digest are taken from
    its payload and held against its headers; a chain that ends anywhere but at the file's end is an error,
    so damaged or cut archives give no rows instead of fewer.
    """
    tasks = _tasks(warcs.sparkSession, warcs, chunk_bytes)

    def walk(batches):
        for batch in batches:
            for path, at, hi, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with files.open_random(path) as f:
                    rows = list(read_records(f, path, at, hi, size))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    entries = verified_entries(warcs, chunk_bytes, tasks).join(warcs, "path")
    hi = F.least((F.floor(F.col("offset") / chunk_bytes) + 1) * chunk_bytes, F.col("n_bytes"))
    return entries.select("path", "offset", hi.alias("hi"), "n_bytes").repartition(tasks, "path", "offset").mapInArrow(walk, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Write a record per page and read the archives back.

    Edge cases: null html is an empty payload; a null url has no target header, a very long one is whole; pages repeated under one
    page_id each have a record, all responses if their payload is the group's first; an empty table gives no
    file and no row; other columns are ignored.
    """
    return read_warc(write_warc(mark_revisits(pages)), chunk_bytes)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
 CASE WHEN f.first IS NOT NULL AND f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN f.first IS NOT NULL AND f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

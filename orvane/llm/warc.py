"""WARC archives with a two-level capture index.

Pages are range-partitioned by reversed-host URL key.  Each part writes one
archive (a gzip member for each record) and, in the same order, its capture
index: sorted lines in compressed blocks.  A sparse directory holds one row for
each block: its first key and where it lies.  A lookup binary-searches the
directory, range-reads one or a few blocks, binary-searches their lines, and
range-reads the records.

Of rows with equal payloads, those with the smallest page_id are responses and
the others revisits that refer to it.

Nulls and odd input: a null html is an empty payload; a null url has the empty
key and no target header; a null page_id comes after all others, and is a
response only if all of its group are null; repeated rows with the smallest
page_id are all responses; an empty table gives no archives and an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, file_system, lean_batches, new_folder, small_batches, sorted_by_range, table, written

#: Index lines in a block.
BLOCK_LINES = 512
DIRECTORY = "part int, block int, first_key string, last_key string, archive string, index string, start long, length long, n_lines int"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """``org,example,www)/path?query``: sorts by domain first.  Control signs and spaces become underscores."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "_")
    host = F.translate(F.regexp_extract(clean, r"^.*?://([^/?#]*)", 1), UPPER, LOWER)
    rest = F.regexp_extract(clean, r"^.*?://[^/?#]*(.*)$", 1)
    return F.when(clean.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(clean)


def url_key_of(url: str | None) -> str:
    """The same for one string."""
    clean = re.sub(r"[\x00-\x20\x7f]", "_", url or "")
    if "://" not in clean:
        return clean
    host, rest = re.match(r"([^/?#]*)(.*)$", clean.split("://", 1)[1], re.S).groups()
    return ",".join(reversed(host.translate(str.maketrans(UPPER, LOWER)).split("."))) + ")" + rest


def record_bytes(page_id, url, payload: bytes | None, n: int, digest: str, refers_to) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = uuid.UUID(bytes=hashlib.md5(f"{page_id} {url} {digest}".encode()).digest())
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2025-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~._-' + chr(39))}"]), f"WARC-Payload-Digest: sha1:{digest}", *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *([] if payload is not None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> dict:
    """Headers, payload and digests of one gzip member; a response's digest is computed anew and compared."""
    raw = gzip.decompress(data)
    head, rest = raw.split(b"\r\n\r\n", 1)
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), real) != (n, digest):
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page), "url": headers.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": digest,
        "record_type": headers["WARC-Type"], "refers_to": None if refers is None else int(refers), "payload": payload,
    }


def captures(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, key, digest, payload, refers_to, kind) for the writer.

    Kind 1 is a page; kind 0, of the same key, page_id and digest, tells that
    it is a revisit.  So payloads are shuffled once, to their place, and only
    digests are grouped and joined; that join may split a digest which most
    rows share.
    """
    rows = pages.select("page_id", "url", url_key(F.col("url")).alias("key"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    narrow = rows.select("page_id", "key", "digest")
    groups = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    again = narrow.join(groups, "digest").where(~F.col("refers_to").eqNullSafe(F.col("page_id"))).distinct()
    told = again.select("page_id", F.lit(None).cast("string").alias("url"), "key", "digest", F.lit(None).cast("binary").alias("payload"), "refers_to", F.lit(0).alias("kind"))
    return told.unionByName(rows.select("*", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind")))


def write_archives(pages: DataFrame, folder: str, per_part: int = 4096) -> DataFrame:
    """Write archives and index blocks of (page_id, url, html) to ``folder``; gives the block directory, already computed."""
    spark = pages.sparkSession
    small_batches(spark)
    parts = sorted_by_range(captures(pages), per_part, pages.count(), "key", "page_id", then=("digest", "kind"))

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        names = [f"{root}/part-{part:06d}.warc.gz", f"{root}/part-{part:06d}.cdx.gz"]
        drafts = [f"{root}/_draft-{uuid.uuid4().hex}" for _ in names]
        rows, lines, at, index_at, outs, revisit = [], [], 0, 0, None, None

        def flush():
            nonlocal lines, index_at
            block = gzip.compress("".join("\t".join(map(str, x)) + "\n" for x in lines).encode(), 6, mtime=0)
            outs[1].write(block)
            rows.append({"part": part, "block": len(rows), "first_key": lines[0][0], "last_key": lines[-1][0], "archive": names[0], "index": names[1], "start": index_at, "length": len(block), "n_lines": len(lines)})
            lines, index_at = [], index_at + len(block)

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    revisit = r
                    continue
                outs = outs or [fs.open_output_stream(d) for d in drafts]
                same = revisit and all(revisit[x] == r[x] for x in ("key", "page_id", "digest"))
                record = record_bytes(r["page_id"], r["url"], None if same else r["payload"], len(r["payload"]), base64.b32encode(bytes.fromhex(r["digest"])).decode(), revisit["refers_to"] if same else None)
                outs[0].write(record)
                lines.append((r["key"], at, len(record)))
                at += len(record)
                if len(lines) == BLOCK_LINES:
                    flush()
        if outs:
            if lines:
                flush()
            for out, draft, name in zip(outs, drafts, names, strict=True):
                out.close()
                fs.move(draft, name)  # complete files only; a repeated task writes the same again
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), *((x, pa.string()) for x in ("first_key", "last_key", "archive", "index")), ("start", pa.int64()), ("length", pa.int64()), ("n_lines", pa.int32())]))

    return written(parts.mapInArrow(lean_batches(write), DIRECTORY), "directory")


def _lines(fs, entry: dict) -> list[tuple[str, int, int]]:
    with fs.open_input_file(entry["index"]) as f:
        block = gzip.decompress(f.read_at(entry["length"], entry["start"]))
    return [(k, int(a), int(n)) for k, a, n in (x.split("\t") for x in block.decode().split("\n")[:-1])]


def read_archives(directory: DataFrame, folder: str) -> DataFrame:
    """Every record, by way of the index: a task takes blocks of the directory and range-reads their records."""
    blocks = directory.count()

    def read(batches):
        fs, _ = file_system(folder)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for entry in batch.to_pylist():
                with fs.open_input_file(entry["archive"]) as f:
                    rows = [parse_record(f.read_at(n, a)) for _, a, n in _lines(fs, entry)]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in kinds.names} for r in rows], schema=kinds)

    return directory.repartition(max(1, min(blocks, 2 * -(-blocks // 4))), "part", "block").mapInArrow(lean_batches(read), RECORD)


class CaptureIndex:
    """Lookups by URL on the driver.  The directory is sparse: one row for each block of lines."""

    def __init__(self, directory: DataFrame, folder: str, bound: int = 5_000_000):
        if directory.count() > bound:
            raise ValueError(f"the directory has more than {bound} blocks; filter it by part first")
        self.fs = file_system(folder)[0]
        self.entries = [r.asDict() for r in directory.orderBy("part", "block").collect()]
        self.last = [e["last_key"].encode() for e in self.entries]

    def find(self, url: str | None) -> list[dict]:
        key, found = url_key_of(url), []
        for entry in self.entries[bisect.bisect_left(self.last, key.encode()) :]:
            if entry["first_key"].encode() > key.encode():
                break
            lines = _lines(self.fs, entry)
            keys = [k.encode() for k, _, _ in lines]
            with self.fs.open_input_file(entry["archive"]) as f:
                for _, at, n in lines[bisect.bisect_left(keys, key.encode()) : bisect.bisect_right(keys, key.encode())]:
                    found.append(parse_record(f.read_at(n, at)))
        return found


def op4_warc(spark, sf_dir) -> DataFrame:
    """Archive all pages and read the archives back by their index."""
    folder = new_folder(spark, "warc")
    directory = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(directory, folder).drop("url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first_id FROM p GROUP BY x)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (x)
"""

"""WARC archives written and read as a table of chunks.

A payload crosses between Spark and Python as rows (record, chunk number, bytes) of at most
CHUNK_BYTES, so no task holds a whole oversized record outside of the row it came from. The writer
streams chunks into one gzip member per record; the reader inflates members piece by piece and gives
each chunk with the length and SHA-1 of the payload so far, so the last chunk carries those of the whole.

Among records of equal payload of at least `min_bytes`, the one with the largest id is the response and
the others are revisits of it. A task writes one archive under a name of its own; a task that runs again
writes another, and the manifest, cut from its lineage, names only archives of tasks that ended well.

Defined results: a null payload is empty; a null url leaves the header out; a null id is a response
that nothing refers to; rows that repeat the largest id are all responses; an id with several payloads has a record
for each, and each is typed by its own payload; an empty table gives an empty manifest and no records; columns other
than the three named ones are not read, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.llm.common import cut, new_shared_path, spread_join
from eventlode.llm.files import opened

CHUNK_BYTES = 1 << 18
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_SCHEMA = "page_id long, record_type string, refers_to long, chunk_no long, data binary, payload_offset long, bytes_so_far long, sha1_so_far string, declared_sha1 string, is_last boolean"


def revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, sha1, n_bytes, refers_to: the payloads of pages that a page of larger id has too. pages: page_id, sha1, n_bytes."""
    large = pages.filter((F.col("n_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    groups = large.groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return spread_join(large, groups, ["sha1", "n_bytes"], "n").filter("page_id < refers_to").distinct()


def _head(kind: str, page, url, digest: bytes, size: int, refers, date: str) -> bytes:
    at = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x-page:{'' if pd.isna(page) else int(page)}>", "WARC-Date": date}
    if isinstance(url, str) and url:
        at["WARC-Target-URI"] = "".join(ch for ch in url if ch >= " ")
    at["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(digest).decode()
    if kind == "revisit":
        at |= {"WARC-Refers-To": f"<urn:x-page:{int(refers)}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    at |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(size)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in at.items()).encode() + b"\r\n"


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        name, out, n, zipper = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0, None
        try:
            for batch in batches:
                for page, url, digest, size, refers, k, last, data in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                    if out is None:
                        files.create_dir(path, recursive=True)
                        out = files.open_output_stream(name)
                    if k == 0:
                        zipper = zlib.compressobj(1, zlib.DEFLATED, 31)
                        kind = "response" if refers is None else "revisit"
                        body = size if refers is None else 0
                        out.write(zipper.compress(_head(kind, page, url, bytes.fromhex(digest), len(HTTP_HEAD) + body, refers, date) + HTTP_HEAD))
                        n += 1
                    if data:
                        out.write(zipper.compress(data))
                    if last:
                        out.write(zipper.compress(b"\r\n\r\n") + zipper.flush())
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n]})

    return write


def write_warc(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 1000, chunk_bytes: int = CHUNK_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives and returns their manifest: path, n_records."""
    folder = folder or new_shared_path(pages.sparkSession, "warc")
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    known = rows.select("page_id", F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("n_bytes"))
    typed = rows.withColumns({"sha1": F.sha1("body"), "n_bytes": F.octet_length("body").cast("long")}).join(revisits(known, min_bytes), ["page_id", "sha1", "n_bytes"], "left")
    n = F.when(F.col("refers_to").isNull(), F.floor((F.col("n_bytes") - 1) / chunk_bytes)).otherwise(0).cast("int")
    # the chunks are cut in one pass and the body goes no further, so a payload is not copied once per chunk
    numbers = F.sequence(F.lit(0), F.greatest(n, F.lit(0)))
    slices = F.transform(numbers, lambda k: F.struct(k.alias("k"), F.when(F.col("refers_to").isNull(), F.substring("body", k * chunk_bytes + 1, F.lit(chunk_bytes))).alias("data")))
    chunks = typed.select("page_id", "url", "sha1", "n_bytes", "refers_to", F.greatest(n, F.lit(0)).alias("n"), F.explode(slices).alias("c")).select(
        "page_id", "url", "sha1", "n_bytes", "refers_to", F.col("c.k").alias("k"), (F.col("c.k") == F.col("n")).alias("last"), F.col("c.data").alias("data")
    )
    return cut(chunks.mapInArrow(_writer(folder, date), "path string, n_records long"))


class _Member:
    """One record's bytes, inflated piece by piece."""

    def __init__(self, stream, rest: bytes, piece: int):
        self.stream, self.piece, self.inflate, self.have, self.ended = stream, piece, zlib.decompressobj(31), b"", False
        self.rest = rest

    def more(self) -> bool:
        if self.ended:
            return False
        while not self.ended:
            raw = self.inflate.unconsumed_tail or self.rest or self.stream.read(self.piece)
            self.rest = b""
            got = self.inflate.decompress(raw, self.piece)
            if self.inflate.eof:
                self.ended, self.rest = True, self.inflate.unused_data
            elif not raw:
                raise ValueError("an archive ends within a record")
            if got:
                self.have += got
                return True
        return bool(self.have)

    def until(self, mark: bytes) -> bytes:
        while mark not in self.have:
            if not self.more():
                raise ValueError("a record has no end of header")
        head, self.have = self.have.split(mark, 1)
        return head

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out, self.have = self.have[:n], self.have[n:]
        if len(out) < n:
            raise ValueError("a record is shorter than it says")
        return out


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def records(stream, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> Iterator[tuple]:
    """The rows of RECORD_SCHEMA that an open archive holds."""
    rest = stream.read(chunk_bytes)
    while rest:
        member = _Member(stream, rest, chunk_bytes)
        at = dict(line.split(": ", 1) for line in member.until(b"\r\n\r\n").decode().split("\r\n")[1:])
        http = member.until(b"\r\n\r\n")
        left = int(at["Content-Length"]) - len(http) - 4
        sha1, so_far, k = hashlib.sha1(), 0, 0
        declared = base64.b32decode(at["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        while True:
            body = member.take(min(left, chunk_bytes))
            left -= len(body)
            sha1.update(body)
            so_far += len(body)
            yield (_page(at["WARC-Record-ID"]), at["WARC-Type"], _page(at.get("WARC-Refers-To")), k, body if data else None, so_far - len(body), so_far, sha1.hexdigest(), declared, left == 0)
            k += 1
            if not left:
                break
        member.take(4)
        while member.more():
            pass
        rest = member.rest or stream.read(chunk_bytes)


def _reader(chunk_bytes: int, data: bool, batch_bytes: int = 8 << 20):
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("payload_offset", pa.int64()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("declared_sha1", pa.string()), ("is_last", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = opened(path)
                held, size = [], 0
                with files.open_input_stream(at) as stream:
                    for row in records(stream, chunk_bytes, data):
                        held.append(row)
                        size += 200 + len(row[4] or b"")
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return read


def read_warc(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """One row per chunk; data=False leaves the bytes out, as digests and lengths are enough for many uses."""
    spark: SparkSession = manifest.sparkSession
    spread = max(spark.sparkContext.defaultParallelism, 1)
    return manifest.select("path").repartition(spread).mapInArrow(_reader(chunk_bytes, data), RECORD_SCHEMA)


def page_digests(chunks: DataFrame) -> DataFrame:
    """Per page, what the archives say: a revisit's length and digest are those of the response that it refers to."""
    last = cut(chunks.filter("is_last").select("page_id", "record_type", "refers_to", "bytes_so_far", "sha1_so_far", "declared_sha1"))
    own = last.filter("record_type <> 'revisit'").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to")
    revisit = last.filter("record_type = 'revisit'").select("page_id", "refers_to", F.col("declared_sha1").alias("payload_digest"))
    # what is referred to: a page and a digest, as one page id may have several payloads
    wanted = revisit.groupBy("refers_to", "payload_digest").agg(F.count(F.lit(1)).alias("n"))
    response = own.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    found = spread_join(revisit, wanted.join(response, ["refers_to", "payload_digest"]), ["refers_to", "payload_digest"], "n")
    return own.unionByName(found.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def oracle() -> str:
    return """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM g"""

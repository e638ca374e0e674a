"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing appends one gzip member per record and notes file, offset, length, URL and digest of each. Readers
select records in the index, sort them by file and offset, and fetch neighbours in one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import arrow_map, durable, join_group_facts, shared_dir, slices, small_or_shuffled, text_or_empty

#: Payloads of at least so many bytes are written once; their repeats become revisit records.
REVISIT_BYTES = 1000
#: Records at most GAP apart are fetched in one read of at most SPAN bytes, or of one record.
GAP, SPAN = 1 << 16, 8 << 20
#: About so many compressed bytes are read by one task.
READ_BYTES = 16 << 20
#: A task goes on to another archive when one has so many bytes.
ROLL = 1 << 30
INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def _record(row: dict, when: str) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http if revisit else http + row["html"].encode()
    uri = (row["url"] or "").split()
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['page_id'])}", f"WARC-Date: {when}",
        f"WARC-Target-URI: {uri[0] if uri else 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(row['refers_to'])}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rsplit(":", 1)[1]
    return None if name == "none" else int(name)


def parse(member: bytes) -> dict:
    """The headers and payload of one record; raises ValueError where lengths or digests don't fit."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"][5:]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length")))
    return {"fields": fields, "payload": payload, "size": size}


def classify(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Of payloads of at least REVISIT_BYTES that are equal, that of the largest page_id is the response. Rows
    repeated with that page_id are all responses. A null page_id comes before all others; where no page of the
    group has one, all are responses.
    """
    html = text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    # The groups are found from digests alone; the pages themselves only pass through.
    narrow = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "payload_digest")
    repeated = narrow.groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    revisits = join_group_facts(narrow, repeated, ["payload_digest"], "copies").where("page_id < first or (page_id is null and first is not null)").select("page_id", F.col("payload_digest").alias("digest_"), "first").distinct()
    revisits = small_or_shuffled(durable(revisits.withColumnRenamed("page_id", "page_")))
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("page_")) & (F.col("payload_digest") == F.col("digest_")), "left")
    return joined.select(*rows.columns, F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("first").alias("refers_to"))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes archives of classified records below folder and returns their index, itself written there.

    Each attempt of a task writes a file of its own name; the committed index names only files of attempts
    that succeeded, so a lost executor leaves at most an unused file.
    """
    when = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in slices(batches):
                found = []
                for row in batch.to_pylist():
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = _record(row, when)
                    out.write(member)
                    found.append((name, at, len(member)))
                    at += len(member)
                kept = {c: batch.column(c) for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                yield {**kept, **dict(zip(("file", "offset", "length"), map(list, zip(*found))))}
        finally:
            if out is not None:
                out.close()

    columns = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    index = arrow_map(records.select(*columns), write, INDEX)
    index.write.parquet(f"{folder}/index.parquet")
    return records.sparkSession.read.schema(INDEX).parquet(f"{folder}/index.parquet")


def read_warc(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that the rows of an index select: page_id, payload_bytes, payload_digest, record_type, refers_to[, payload].

    All values come from the archives. The digest of a response is computed from its payload and checked
    against the header; a revisit has no payload and bears the digest of the one that it refers to.
    """
    # Neighbours in a file go to one task, in the order of their offsets.
    stretch = F.floor(F.col("offset") / READ_BYTES).alias("stretch")
    picked = index.select("file", "offset", "length", stretch).repartition("file", "stretch").sortWithinPartitions("file", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def members(store, path: str, run: list[tuple[int, int]]) -> Iterator[bytes]:
        first, end = run[0][0], run[-1][0] + run[-1][1]
        with store.open_input_file(path) as f:
            data = f.read_at(end - first, first)
        for offset, length in run:
            yield data[offset - first : offset - first + length]

    def rows_of(store, path: str, run: list[tuple[int, int]]) -> Iterator[tuple]:
        for member in members(store, path, run):
            found = parse(member)
            fields, kind = found["fields"], found["fields"]["WARC-Type"]
            digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
            refers = None
            if kind == "revisit":
                refers = _page(fields["WARC-Refers-To"])
            elif hashlib.sha1(found["payload"]).hexdigest() != digest:
                raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
            row = (_page(fields["WARC-Record-ID"]), found["size"], digest, kind, refers)
            yield (*row, found["payload"]) if payloads else row

    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, root = fs.FileSystem.from_uri(folder)
        run: list[tuple[int, int]] = []
        last = ""

        def fetched() -> dict:
            rows = list(rows_of(store, f"{root}/{last}", run))
            return dict(zip(names, map(list, zip(*rows))))

        for batch in batches:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                near = run and name == last and offset - run[-1][0] - run[-1][1] <= GAP and offset + length - run[0][0] <= SPAN
                if run and not near:
                    yield fetched()
                    run = []
                run.append((offset, length))
                last = name
        if run:
            yield fetched()

    return arrow_map(picked, read, schema)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes one record per row of pages below folder (a fresh shared one if not given) and reads them all back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is the empty
    payload, null URLs are written as urn:none, a null page_id as none (see classify); repeated page_ids are
    records of their own. Other columns are ignored, an empty table gives an empty result.
    """
    folder = folder or shared_dir(pages.sparkSession)
    return read_warc(write_warc(classify(pages), folder), folder)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
    SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n >= 1000) ELSE page_id END AS first FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""

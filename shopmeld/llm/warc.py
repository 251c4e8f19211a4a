"""WARC archives: write records, index them first, then read selected records by coalesced byte ranges.

Records are gzip members of their own, so each can be read alone. A task writes one archive under a unique
name and returns an index row per record (offset, length, URL, digest); the index is a table that Spark
commits, so archives of lost or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, scratch, ship, stored, whole

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Byte ranges at most this far apart are read as one, up to a range of RANGE_BYTES.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
INDEX = "archive string, offset bigint, length bigint, page_id {id}, url string, payload_digest string, record_type string"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324 - the format's digest


def record_bytes(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head alone, whose Content-Length is the payload's.

    Line breaks and other controls in a URL are percent-encoded, and so is all but letters, digits and "_.-~" in
    an id; without a URL there is no target header, without an id no record id.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Date: {DATE}",
    ]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{quote(str(page_id), safe='')}>")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{quote(str(refers_to), safe='')}>"]
    block = http if revisit else http + payload
    head += [
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers of a record (lower-case names), its HTTP head's headers under "http", and its payload."""
    top, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    found = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(found["content-length"])]
    head, found["payload"] = block.split(b"\r\n\r\n", 1)
    found["http"] = {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])}
    return found


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            offsets, lengths, digests = [], [], []
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("_id", "_url", "_html", "_refers")), strict=True):
                payload = html.encode()
                data = gzip.compress(record_bytes(page_id, url, payload, refers), 5, mtime=0)
                out.write(data)
                offsets.append(at)
                lengths.append(len(data))
                digests.append(_digest(payload))
                at += len(data)
            kinds = ["response" if r is None else "revisit" for r in batch.column("_refers").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(offsets)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch.column("_id"), batch.column("_url")]
                + [pa.array(digests, pa.string()), pa.array(kinds, pa.string())],
                ["archive", "offset", "length", "page_id", "url", "payload_digest", "record_type"],
            )
        if out is not None:
            out.close()

    return write


def write_warc(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Writes a record per page below folder; returns the index.

    Pages of equal payloads (equal SHA-256 and length) revisit the one with the smallest id. Rows that
    repeat that id, and pages without any id to refer to, are responses. Null html is an empty payload.
    """
    ship(pages.sparkSession)
    html = whole(html_column)
    kind = pages.schema[id_column].dataType.simpleString()
    ids = F.col(f"`{id_column}`").alias("_id")
    rows = pages.select(ids, F.col(f"`{url_column}`").alias("_url"), html.alias("_html"), F.sha2(html, 256).alias("_sha"))
    # narrow: of each payload only its digest moves, folded before the shuffle
    shared = (
        pages.select(F.sha2(html, 256).alias("_sha"), ids)
        .groupBy("_sha")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    refers = F.when(F.col("_id").eqNullSafe(F.col("_first")), None).otherwise(F.col("_first"))
    marked = rows.join(shared, "_sha", "left").select("_id", "_url", "_html", refers.alias("_refers"))
    return stored(marked.mapInArrow(_writer(folder), INDEX.format(id=kind)), "warc-index", f"{folder}/index")


def byte_ranges(index: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """Sorted byte ranges that hold the index's records: archive, from, to, records (offset, length).

    Neighbours join while the gap between them is at most `gap`; a range is cut at each multiple of `most`
    bytes, so it is longer only for a single longer record. One archive is one task's output.
    """
    order = Window.partitionBy("archive").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    new = F.coalesce(
        (F.col("offset") - before > gap) | (F.floor(F.col("offset") / most) != F.floor(F.lag("offset").over(order) / most)),
        F.lit(True),
    )
    return (
        index.select("archive", "offset", "length", new.alias("_new"))
        .withColumn("_range", F.sum(F.col("_new").cast("int")).over(order))
        .groupBy("archive", "_range")
        .agg(
            F.min("offset").alias("_from"),
            F.max(F.col("offset") + F.col("length")).alias("_to"),
            F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("_records"),
        )
        .drop("_range")
    )


def _reader(folder: str, number: bool):
    def name(urn: str | None):
        if urn is None:
            return None
        found = unquote(urn[len("<urn:page:") : -1])
        return int(found) if number else found

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['archive']}") as archive:
                    data = archive.read_at(row["_to"] - row["_from"], row["_from"])
                out = []
                for r in row["_records"]:
                    at = r["offset"] - row["_from"]
                    found = parse_record(gzip.decompress(data[at : at + r["length"]]))
                    digest, payload = found["warc-payload-digest"].removeprefix("sha1:"), None
                    n = int(found["http"]["content-length"])
                    if found["warc-type"] == "response":
                        payload = found["payload"]
                        if len(payload) != n or _digest(payload) != digest:
                            raise ValueError(f"damaged record at {row['archive']}:{r['offset']}")
                    out.append((name(found.get("warc-record-id")), found.get("warc-target-uri"), n, digest, found["warc-type"], name(found.get("warc-refers-to")), payload))
                columns = list(zip(*out, strict=True))
                key = pa.int64() if number else pa.string()
                kinds = (key, pa.string(), pa.int64(), pa.string(), pa.string(), key, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                )

    return read


def read_warc(index: DataFrame, folder: str, selected: Column | None = None) -> DataFrame:
    """The selected records (all by default) as rows: page_id, target_uri, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for a revisit). `selected` is a condition on the index."""
    chosen = index if selected is None else index.where(selected)
    n_bytes = chosen.agg(F.sum("length")).first()[0] or 0
    kind = index.schema["page_id"].dataType.simpleString()
    number = kind in ("bigint", "int", "smallint", "tinyint")
    key = "bigint" if number else "string"
    rows = byte_ranges(chosen).repartition(partitions_for(index.sparkSession, n_bytes, RANGE_BYTES)).mapInArrow(
        _reader(folder, number),
        f"page_id {key}, target_uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to {key}, payload binary",
    )
    return rows.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def warc_round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """write_warc, then read_warc of every record, without the payloads. No rows give no archives and no rows."""
    folder = scratch(pages.sparkSession, "warc")
    index = write_warc(pages, folder, id_column, url_column, html_column)
    return read_warc(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Token-id files: each document compressed on its own with a shared dictionary, behind an offset index.

A shard holds documents of one id range in ascending order:

    magic, bytes per id, 0 | SHA-256 of the dictionary | one zstandard frame per document
    | index: offset (u64), ids (u32) per document | where the index starts (u64), documents (u64) | magic

Any document can be read through the index without the others. Shards get unique names and count only
when the manifest, a table that Spark commits, names them, so a lost or repeated task leaves no trace.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, ship, stored, whole
from .tokens import encoder

MAGIC = b"SMTOKENS"
HEAD, HEAD_BYTES = "<8sHH32s", 44
TAIL, TAIL_BYTES = "<QQ8s", 24
INDEX = np.dtype([("offset", "<u8"), ("ids", "<u4")])
#: The dictionary is fitted on at most this many documents, of which it sees at most this many ids each.
SAMPLE_DOCS = 2000
SAMPLE_IDS = 4096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for documents like the samples; where they are too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _train(tokenizer: str, end_id: int, kind: str):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for batch in batches:
            for _, _, ids, begin in encoder(tokenizer).encode_steps(batch.column("_text")):
                for a, b in zip(begin[:-1], begin[1:], strict=True):
                    samples.append(np.append(ids[a:b][:SAMPLE_IDS], end_id).astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([trained(samples)], pa.binary())], ["dictionary"])

    return train


def sample(docs: DataFrame) -> DataFrame:
    """Parts (_text) of at most SAMPLE_DOCS documents, at every size those of the smallest hashes, each from a
    hashed place of its text. Hashes alone are ranked; the texts are fetched by the last of them."""
    by = F.xxhash64("_id", "_text")
    last = docs.select(by.alias("_by")).orderBy("_by").limit(SAMPLE_DOCS).agg(F.max("_by")).first()[0]
    # as many characters as SAMPLE_IDS ids can come from
    at = F.pmod(F.xxhash64(by), F.greatest(F.length("_text") - SAMPLE_IDS, F.lit(0)) + 1).cast("int") + 1
    part = F.col("_text").substr(at, F.lit(SAMPLE_IDS))
    few = docs.where(by <= F.lit(last)) if last is not None else docs.limit(0)
    return few.select(by.alias("_by"), part.alias("_text")).dropDuplicates(["_by"]).select("_text")


def fit_dictionary(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> bytes:
    """The dictionary from a bounded sample (SAMPLE_DOCS); docs has _id and _text."""
    few = sample(docs).repartition(1)
    found = few.mapInArrow(_train(tokenizer, end_id, kind), "dictionary binary").first()
    return found[0] if found else b""


def _writer(folder: str, tokenizer: str, end_id: int, kind: str, dictionary: bytes):
    digest = hashlib.sha256(dictionary).digest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tokens"
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        index, doc_ids, total, out = [], [], 0, None
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(struct.pack(HEAD, MAGIC, np.dtype(kind).itemsize, 0, digest))
                at = HEAD_BYTES
            doc_ids.append(batch.column("_id"))
            for _, _, ids, begin in encoder(tokenizer).encode_steps(batch.column("_text")):
                for a, b in zip(begin[:-1], begin[1:], strict=True):
                    frame = press.compress(np.append(ids[a:b], end_id).astype(kind).tobytes())
                    index.append((at, b - a + 1))
                    total += int(b - a) + 1
                    out.write(frame)
                    at += len(frame)
        if out is None:
            return
        out.write(np.array(index, INDEX).tobytes())
        out.write(struct.pack(TAIL, at, len(index), MAGIC))
        out.close()
        keys = pa.concat_arrays(doc_ids)
        keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([name]), pa.array([total], pa.int64()), keys],
            ["shard", "name", "ids", "doc_ids"],
        )

    return write


class Shard:
    """One shard opened for reading."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        magic, width, _, digest = struct.unpack(HEAD, self.file.read_at(HEAD_BYTES, 0))
        start, n, tail = struct.unpack(TAIL, self.file.read_at(TAIL_BYTES, size - TAIL_BYTES))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{path} is no whole token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.kind = f"<u{width}"
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, start), INDEX)
        self.ends = np.append(self.index["offset"], np.uint64(start)).astype(np.int64)
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, by one ranged read."""
        frame = self.file.read_at(int(self.ends[i + 1] - self.ends[i]), int(self.ends[i]))
        return np.frombuffer(self.expand.decompress(frame), self.kind)


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 0,
    wide: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, bytes]:
    """Writes the shards below folder; returns their manifest (shard, name, ids, doc_ids) and the dictionary.

    wide: four bytes per id, for vocabularies beyond 65,536.
    """
    ship(docs.sparkSession)
    kind = "<u4" if wide else "<u2"
    rows = docs.select(F.col(id_column).alias("_id"), whole(text_column).alias("_text"))
    dictionary = fit_dictionary(rows, tokenizer, end_id, kind)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary.zstd") as out:
        out.write(dictionary)
    key = rows.schema[0].dataType.simpleString()
    manifest = (
        rows.repartitionByRange(F.col("_id").asc_nulls_first())
        .sortWithinPartitions(F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
        .mapInArrow(
            _writer(folder, tokenizer, end_id, kind, dictionary),
            f"shard bigint, name string, ids bigint, doc_ids array<{key}>",
        )
    )
    return stored(manifest, "token-manifest", f"{folder}/manifest"), dictionary


def _reader(folder: str, dictionary: bytes):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(f"{folder}/{batch.column('name')[i].as_py()}", dictionary)
                keys = batch.column("doc_ids")[i].values
                n, crc = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
                for k in range(len(shard)):
                    ids = shard.document(k)
                    n[k], crc[k] = len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                start = batch.column("_before")[i].as_py() + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(start), pa.array(n), pa.array(crc)], ["_id", "start", "n_tokens", "ids_crc32"]
                )

    return read


def read_tokens(manifest: DataFrame, folder: str, dictionary: bytes, id_column: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = manifest.withColumn("_before", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))
    key = manifest.schema["doc_ids"].dataType.elementType.simpleString()
    rows = shards.repartition(max(1, manifest.count())).mapInArrow(
        _reader(folder, dictionary), f"_id {key}, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows.withColumnRenamed("_id", id_column)


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """write_tokens, then read_tokens.

    Null and empty texts are the end id alone. Null ids come first; rows that repeat an id are documents
    of their own in the order of their texts' hashes. No rows give no shards and no rows.
    """
    folder = scratch(docs.sparkSession, "tokens")
    manifest, dictionary = write_tokens(docs, folder, tokenizer, end_id, id_column=id_column, text_column=text_column)
    return read_tokens(manifest, folder, dictionary, id_column)

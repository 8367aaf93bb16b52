"""Token ids in length-delimited binary files with masked checksums and a separate offset index.

A record is

    8 bytes  payload length                     little-endian, unsigned
    4 bytes  masked checksum of those 8 bytes
    payload  8 bytes document id (signed; the smallest number stands for null), then ids of ``width`` bytes
    4 bytes  masked checksum of the payload

The checksum is CRC-32, masked by a rotation by 15 bits plus a constant, so that the checksum of a payload which
itself holds checksums stays sound. Files hold nothing else and end at ``file_bytes``, a single longer record
excepted. The index is a Parquet table with one row per record: file, offset, size, document, number of ids.
With it a reader fetches any records in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from hazardflow.llm.encoding import encoder, text_runs, vocabulary
from hazardflow.session import shared_dir

# Fixed values of the format.
MASK_DELTA = 0xA282EAD8
NULL_ID = -(2**63)
HEAD = struct.Struct("<QI")
FOOT = struct.Struct("<I")

FILE_BYTES = 64 << 20
SHARD_ROWS = 20_000
INDEX = "doc_id long, shard int, file string, offset long, size long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + FOOT.pack(masked(length)) + payload + FOOT.pack(masked(payload))


def unframe(data, offset: int = 0) -> tuple[bytes, int]:
    """The payload of the record at ``offset`` and the offset after it; a damaged record is an error."""
    length, check = HEAD.unpack_from(data, offset)
    if masked(bytes(data[offset : offset + 8])) != check:
        raise ValueError(f"damaged record length at offset {offset}")
    begin = offset + HEAD.size
    payload = bytes(data[begin : begin + length])
    if len(payload) < length or masked(payload) != FOOT.unpack_from(data, begin + length)[0]:
        raise ValueError(f"damaged record at offset {offset}")
    return payload, begin + length + FOOT.size


def id_width(vocab_size: int) -> int:
    return 2 if vocab_size <= 1 << 16 else 4


class _Files:
    """Writes the records of one shard into files; a finished file gets its final name in one step."""

    def __init__(self, folder: str, shard: int, file_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.shard, self.file_bytes, self.number, self.size, self.out = shard, file_bytes, 0, 0, None

    def add(self, record: bytes) -> tuple[str, int]:
        if self.out is not None and self.size + len(record) > self.file_bytes:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:04d}.rec"
            self.temporary = f"{self.root}/_{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(self.temporary)
        at = self.size
        self.out.write(record)
        self.size += len(record)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")  # a repeated task writes the same bytes
            self.out, self.size, self.number = None, 0, self.number + 1


def write_records(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.json",
    end_id: int = 0, vocab_size: int = 50_257, shard_rows: int = SHARD_ROWS, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode whole texts, append ``end_id``, write the files in ascending id order; returns the index.

    Files and index lie in ``folder``, which all executors reach. Null texts count as empty; null ids come first;
    rows with equal ids are ordered by text. An empty table writes an empty index.
    """
    spark, path, width = docs.sparkSession, vocabulary(vocab), id_width(vocab_size)
    end = np.array([end_id], dtype="<u4").tobytes()
    files = f"{folder}/records"
    fs, root = pafs.FileSystem.from_uri(files)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard = encoder(path).encode, TaskContext.get().partitionId()
        out = _Files(files, shard, file_bytes)
        for ids, texts in text_runs(batches):
            rows = []
            for doc, tokens in zip(ids, encode(texts)):
                values = np.frombuffer(tokens + end, dtype="<u4")
                payload = struct.pack("<q", NULL_ID if doc is None else doc) + values.astype(f"<u{width}").tobytes()
                record = frame(payload)
                rows.append((doc, shard, *out.add(record), len(record), len(values)))
            types = (pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                ["doc_id", "shard", "file", "offset", "size", "n_tokens"],
            )
        out.close()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = max(1, -(-chosen.count() // shard_rows))
    ordered = chosen.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


READ = "doc_id long, file string, offset long, n_tokens long, ids_crc32 long"


def read_records(spark: SparkSession, folder: str, width: int = 2, with_ids: bool = False) -> DataFrame:
    """Every record of the files, each checked: document, place, number of ids and the CRC-32 of its 32-bit ids.

    One file is read by one task and files are of bounded size. ``with_ids`` adds the ids themselves.
    """
    files = f"{folder}/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(files)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                data = memoryview(fs.open_input_stream(f"{root}/{name}").read())
                offset, rows = 0, []
                while offset < len(data):
                    payload, after = unframe(data, offset)
                    doc = struct.unpack_from("<q", payload)[0]
                    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=8).astype("<u4")
                    row = (None if doc == NULL_ID else doc, name, offset, len(ids), zlib.crc32(ids.tobytes()))
                    rows.append((*row, ids) if with_ids else row)
                    offset = after
                types = (pa.int64(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()))
                names = ["doc_id", "file", "offset", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names[: 5 + with_ids]
                )

    names = read_index(spark, folder).select("file").distinct()
    return names.mapInArrow(run, READ + (", ids array<long>" if with_ids else ""))


def read_shuffled(index: DataFrame, folder: str, seed: int, width: int = 2, partitions: int | None = None) -> DataFrame:
    """The records in a random order fixed by ``seed``, fetched one by one through the index."""
    files = f"{folder}/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(files)
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            docs, ids = [], []
            for name, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size"))):
                if name not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[name] = fs.open_input_file(f"{root}/{name}")
                payload, _ = unframe(opened[name].read_at(size, offset))
                doc = struct.unpack_from("<q", payload)[0]
                docs.append(None if doc == NULL_ID else doc)
                ids.append(np.frombuffer(payload, dtype=f"<u{width}", offset=8).astype("<i8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"]
            )

    order = F.xxhash64(F.lit(seed), "file", "offset")
    n = partitions or max(1, index.rdd.getNumPartitions())
    return index.repartitionByRange(n, order).sortWithinPartitions(order).mapInArrow(run, "doc_id long, ids array<long>")


def token_starts(index: DataFrame, records: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids of all records before each one in file order.

    Totals per file come first (one row per file), then running sums inside each file.
    """
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("_total"))
    bases = totals.select("file", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy("file").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    started = records.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return started.join(bases, "file").withColumn("start", F.col("_base") + F.col("_within")).drop("_base", "_within")


def new_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "records")

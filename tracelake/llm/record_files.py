"""Token ids as length-delimited binary records in shard files, with a separate offset index.

One record a document, in ascending doc_id order over all shards (the part number in a shard's name gives the order):

    length of the payload   unsigned 64-bit
    masked checksum of the 8 length bytes   unsigned 32-bit
    payload: doc_id (signed 64-bit; 0 if null), flags (1: doc_id is null; 2: ids are 16-bit), ids
    masked checksum of the payload   unsigned 32-bit
    newline

All numbers are little-endian. A checksum is zlib's CRC-32, masked by a rotation and a constant so that checksums of data
that hold checksums stay sound. Shards are written by Spark's own text writer and read by its binaryFile reader, so any
store that Spark reaches will do, and a lost executor's shard is written anew by its task's next attempt.

Defined cases: a null text is an empty one, whose record holds the end id only; rows without doc_id come first; rows of one
doc_id stand in the order of a hash of their texts, equal ones as they were read; repeated rows are kept; a long text is one record
whole, and shards are cut by bytes as well as by rows; an empty table gives an index without rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelake.llm.bpe import Vocabulary, encoder
from tracelake.llm.common import binary, documents, map_arrow, scratch, small_batches

#: Fixed value: what is added to a rotated checksum.
MASK_DELTA = 0xA282EAD8
#: Documents, and bytes of their texts, in a shard on average: a reader holds one shard in memory.
ROWS_PER_SHARD, BYTES_PER_SHARD = 8192, 16 << 20
#: Shards whose sums are added up in one task.
SHARDS_TOGETHER = 4096

HEAD, NAME = struct.Struct("<QI"), struct.Struct("<qB")
INDEX_SCHEMA = "shard int, record long, doc_id long, offset long, size long, local_start long, n_tokens long, ids_crc32 long"
RECORD_SCHEMA = "doc_id long, ids binary"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, small: bool = False) -> bytes:
    """A record of ids: little-endian unsigned 16-bit if small, else 32-bit."""
    payload = NAME.pack(doc_id or 0, (doc_id is None) | 2 * small) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload)), b"\n"))


def read_frame(data: bytes, at: int) -> tuple[int, int | None, bytes]:
    """(where the next record begins, doc_id, ids as unsigned 32-bit); ValueError if a checksum is wrong."""
    if len(data) < at + HEAD.size:
        raise ValueError(f"no whole record at byte {at}")
    size, check = HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"wrong checksum of the length at byte {at}")
    end = at + HEAD.size + size
    payload = data[at + HEAD.size : end]
    if len(data) < end + 5 or masked(payload) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"wrong checksum of the payload at byte {at}")
    doc_id, flags = NAME.unpack_from(payload)
    ids = payload[NAME.size :]
    return end + 5, None if flags & 1 else doc_id, np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if flags & 2 else ids


def write_records(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = 2, rows_per_shard: int = ROWS_PER_SHARD, bytes_per_shard: int = BYTES_PER_SHARD) -> None:
    """Encodes documents with the tokenizers library and writes the shards.

    One shuffle, of texts by ranges of doc_id, a hash of the text and the row's place in the input, so rows of one doc_id are cut
    into shards like any others; encoding then runs in the writing tasks, so ids are made once.
    """
    spark, voc = docs.sparkSession, Vocabulary(vocabulary)
    text, key = voc.broadcast(spark), voc.key

    def make():
        encode = encoder(key, text)
        small = encode.dtype.itemsize == 2
        end = b"" if end_id is None else np.array([end_id], dtype=encode.dtype).tobytes()

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            # The text writer ends each record with its newline.
            return pa.RecordBatch.from_arrays([binary([frame(i, ids + end, small)[:-1] for i, ids in zip(b.column(0).to_pylist(), encode.many(b.column(1).to_pylist()), strict=True)])], ["value"])

        return batch

    rows = documents(docs)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    shards = max(1, -(-total["n"] // rows_per_shard), -(-(total["size"] or 0) // bytes_per_shard))
    order = ["doc_id", "_hash", "_place"]
    in_order = rows.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    with small_batches(spark):
        map_arrow(in_order.select("doc_id", "text"), "value binary", make).select(F.col("value").cast("string")).write.option("compression", "none").text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content): the bytes of each shard."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    found = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "part-*").load(path)
    return found.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")


def _records(content: bytes):
    at = 0
    while at < len(content):
        begin = at
        at, doc_id, ids = read_frame(content, at)
        yield begin, at - begin, doc_id, ids


def build_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Reads every record of the shards, checks it, and writes the index beside them: a row for each record."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start = 0
                for k, (offset, size, doc_id, ids) in enumerate(_records(content.as_buffer().to_pybytes())):
                    out.append((shard, k, doc_id, offset, size, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
            kinds = [pa.int32()] + [pa.int64()] * 7
            columns = zip(*out, strict=True) if out else [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], re.findall(r"(\w+) \w+", INDEX_SCHEMA))

        return batch

    map_arrow(shard_files(spark, path), INDEX_SCHEMA, make, rows=1).write.parquet(index_path)
    return spark.read.schema(INDEX_SCHEMA).parquet(index_path)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with `start`, the ids of all records before: sums of shards, one row each, are added up by blocks of shards, then blocks."""
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n")).withColumn("_block", F.floor(F.col("shard") / SHARDS_TOGETHER))
    blocks = sums.groupBy("_block").agg(F.sum("_n").alias("_m"))
    # One row for SHARDS_TOGETHER shards.
    blocks = blocks.select("_block", (F.sum("_m").over(Window.orderBy("_block")) - F.col("_m")).alias("_first"))
    within = F.sum("_n").over(Window.partitionBy("_block").orderBy("shard")) - F.col("_n")
    before = sums.select("shard", "_block", within.alias("_within")).join(blocks, "_block").select("shard", (F.col("_first") + F.col("_within")).alias("_before"))
    return index.join(before, "shard").select(*index.columns, (F.col("_before") + F.col("local_start")).alias("start"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids): every record, checked, ids as little-endian unsigned 32-bit integers."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [(i, ids) for content in b.column(1) for _, _, i, ids in _records(content.as_buffer().to_pybytes())]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], type=pa.int64()), binary([x for _, x in got])], ["doc_id", "ids"])

        return batch

    return map_arrow(shard_files(spark, path), RECORD_SCHEMA, make, rows=1)


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int) -> DataFrame:
    """(position, doc_id, ids) in a random order of all records that the seed fixes.

    The index alone is put in order; each shard is then opened once and gives its records by their offsets.
    """
    order = index.select("shard", "offset", F.xxhash64(F.lit(seed), "shard", "record").alias("position"))
    wanted = order.groupBy("shard").agg(F.collect_list(F.struct("offset", "position")).alias("wanted"))

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for content, places in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = content.as_buffer().to_pybytes()
                out += [(p["position"], *read_frame(data, p["offset"])[1:]) for p in places]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=pa.int64()), pa.array([x[1] for x in out], type=pa.int64()), binary([x[2] for x in out])], ["position", "doc_id", "ids"])

        return batch

    joined = shard_files(spark, path).join(wanted, "shard").select("content", "wanted")
    return map_arrow(joined, "position long, doc_id long, ids binary", make, rows=1).orderBy("position")


def record_digests(docs: DataFrame, vocabulary: str, end_id: int | None = 2) -> DataFrame:
    """Writes docs as records in the shared folder, reads them back, and gives a row for each: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch(spark, "records")
    write_records(docs, vocabulary, path, end_id)
    return with_starts(build_index(spark, path, f"{path}-index")).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Token ids as flat unsigned-integer files with 64-bit document offsets, and reading them back.

Format, version 1, one pair of files a shard, little-endian: NAME.bin holds the ids of the shard's
documents one after another, as unsigned 16-bit integers where the vocabulary allows it, else 32-bit.
NAME.idx holds the magic b"RUGTOK01", bytes per id (u8), the number of documents (u8), the document
ids (i64 each; a null id as the smallest i64) and the offsets (u64, one more than documents) in ids
from the shard's start. A shard's base, the ids in all shards before it, is a prefix sum over the manifest.
"""

from __future__ import annotations

import mmap
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, NULL_ID = b"RUGTOK01", -(1 << 63)
MANIFEST = "first_id long, last_id long, part int, path string, n_docs long, n_ids long"


def _store(path: str):
    """File system and path within it; any that Arrow knows, or the local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Writes ids as they come; the index follows at the end."""

    def __init__(self, folder: str, item: int):
        self.path, self.item = f"{folder}/shard-{uuid.uuid4().hex}", item  # each attempt has its own name; only reported files count
        self.fs, at = _store(self.path)
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.at, self.out, self.docs, self.lengths = at, self.fs.open_output_stream(at + ".bin"), [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // self.item)

    def close(self) -> tuple:
        self.out.close()
        offsets = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)]).astype("<u8")
        with self.fs.open_output_stream(self.at + ".idx") as f:
            f.write(MAGIC + struct.pack("<QQ", self.item, len(self.docs)) + np.array(self.docs, "<i8").tobytes() + offsets.tobytes())
        return self.docs[0], self.docs[-1], self.path, len(self.docs), int(offsets[-1])


class Shard:
    """docs, offsets and ids of a shard; the ids are memory-mapped where the file is local, else read."""

    def __init__(self, path: str):
        store, at = _store(path)
        with store.open_input_stream(at + ".idx") as f:
            head = f.read()
        if head[:8] != MAGIC:
            raise ValueError(f"{path}.idx: not an index of token files")
        self.item, n = struct.unpack("<QQ", head[8:24])
        self.docs = np.frombuffer(head, "<i8", n, 24)
        self.offsets = np.frombuffer(head, "<u8", n + 1, 24 + 8 * n).astype(np.int64)
        if store.type_name == "local" and self.offsets[-1]:
            with open(at + ".bin", "rb") as f:
                buf = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with store.open_input_stream(at + ".bin") as f:
                buf = f.read()
        self.ids = np.frombuffer(buf, f"<u{self.item}")


def write_token_files(docs: DataFrame, vocab: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts (null: empty), adds end_id to each and writes them in ascending id order (null ids first).

    Returns the manifest, one row a shard. Rows are dealt by ranges of the id and a salt, so that
    copies of one id need not meet in a task; among rows of one id the order is that of the salt, which
    follows the rows' places in the input. An empty table gives no shard; further columns are not read.
    """
    path, folder_ = vocab, folder
    salted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("salt"))
    dealt = salted.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer = tokens.encoder(path, True), None
        end = end_id.to_bytes(enc.size, "little")
        for b in common.portions(batches, "text"):
            ids, n = enc.encode_all(b.column("text").to_pylist())
            ends = np.cumsum(n).tolist()
            for doc, lo, hi in zip(b.column("doc_id").to_pylist(), [0, *ends], ends):
                writer = writer or ShardWriter(folder_, enc.size)
                writer.add(doc, ids[lo:hi].tobytes() + end)
        if writer:
            first, last, at, n, ids = writer.close()
            from pyspark import TaskContext

            yield pa.RecordBatch.from_pydict({"first_id": [first], "last_id": [last], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [at], "n_docs": [n], "n_ids": [ids]})

    return common.written(dealt.mapInArrow(write, MANIFEST), "manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest (a row a shard, not a document) with base: the ids of all shards before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row["path"])
                for i in range(0, len(s.docs), 20_000):
                    docs, lo, hi = s.docs[i : i + 20_000], s.offsets[i:-1][:20_000], s.offsets[i + 1 :][:20_000]
                    crc = [zlib.crc32(s.ids[x:y].astype("<u4").tobytes()) for x, y in zip(lo, hi, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NULL_ID), pa.array(lo + row["base"]), pa.array(hi - lo), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = with_bases(manifest)
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return shards.repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, tokens.vocabulary("byte_bpe_50k.json"), common.new_path(spark, "token-files"))
    return read_token_files(manifest)


QUERIES = {"op7_token_files": op7_token_files}

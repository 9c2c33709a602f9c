"""Token ids in binary blocks with Elias-Fano document boundaries (operator 6)."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm import elias_fano
from formloom.llm.common import map_batches, prepared, table, work_path
from formloom.llm.word_bpe import encoder

#: A block: mark, bytes of an id, documents, documents without doc_id, smallest doc_id, bytes of
#: the boundaries, bytes of the doc_ids; then boundaries, doc_ids, ids.
HEAD = struct.Struct("<4sBQQqQQ")
MARK = b"EFT1"
BLOCK_DOCS, BLOCK_BYTES = 1 << 16, 8 << 20


def block(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One block of documents in ascending doc_id order, nulls first.

    The boundaries are the starts of all documents and the end of the last, in
    ids; the doc_ids are stored as distances from the smallest.
    """
    known = [x for x in doc_ids if x is not None]
    base = known[0] if known else 0
    ends = np.cumsum([0, *(len(x) // width for x in ids)]).astype(np.uint64)
    bounds = elias_fano.encode(ends)
    names = elias_fano.encode(np.array([x - base for x in known], np.uint64))
    head = HEAD.pack(MARK, width, len(ids), len(ids) - len(known), base, len(bounds), len(names))
    return head + bounds + names + b"".join(ids)


class Block:
    """Reads a block: starts through select, ids as a view of the bytes."""

    def __init__(self, data: bytes):
        mark, width, self.documents, self.nameless, self.base, bounds, names = HEAD.unpack_from(data)
        if mark != MARK:
            raise ValueError("not a block of token ids")
        a = HEAD.size
        self.bounds = elias_fano.Sequence(data[a : a + bounds])
        self.names = elias_fano.Sequence(data[a + bounds : a + bounds + names])
        self.ids = np.frombuffer(data, f"<u{width}", offset=a + bounds + names)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nameless + [int(x) + self.base for x in self.names.all()]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 1) -> None:
    """Writes the ids of all texts, each followed by `end`, in ascending doc_id order.

    `docs` needs an integer doc_id and text. A null text has only `end`; rows
    without doc_id come first; repeated doc_ids and rows are all written, equal
    ids in an order of their texts' hashes. Rows are dealt by range, so files
    follow each other; a doc_id that many rows share is cut by that hash. Each
    file has blocks of at most 65,536 documents or about 8 MB of ids (one longer
    document is a block), as binary values of a Parquet table with columns part,
    block, n_docs, n_ids, data: any file system that Spark knows can hold it, and
    a lost task is simply written again.
    """
    rows = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        enc, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        width = enc.type.itemsize
        stop = int(end).to_bytes(width, "little")
        names, ids, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()),
                "n_ids": pa.array([size // width], pa.int64()), "data": pa.array([block(names, ids, width)], pa.binary())})

        for batch in batches:
            found = ((x[a:b].tobytes() + stop) for x, bounds in enc.slices(batch.column(1)) for a, b in zip(bounds, bounds[1:], strict=False))
            for name, data in zip(batch.column(0).to_pylist(), found, strict=True):
                names.append(name)
                ids.append(data)
                size += len(data)
                if size >= BLOCK_BYTES or len(ids) == BLOCK_DOCS:
                    yield flush()
                    names, ids, size, number = [], [], 0, number + 1
        if ids:
            yield flush()

    blocks = rows.mapInArrow(run, "part int, block int, n_docs long, n_ids long, data binary")
    blocks.write.option("compression", "zstd").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, block and the number of ids before each block, from the files' counts alone.

    Blocks are numbered inside their file; the files' sums, one row a file, are
    added up in one window.
    """
    counts = spark.read.parquet(path).select("part", "block", "n_ids")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    return counts.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "block", (F.col("before") + F.col("inside")).alias("first"))


def read(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (keep_ids) ids of each document, from the files alone."""

    def make():
        def run(batch):
            for part, number, data in zip(*batch.columns, strict=True):
                b = Block(data.as_py())
                bounds = b.bounds.all().astype(np.int64)
                each = [b.ids[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
                n = len(each)
                out = {
                    "part": [part.as_py()] * n, "block": [number.as_py()] * n, "doc_id": b.doc_ids(), "inside": bounds[:-1],
                    "n_tokens": np.diff(bounds), "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in each],
                }
                yield out | {"ids": [x.astype(np.int32) for x in each]} if keep_ids else out

        return run

    files = prepared(spark).read.parquet(path).select("part", "block", "data")
    ids = ", ids array<int>" if keep_ids else ""
    each = map_batches(files, make, f"part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long{ids}")
    each = each.join(starts(spark, path), ["part", "block"]).withColumn("start", F.col("first") + F.col("inside"))
    return each.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "token-file")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path, keep_ids=False)


QUERIES = {"op6_token_file": op6_token_file}
ORACLES: dict[str, str] = {}

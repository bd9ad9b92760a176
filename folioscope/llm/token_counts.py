"""Token counts by a separator scan over flat token files.

A flat file is nothing but token identifiers, little-endian and of one width,
with an end-of-document identifier behind each document: no index, no lengths.
Files are scanned in byte blocks of any size, each by the task it falls to.  A
block reports the vectorised search's findings (its complete runs, the tokens
before its first separator and behind its last one); documents that cross
blocks are stitched by a prefix scan over the blocks of a file.

An empty file has no documents.  Tokens behind the last separator form a
document that is reported as incomplete.  Writing: null and empty texts are a
lone separator; texts that spell the separator are encoded as ordinary text, so
they add none; rows with equal or null ids stay separate rows; an empty table
gives no file and no rows; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _store, _tokens
from . import _text as tx

SEPARATOR = 49407
DTYPE = "<u2"
BLOCK_BYTES = 4 << 20


def _writer(folder: str, path: str, separator: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n = TaskContext.get(), None, 0
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{task.partitionId():08d}.bin"
        draft = f"{root}/.part-{task.partitionId():08d}-{task.taskAttemptId()}"
        end = np.array([separator], dtype).tobytes()
        encode = _tokens.encoder(path, True, dtype).ids
        for batch in batches:
            for i, j, data, offsets in tx.slices(batch.column(1)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(draft)
                raw = data.tobytes()
                out.write(b"".join(x + end for x in encode([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])))
                ordinals = pa.array(np.arange(n, n + j - i), pa.int64())
                n += j - i
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([task.partitionId()] * (j - i), pa.int32()), ordinals], ["doc_id", "shard", "ordinal"])
        if out is not None:
            out.close()
            store.move(draft, name)  # whole files only, whatever attempt wrote them

    return run


def write_files(docs: DataFrame, folder: str, path: str | None = None, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """Writes one flat file for each partition; returns (doc_id, shard, ordinal), the order of the documents in them."""
    _store.bound_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _store.pin(source.mapInArrow(_writer(folder, path or _tokens.default_path(), separator, dtype), "doc_id long, shard int, ordinal long"), "shards")


def _scanner(separator: int, dtype: str, block_bytes: int):
    kind = np.dtype(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["uri"])
                with store.open_input_file(name) as f:
                    f.seek(row["at"])
                    ids = np.frombuffer(f.read(min(block_bytes, row["size"] - row["at"])), kind)
                ends = np.flatnonzero(ids == separator)
                runs = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pa.RecordBatch.from_pylist([{"uri": row["uri"], "at": row["at"], "runs": runs.tolist(), "tail": tail}], _BLOCK)

    return run


_BLOCK = pa.schema([("uri", pa.string()), ("at", pa.int64()), ("runs", pa.list_(pa.int64())), ("tail", pa.int64())])


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, size) of the token files in a folder: names and sizes only."""
    store, root = fs.FileSystem.from_uri(folder)
    found = [x for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.is_file and x.base_name.endswith(".bin")]
    return spark.createDataFrame([(f"{folder}/{x.base_name}", x.size) for x in found], "uri string, size long")


def scan(files: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uri, ordinal, n_tokens, complete) of every document of the files; n_tokens leaves the separator out, and only a file's last document may lack it."""
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)
    blocks = files.filter("size > 0").select("uri", "size", F.explode(F.expr(f"sequence(0L, size - 1, {step}L)")).alias("at"))
    blocks = blocks.repartition(F.xxhash64("uri", "at"))
    found = _store.pin(blocks.mapInArrow(_scanner(separator, dtype, step), "uri string, at long, runs array<long>, tail long"), "blocks")
    # What the prefix scan needs of a block is two numbers; its runs stay where they are until the join.
    narrow = found.select("uri", "at", F.size("runs").alias("n_runs"), "tail")
    in_file = Window.partitionBy("uri").orderBy("at")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    has = F.when(F.col("n_runs") > 0, 1).otherwise(0)
    # Blocks up to the next one with a separator form a segment; what they hold is carried into that next block.
    marked = narrow.withColumn("segment", F.sum(has).over(in_file)).withColumn("ended", F.coalesce(F.sum("n_runs").over(earlier), F.lit(0)))
    marked = marked.withColumn("carried", F.sum("tail").over(Window.partitionBy("uri", "segment")))
    carry = F.coalesce(F.lag("carried").over(in_file), F.lit(0))
    marked = marked.withColumn("carry", carry)
    last = Window.partitionBy("uri")
    marked = marked.withColumn("last_at", F.max("at").over(last)).select("uri", "at", "ended", "carry", "carried", "last_at")
    marked = marked.join(found.select("uri", "at", "runs"), ["uri", "at"])
    lengths = F.when(F.size("runs") > 0, F.transform("runs", lambda x, i: F.when(i == 0, x + F.col("carry")).otherwise(x))).otherwise(F.array().cast("array<long>"))
    rest = F.when((F.col("at") == F.col("last_at")) & (F.col("carried") > 0), F.array("carried")).otherwise(F.array().cast("array<long>"))
    docs = marked.select("uri", "at", "ended", F.posexplode(F.concat(F.transform(lengths, lambda x: F.struct(x.alias("n"), F.lit(True).alias("complete"))), F.transform(rest, lambda x: F.struct(x.alias("n"), F.lit(False).alias("complete"))))).alias("i", "d"))
    return docs.select("uri", (F.col("ended") + F.col("i")).alias("ordinal"), F.col("d.n").alias("n_tokens"), F.col("d.complete").alias("complete"))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, shard, ordinal, n_tokens): documents written to flat files, then counted from those files alone."""
    spark = docs.sparkSession
    folder = _store.new_path(spark, "token-files")
    order = write_files(docs, folder, path)
    found = scan(list_files(spark, folder)).withColumn("shard", F.regexp_extract("uri", r"part-(\d+)\.bin", 1).cast("int"))
    return order.join(found, ["shard", "ordinal"], "left").select("doc_id", "shard", "ordinal", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))

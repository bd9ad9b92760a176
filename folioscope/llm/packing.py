"""Best-two-fit packing of documents into token sequences.

Documents are tokenized once, each ended by one identifier; only those longer
than a sequence are cut.  What a packing decides depends on lengths alone, so it
is planned over the histogram of lengths, which has at most ``capacity`` rows
however many documents there are: take the longest length left, fill its bin
greedily with the longest that fit, then put in place of the bin's smallest
piece the two unpacked pieces that fill the widened gap more tightly.  The same
bin is repeated as often as the histogram allows, so the plan stays small too.

Pieces then find their places without meeting: each knows its rank among the
pieces of its length (its rank within its input partition, plus a prefix sum
over partitions), and the plan maps (length, rank) to sequence and offset.  No
group of equal lengths, however large, is gathered anywhere.

Null and empty texts are the ending identifier alone.  Null and repeated
``doc_id`` values are packed row by row.  An empty table gives no pieces.  Other
columns are never looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _store, _tokens
from . import _text as tx

CAPACITY = 4096
END_ID = 1
_PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, rank long"


def _tokenizer(path: str, capacity: int, end_id: int):
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), defaultdict(int)
        encode = _tokens.encoder(path).ids
        for batch in batches:
            for i, j, data, offsets in tx.slices(batch.column(1)):
                raw, rows = data.tobytes(), []
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                for doc, ids in zip(batch.column(0)[i:j].to_pylist(), encode(texts), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), step)):
                        own = ids[a : a + step]
                        n = len(own) // 4
                        rows.append((doc, k, a // 4, n, own, part, ranks[n]))
                        ranks[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, rank), written once: ids are packed little-endian uint32."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    _store.bound_batches(docs.sparkSession)
    return _store.pin(source.mapInArrow(_tokenizer(path or _tokens.default_path(), capacity, end_id), _PIECES), "pieces")


@dataclass(frozen=True)
class Bins:
    """``copies`` bins that each hold ``lengths``, numbered from ``first``."""

    first: int
    copies: int
    lengths: tuple[int, ...]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins for all pieces; ``histogram`` gives the number of pieces of each length from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    out, first = [], 0
    while left.any():
        own: list[int] = []
        gap = capacity
        while True:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            k = min(gap // n, int(left[n]))
            own += [n] * k
            left[n] -= k
            gap -= k * n
        if gap and len(own) > 1:
            own, gap = _two_for_one(own, gap, left)
        used = np.bincount(own, minlength=capacity + 1)
        more = int((left[used > 0] // used[used > 0]).min())
        left -= more * used
        out.append(Bins(first, more + 1, tuple(sorted(own, reverse=True))))
        first += more + 1
    return out


def _two_for_one(own: list[int], gap: int, left: np.ndarray) -> tuple[list[int], int]:
    """The bin's smallest piece gives way to the two unpacked ones that best fill its place, if they fill more."""
    small = min(own)
    room = gap + small
    have = np.flatnonzero(left[:room])
    if not len(have):
        return own, gap
    at = np.searchsorted(have, room - have, "right") - 1
    pair = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    lone = (pair == have) & (left[have] < 2)
    pair[lone] = np.where(at[lone] > 0, have[np.maximum(at[lone] - 1, 0)], 0)
    total = np.where(pair > 0, have + pair, 0)
    best = int(np.argmax(total))
    if total[best] <= small:
        return own, gap
    a, b = int(have[best]), int(pair[best])
    own = [*own]
    own.remove(small)
    left[small] += 1
    left[a] -= 1
    left[b] -= 1
    return [*own, a, b], room - a - b


class Places:
    """(length, rank) to (sequence, offset), from a plan."""

    def __init__(self, bins: list[Bins]):
        taken: dict[int, int] = defaultdict(int)
        rows = []
        for b in bins:
            offset, each = 0, defaultdict(int)
            for n in b.lengths:
                each[n] += 1
            for n, k in each.items():
                rows.append((n, taken[n], k, b.first, offset))
                taken[n] += k * b.copies
                offset += n * k
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self._key = (table[:, 0] << 48) + table[:, 1]
        self._from, self._each, self._first, self._offset = table[:, 1:].T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._key, (length << 48) + rank, "right") - 1
        j, k = rank - self._from[at], self._each[at]
        return self._first[at] + j // k, self._offset[at] + j % k * length


def _placer(places, schema: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("global_rank").to_numpy())
            names = [n for n in batch.schema.names if n != "global_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def place(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces, with any other columns that came along, and their sequence_id and offset."""
    spark = made.sparkSession
    per_part = made.groupBy("part", "length").count()
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    ranked = made.join(starts, ["part", "length"]).withColumn("global_rank", F.col("earlier") + F.col("rank")).drop("earlier", "rank", "part")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "global_rank")
    return ranked.mapInArrow(_placer(places), schema + ", sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): packed little-endian uint32 of whole sequences; ``placed`` must carry ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    made = pieces(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

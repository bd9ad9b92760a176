"""Benchmark decontamination by winnowing.

Texts and benchmark items become words (runs of ASCII letters, digits and
non-ASCII characters, A-Z lower-cased).  Of every ``WINDOW - K + 1`` consecutive
K-word hashes the least is kept, on both sides.  A shared span of ``WINDOW``
words holds the same such set on both sides, so at least one kept fingerprint
is shared: no span of that length can be missed.  Each shared fingerprint is
then extended, word by word and exactly, to all windows around it.

An item of fewer than ``WINDOW`` words counts as one window of its own length;
winnowing guarantees nothing there, so for each such length every run of that
many words is looked up.

The documents are scanned where they lie, without a shuffle.  The benchmark is
dealt into blocks of at most about ``block_bytes`` of text; with several, what
one block has found is written before the next one is looked up, so that a
worker holds one block's index at a time, at the price of a scan for each block.

Null and empty texts have no words and no hits; items without words occur
nowhere.  Repeated documents are judged one by one; repeated item ids count
once; a null item id is written ``null``.  An empty benchmark hits nothing.
Results stand in structs of their own, so input columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store
from . import _text as tx

WINDOW = 10
K = 5
BLOCK_BYTES = 16 << 20

_HIT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", pa.string())]))
_HIT_SQL = "array<struct<start:bigint,end:bigint,item:string>>"


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    low = tx.LOWER[data]
    starts, ends, first = tx.words(low, offsets, tx.ALNUM)
    return low, starts, ends, first, tx.run_hashes(low, starts, ends)


def winnow(word: np.ndarray, first: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions and their k-word hashes: the last least one of each window of words."""
    at = tx.whole_grams(first, window)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    gram, span = tx.gram_hashes(word, k), window - k + 1
    last_first = np.stack([gram[at + d] for d in range(span - 1, -1, -1)])
    kept = np.unique(at + (span - 1 - np.argmin(last_first, axis=0)))
    return kept, gram[kept]


class Index:
    """Fingerprints and exact windows of one block of the benchmark."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        self.exact: dict[bytes, tuple[str, ...]] = {}
        self.short: dict[int, np.ndarray] = {}
        kept, short = [], {}
        for name, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            low, starts, ends, first, word = _tokens(raw, np.array([0, len(raw)], np.int64))
            n = min(len(word), window)
            if not n:
                continue
            spelled = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            for i in range(len(word) - n + 1):
                key = b" ".join(spelled[i : i + n])
                have = self.exact.get(key, ())
                if name not in have:
                    self.exact[key] = (*have, name)
            if n < window:
                short.setdefault(n, []).append(tx.gram_hashes(word, n))
            else:
                kept.append(winnow(word, first, k, window)[1])
        self.kept = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
        self.short = {n: np.unique(np.concatenate(x)) for n, x in short.items()}

    def windows(self, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(n, starts) of the n-word windows that may be an item's."""
        row = tx.row_of(first)
        if len(self.kept):
            at, gram = winnow(word, first, self.k, self.window)
            at = at[_among(gram, self.kept)]
            if len(at):
                near = np.unique((at[:, None] - np.arange(self.window - self.k + 1)).ravel())
                near = near[(near >= 0) & (near + self.window <= len(word))]
                yield self.window, near[row[near] == row[near + self.window - 1]]
        for n, known in self.short.items():
            at = tx.whole_grams(first, n)
            yield n, at[_among(tx.gram_hashes(word, n)[at], known)]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def _scan(index: Index, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, word: np.ndarray) -> dict[int, dict[str, list[list[int]]]]:
    """Row -> item -> merged [start, end) word ranges."""
    found: dict[int, dict[str, list[list[int]]]] = {}
    raw = memoryview(low)
    for n, at in index.windows(word, first):
        rows = np.searchsorted(first, at, "right") - 1
        for i, row in zip(at.tolist(), rows.tolist(), strict=True):
            key = b" ".join([bytes(raw[a:b]) for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)])
            for item in index.exact.get(key, ()):
                ranges, begin = found.setdefault(row, {}).setdefault(item, []), i - int(first[row])
                if ranges and ranges[-1][0] <= begin <= ranges[-1][1]:
                    ranges[-1][1] = max(ranges[-1][1], begin + n)
                else:
                    ranges.append([begin, begin + n])
    return found


def _mapper(index) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits = [], batch.column(3).to_pylist()
            for i, _, data, offsets in tx.slices(batch.column(1)):
                low, starts, ends, first, word = _tokens(data, offsets)
                counts.append(np.diff(first))
                for row, items in _scan(index.value, low, starts, ends, first, word).items():
                    hits[i + row] = (hits[i + row] or []) + [{"start": a, "end": b, "item": item} for item, ranges in items.items() for a, b in ranges]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hits, _HIT)], ["row", "t", "n_words", "hits"])

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items, a bounded block at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        yield [(r.item, r.t) for r in part.collect()]  # one bounded block


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, hits): ``row`` holds the input columns, ``hits`` the word ranges found of each item."""
    spark = docs.sparkSession
    _store.bound_batches(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, F.col("text").cast("string").alias("t"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(_HIT_SQL).alias("hits"))
    schema = out.schema
    for block, items in enumerate(_blocks(benchmark, block_bytes)):
        if block:
            out = _store.pin(out, "hits")
        out = out.mapInArrow(_mapper(spark.sparkContext.broadcast(Index(items, window, k))), schema)
    return out.select("row", "n_words", "hits")


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n_hit, n_items, digest = [], [], []
        for hits in batch.column(2).to_pylist():
            if not hits:
                n_hit.append(0), n_items.append(0), digest.append(nothing)
                continue
            total = end = 0
            for a, b in sorted((h["start"], h["end"]) for h in hits):
                total += max(0, b - max(a, end))
                end = max(end, b)
            items = sorted({h["item"] for h in hits})
            n_hit.append(total), n_items.append(len(items)), digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())], ["row", "n_words", "n_hit", "n_items", "items_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("row.doc_id", "n_words", "hits")
    return found.mapInArrow(_summary, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string").withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    return scan(docs, benchmark).filter("hits IS NULL OR size(hits) = 0").select("row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
b0 AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
b1 AS (SELECT item, ws, CAST(least(len(ws), 10) AS BIGINT) AS n FROM b0 WHERE len(ws) > 0),
b2 AS (SELECT item, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM b1),
b AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS s FROM b2),
ns AS (SELECT DISTINCT n FROM b),
p AS (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM w JOIN ns ON len(ws) >= n),
g AS (SELECT r, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS s FROM p),
hit AS (SELECT r, g.n, i, item FROM g JOIN b ON g.n = b.n AND g.s = b.s),
nh AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM hit) GROUP BY r),
ni AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""

"""Toxicity by subword bags: n-gram embeddings averaged into a linear softmax.

A text's features are its byte n-grams (``SIZES``), each within one word and the
space on either side of it (the shortest ones in short words only; every word has some), lower-cased, hashed to ``2**LOG_BUCKETS`` buckets.
Each bucket has an embedding; a text is the mean of its features' embeddings, and
a linear softmax over that mean gives the score.  Embeddings and softmax are
trained jointly, in numpy, by Adam over the whole sample, so a misspelling that
was never seen shares most of its n-grams' vectors with the word it stands for.

As there are two classes and the model is linear behind the embeddings, a
bucket's embedding enters a score as one number, its projection on the softmax's
difference; scoring ships just these, and adds them up over whole texts.

Learning takes at most ``PER_CLASS`` labelled texts of each class, one for each id
(the least, if several share it), none longer than ``LONGEST`` bytes: those with
the least hashes of their ids, never from the held-out fold.  Half of another such draw with the classes as they come sets the
score's scale (Platt).  Scores never see labels, lang, source or doc_id.

Null and empty texts have no features and get the score of the bias alone.  Null
ids count as held out; label rows without an id or a value are left out, and of
several values for an id the mean counts, at half or more as 1.  With no label of
one class the model is empty and all scores equal.  Repeated rows are scored one
by one, empty tables give empty results, other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store
from . import _text as tx

SIZES = (3, 4, 5, 6, 7)
#: Sizes under ``LONG`` are of words of at most so many bytes: what these keep when an inner letter is changed.
SHORT_WORD = 5
LONG = 5
LOG_BUCKETS = 20
#: Buckets that fewer texts of the sample hold have no embedding.
LEAST_TEXTS = 3
DIMENSIONS = 8
PER_CLASS = 1200
LONGEST = 40_000
CALIBRATION = 1500
FOLDS = 5
STEPS = 60
RATE = 0.4
SCALE = 64.0

_SPACE = np.uint8(32)
_FOLD = np.where(tx.NOT_SPACE, tx.LOWER, _SPACE).astype(np.uint8)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows in lower case, white space as spaces, with a space before each row and behind the last."""
    rows = len(offsets) - 1
    text = np.full(len(data) + rows + 1, _SPACE, np.uint8)
    if rows == 1:
        text[1:-1] = _FOLD[data]
    else:
        text[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets)) + 1] = _FOLD[data]
    return text


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, rows) of the n-grams, size by size in each chunk of the text."""
    text = _spaced(data, offsets)
    starts = offsets + np.arange(len(offsets))  # the space before each row
    n, around = len(text), max(SIZES) + 1
    step = max(tx.CHUNK, around)
    for begin in range(0, n, step):
        low, end = max(0, begin - around), min(begin + step, n)
        part = text[low : end + around]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(tx.BYTE_VALUE[part] * tx.power(tx._BASE, len(part)), out=total[1:])
        inverse = tx.power(tx._BASE_INV, len(part) + 1)
        spaces = np.zeros(len(part) + 1, np.int32)
        np.cumsum(part == _SPACE, out=spaces[1:])
        bounds = np.concatenate([[-around], np.flatnonzero(part == _SPACE), [len(part) + around]])  # words cut by the chunk are long
        length = np.repeat(np.diff(bounds), np.diff(bounds))[around:] - 1  # of the word that follows or holds each byte
        for size in SIZES:
            first, last = begin - low, min(end - low, len(part) - size + 1)
            if last <= first:
                continue
            inner = spaces[first + size - 1 : last + size - 1] - spaces[first + 1 : last + 1]
            at = first + np.flatnonzero(inner == 0)  # spaces at the ends only
            if size < LONG:
                at = at[length[at + 1] <= SHORT_WORD]
            h = tx.mix((total[at + size] - total[at]) * inverse[at] + np.uint64(size))
            yield (h >> np.uint64(64 - LOG_BUCKETS)).astype(np.int32), np.searchsorted(starts, at + low, "right") - 1


@dataclass(frozen=True)
class Model:
    """The projection of each bucket's embedding, and the softmax's scale and bias."""

    weight: np.ndarray
    scale: float
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, data, offsets in tx.slices(column, 1 << 19):
            out.append(self.mean(data, offsets))
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.bias, -30, 30)))

    def mean(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total, count = np.zeros(rows), np.zeros(rows)
        for bucket, row in features(data, offsets):
            total += np.bincount(row, self.weight[bucket], rows)
            count += np.bincount(row, minlength=rows)
        return total / np.maximum(count, 1)


def _bag(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (bucket, text, share of the text's features)."""
    buckets, rows, shares = [], [], []
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        found = [b for b, _ in features(raw, np.array([0, len(raw)], np.int64))]
        own, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0))
        if len(own):
            buckets.append(own.astype(np.int32))
            rows.append(np.full(len(own), k, np.int32))
            shares.append((count / count.sum()).astype(np.float32))
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(buckets), np.concatenate(rows), np.concatenate(shares)


class _Adam:
    """Adam's steps with a floor under the divisor: seldom pulled weights move in proportion to their pull."""

    def __init__(self):
        self.m = self.v = self.floor = None

    def step(self, gradient: np.ndarray, rate: float) -> np.ndarray:
        if self.m is None:
            self.m, self.v = np.zeros_like(gradient), np.zeros_like(gradient)
            self.floor = 5 * float(np.abs(gradient).max()) + 1e-12
        self.m += 0.1 * (gradient - self.m)
        self.v = np.maximum(0.999 * self.v, gradient * gradient)
        return rate * self.m / (np.sqrt(self.v) + self.floor)


def train(texts: list[str], toxic: list[int], steps: int = STEPS, seed: int = 11) -> Model:
    """Embeddings and softmax, jointly."""
    rng = np.random.default_rng(seed)
    y = np.array(toxic, np.float32)
    bucket, row, share = _bag(texts)
    used = np.flatnonzero(np.bincount(bucket, minlength=1 << LOG_BUCKETS) >= LEAST_TEXTS)
    place = np.full(1 << LOG_BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    known = place[bucket] >= 0
    bucket, row, share, n = place[bucket][known], row[known], share[known], len(used)
    embedding = rng.normal(0, 0.05, (n, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.3, DIMENSIONS).astype(np.float32)  # class 1 minus class 0
    bias, side = 0.0, np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    by_bucket, by_softmax = _Adam(), _Adam()
    for step in range(steps):
        rate = RATE * (1 - step / steps)
        z = SCALE * np.bincount(row, share * (embedding @ softmax)[bucket], len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * side
        pull = np.bincount(bucket, share * error[row] * SCALE, n).astype(np.float32)
        change, turn = by_bucket.step(pull[:, None] * softmax[None, :], rate), by_softmax.step(embedding.T @ pull, rate)
        embedding -= change
        softmax = softmax - turn
        bias -= 2 * rate * float(error.sum())
    weight = np.zeros(1 << LOG_BUCKETS, np.float32)
    weight[used] = SCALE * (embedding @ softmax)
    return Model(weight, 1.0, bias)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and bias of a logistic curve through (z, y), by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        gradient = x @ (p - y) + 1e-2 * np.array([a - 1, b])
        curve = (x * (p * (1 - p))) @ x.T + 1e-2 * np.eye(2)
        change = np.linalg.solve(curve, gradient)
        a, b = a - change[0], b - change[1]
        if np.abs(change).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, b)


def _fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, calibration: int = CALIBRATION) -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.when(F.avg("toxic") >= 0.5, 1).otherwise(0).alias("toxic"))
    text = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= LONGEST)
    known = known.filter(_fold(F.col("doc_id")) != 0).join(text.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration)
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = drawn.withColumn("use", F.lit("scale")).unionByName(picked[0].withColumn("use", F.lit("fit"))).unionByName(picked[1].withColumn("use", F.lit("fit")))
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.collect_set("use").alias("use"))  # at most 2 * per_class + calibration rows
    one = text.join(F.broadcast(chosen.select("doc_id")), F.col("id") == F.col("doc_id")).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = one.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "use", "text").collect()  # a text of at most LONGEST bytes for each
    rows.sort(key=lambda r: r.doc_id)
    scale = [r for k, r in enumerate(rows) if "scale" in r.use and k % 2]
    apart = {id(r) for r in scale}
    own = [r for r in rows if "fit" in r.use and id(r) not in apart]
    if len({r.toxic for r in own}) < 2:
        return Model(np.zeros(1 << LOG_BUCKETS, np.float32), 1.0, -1.0)
    model = train([r.text for r in own], [r.toxic for r in own])
    if len({r.toxic for r in scale}) < 2:
        return model
    raw = [np.frombuffer(r.text.encode(), np.uint8) for r in scale]
    z = np.array([model.mean(x, np.array([0, len(x)], np.int64))[0] for x in raw]) + model.bias
    a, b = _platt(z, np.array([r.toxic for r in scale], float))
    return Model(model.weight, a, a * model.bias + b)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(batch.column(1)), pa.float64())], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): ``row`` holds the input columns."""
    _store.bound_batches(docs.sparkSession)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string"))
    return source.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), f"row {source.schema['row'].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model).select("row.doc_id", "score")
    return found.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

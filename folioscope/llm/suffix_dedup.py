"""Suffix dedup: removes every byte that a repeated span of ``SPAN`` bytes covers.

Spans are compared where they can be equal only.  Of the ``GRAM``-byte hashes in
every span the least (the first of equals) is the span's anchor: equal spans have
equal anchors at equal distances.  A text's spans thereby fall into runs, each
with one anchor and a context: the few hundred bytes that the run's spans cover.

1. Anchors meet by hash, which only deals contexts to the shards in which equal
   spans must meet.  An anchor found once is done with.  Equal contexts are one
   string of the collection, as equal texts are one text: its bytes are sent on
   once, and its rows in the transforms count for several.
2. The bytes of these strings are fetched.  A context found once is cut down to
   what agrees, around the anchor, with any other context of that anchor, and
   equal cuts are united.
3. The strings' suffixes are compared by Burrows-Wheeler transforms: one for each
   shard of strings, merged by refining their interleave, which yields common
   prefixes; rows with ``SPAN`` bytes in common are the repeated intervals.
4. What was found for a string holds wherever the string occurs.

Texts are known by their 128-bit digests, so equal texts are worked on once and
rows need no number.  A text met twice is repeated whole.

Null texts are empty.  Texts under ``SPAN`` bytes lose nothing.  Rows with null or
equal ids stay rows of their own.  Empty tables give empty results; other columns
are never looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bwt, _store
from . import _text as tx
from ._bloom import bloom

SPAN = 200
GRAM = 32
#: Bytes of text whose anchors fall to one bucket, on average.
BUCKET_BYTES = 12 << 20
#: Longer texts are scanned in overlapping pieces of this size.
PIECE = 1 << 20
#: Strings that are compared by one merge, in bytes; those of one anchor stay together.
COLLECTION_BYTES = 1 << 20
#: Repeated contexts that a task remembers, to send them on once.
REMEMBERED = 1 << 18
#: Positions share a word with the hash, so ``anchors`` takes at most so many bytes at once, and one.
_POS = np.uint64((1 << 24) - 1)

#: An occurrence of a repeated context, a context found once, one of a repeated one's occurrences for its bytes, a repeated text.
_COPY, _OPEN, _STRING, _WHOLE = 0, 1, 2, 3


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(v)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    blocks = padded.reshape(rows, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, anchor, first span, last span) of each run of spans; positions in ``data``, rows from ``offsets``."""
    n = len(data)
    if n < span:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tx.BYTE_VALUE[data] * tx.power(tx._BASE, n), out=total[1:])
    inverse = tx.power(tx._BASE_INV, n + 1)
    hashes = tx.mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    at = np.arange(len(hashes), dtype=np.uint64)
    first = (_least((hashes & ~_POS) | at, span - gram + 1) & _POS).astype(np.int64)
    crossing = np.zeros(n + 1, np.int64)
    ends = offsets[(offsets > 0) & (offsets < n)]
    np.add.at(crossing, np.maximum(ends - span + 1, 0), 1)
    np.add.at(crossing, ends, -1)
    spans = np.flatnonzero(np.cumsum(crossing[: len(first)]) == 0)
    if not len(spans):
        return anchors(data[:0], offsets[:1], span, gram)
    anchor = first[spans]
    new = np.ones(len(spans), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (spans[1:] != spans[:-1] + 1)
    begin = np.flatnonzero(new)
    lo, hi, anchor = spans[begin], spans[np.append(begin[1:], len(spans)) - 1], anchor[begin]
    context = tx.mix((total[hi + span] - total[lo]) * inverse[lo] + (anchor - lo).astype(np.uint64) * np.uint64(1000) + (hi - lo).astype(np.uint64))
    return hashes[anchor], context, anchor, lo, hi


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bool]]:
    """(digest, text, again) of a task's texts that can hold a span; a text that comes again is given once more, with no bytes."""
    seen: dict[bytes, bool] = {}
    for batch in batches:
        for _, _, data, offsets in tx.slices(batch.column(0)):
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b - a < SPAN:
                    continue
                text = raw[a:b]
                digest = hashlib.md5(text, usedforsecurity=False).digest()
                if digest not in seen:
                    seen[digest] = False
                    yield digest, text, False
                elif not seen[digest]:
                    seen[digest] = True
                    yield digest, b"", True


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


_PACK = (("hash", np.uint64), ("context", np.uint64), ("digest", np.dtype("V16")), ("lo", np.uint32), ("runs", np.uint8), ("ahead", np.uint8), ("many", np.uint8))
#: Occurrences of contexts that their task has sent on already; runs of -1: the whole text.
_DIRECT = np.dtype([("digest", "V16"), ("lo", "<u4"), ("runs", "<i2"), ("hash", "<u8"), ("context", "<u8")])


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = defaultdict(list)
    each = sum(np.dtype(t).itemsize for _, t in _PACK)
    for blob in blobs:
        n, at = len(blob) // each, 0
        for name, kind in _PACK:
            parts[name].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(x) for name, x in parts.items()}


def _direct(records: np.ndarray, buckets: int) -> pa.RecordBatch:
    at = -1 - int.from_bytes(records["digest"][0].tobytes()[:8], "little") % buckets
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([records.tobytes()], pa.binary())], ["bucket", "packed"])


def _anchors_of(pieces: list[tuple[bytes, int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchors``, pieces and starts in their texts, of as many pieces together as positions have room for."""
    sizes = [len(p) for _, _, p in pieces]
    a = 0
    while a < len(pieces):
        b, size = a + 1, sizes[a]
        while b < len(pieces) and size + sizes[b] <= min(int(_POS) + 1, 2 * PIECE):
            size += sizes[b]
            b += 1
        offsets = np.cumsum([0, *sizes[a:b]])
        h, c, anchor, lo, hi = anchors(np.frombuffer(b"".join(p for _, _, p in pieces[a:b]), np.uint8), offsets)
        row = np.searchsorted(offsets, lo, "right") - 1
        yield h, c, anchor, lo, hi, row + a, np.array([base for _, base, _ in pieces[a:b]], np.int64)[row] + lo - offsets[row]
        a = b


def _flush(texts: list[tuple[bytes, bytes]], buckets: int, sent: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Anchors of some texts, packed by column, a row for each bucket.

    A context that these texts hold several times, or that is among ``sent``, is repeated:
    it is sent on once, and its other runs needn't meet any.  So the inside of a passage
    that a third of all texts hold costs one entry for each task.  Returns the names of
    the repeated contexts that it has sent on.
    """
    pieces = [(digest, base, text[base : base + PIECE + SPAN - 1]) for digest, text in texts for base in range(0, max(1, len(text) - SPAN + 1), PIECE)]
    h, c, anchor, lo, hi, row, start = map(np.concatenate, zip(*_anchors_of(pieces), strict=True))
    digests = np.frombuffer(b"".join(d for d, _, _ in pieces), "V16")[row]
    alike = np.lexsort((c, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[alike[1:]] != h[alike[:-1]]) | (c[alike[1:]] != c[alike[:-1]])
    many = np.zeros(len(h), np.uint8)
    many[alike[new]] = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
    names = _names(h, c)
    known = np.zeros(len(h), bool) if sent is None else np.isin(names, sent)
    own = np.sort(alike[new])
    rest = np.concatenate([alike[~new], own[known[own]]])
    own = own[~known[own]]
    if len(rest):
        records = np.empty(len(rest), _DIRECT)
        records["digest"], records["lo"], records["runs"], records["hash"], records["context"] = digests[rest], start[rest], (hi - lo)[rest], h[rest], c[rest]
        yield _direct(records, buckets)
    if not len(own):
        return names[:0]
    bucket = (h[own] % np.uint64(buckets)).astype(np.int64)
    order = own[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket, kind="stable")
    columns = [x[order] for x in (h, c, digests, start.astype(np.uint32), (hi - lo).astype(np.uint8), (anchor - lo).astype(np.uint8), many)]
    numbers, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(order))
    blobs = [b"".join(x[a:b].tobytes() for x in columns) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "packed"])
    return names[own[many[own] > 0]]


def _names(hash_: np.ndarray, context: np.ndarray) -> np.ndarray:
    return tx.mix(hash_ ^ context * np.uint64(0xD6E8FEB86659FD93))


def _emit_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, again, sent = [], 0, [], np.zeros(0, np.uint64)
        for digest, text, twice in _distinct_texts(batches):
            if twice:
                again.append(digest)
                continue
            held.append((digest, text))
            size += len(text)
            if size >= tx.SLICE_BYTES:
                names = yield from _flush(held, buckets, sent)
                if len(sent) < REMEMBERED:
                    sent = np.union1d(sent, names)
                held, size = [], 0
        if held:
            yield from _flush(held, buckets, sent)
        if again:
            records = np.zeros(len(again), _DIRECT)
            records["digest"], records["runs"] = np.frombuffer(b"".join(again), "V16"), -1
            yield _direct(records, buckets)

    return run


_FOUND = "digest binary, key long, lo int, hi int, anchor int, hash long, context long, kind int"
_FOUND_ARROW = pa.schema([("digest", pa.binary()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("anchor", pa.int32()), ("hash", pa.int64()), ("context", pa.int64()), ("kind", pa.int32())])


def _resolve(table: pa.Table) -> pa.Table:
    """One bucket's anchors: the contexts of those that are found twice."""
    blobs = table.column("packed").to_pylist()
    if table.column("bucket")[0].as_py() < 0:
        known = np.frombuffer(b"".join(blobs), _DIRECT)
        lo, kind = known["lo"].astype(np.int32), np.where(known["runs"] < 0, _WHOLE, _COPY).astype(np.int32)
        return _found(np.ascontiguousarray(known["digest"]), lo, lo + known["runs"], np.zeros(len(known), np.int32), known["hash"], known["context"], kind)
    x = _unpack(blobs)
    order = np.lexsort((x["context"], x["hash"]))
    x = {k: v[order] for k, v in x.items()}
    n = len(order)
    new_hash = np.ones(n, bool)
    new_hash[1:] = x["hash"][1:] != x["hash"][:-1]
    new = new_hash.copy()
    new[1:] |= x["context"][1:] != x["context"][:-1]
    context = np.cumsum(new) - 1
    group = np.cumsum(new_hash) - 1
    twice = np.bincount(context, 1 + x["many"])[context] > 1
    shared = np.bincount(group[new])[group] > 1
    pick = np.concatenate([np.flatnonzero(twice | shared), np.flatnonzero(new & twice)])
    kind = np.concatenate([np.where(twice, _COPY, _OPEN)[twice | shared], np.full(int((new & twice).sum()), _STRING)]).astype(np.int32)
    lo = x["lo"][pick].astype(np.int32)
    return _found(x["digest"][pick], lo, lo + x["runs"][pick], lo + x["ahead"][pick], x["hash"][pick], x["context"][pick], kind)


def _fixed(digest: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Digests, and their first halves as join keys."""
    raw = digest.tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(digest), [None, pa.py_buffer(raw)]).cast(pa.binary()), pa.array(np.frombuffer(raw, np.int64)[::2])


def _found(digest: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, hash_: np.ndarray, context: np.ndarray, kind: np.ndarray) -> pa.Table:
    whole = [np.ascontiguousarray(x).view(np.int64) for x in (hash_, context)]
    columns = [*_fixed(digest), pa.array(lo), pa.array(hi.astype(np.int32)), pa.array(anchor.astype(np.int32)), *map(pa.array, whole), pa.array(kind)]
    return pa.table(columns, schema=_FOUND_ARROW)


def _wanted(filter_, full: bool = False):
    """(digest, text) of a task's distinct texts that a Bloom filter passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        size = 0
        for digest, text, again in _distinct_texts(batches):
            if not again:
                held.append((digest, text))
                size += len(text)
            if size >= tx.SLICE_BYTES:
                yield from _passed(held, filter_.value)
                held, size = [], 0
        if held:
            yield from _passed(held, filter_.value)

    return run


def _passed(held: list[tuple[bytes, bytes]], filter_) -> Iterator[pa.RecordBatch]:
    may = filter_.may_hold(np.array([_key(d) for d, _ in held], np.int64)).tolist()
    keep = [x for x, m in zip(held, may, strict=True) if m]
    if keep:
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in keep], pa.binary()), pa.array([t for _, t in keep], pa.binary())], ["digest", "bytes"])


_CONTEXT = "bucket long, digest binary, lo int, ahead int, hash long, context long, kind int, bytes binary"


def _contexts(buckets: int):
    """The bytes of the contexts asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # the same text may come from several tasks
        for batch in batches:
            out = []
            for digest, text, asked in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if digest in done:
                    continue
                done.add(digest)
                for r in {(r["lo"], r["kind"]): r for r in asked}.values():
                    out.append(((r["hash"] % 2**64) % buckets, digest, r["lo"], r["anchor"] - r["lo"], r["hash"], r["context"], r["kind"], text[r["lo"] : r["hi"] + SPAN]))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "digest", "lo", "ahead", "hash", "context", "kind", "bytes"])

    return run


#: Bytes to 1 .. 255, as UTF-8 has no 255; what is shorter is filled up with 0.
_FROM_ONE = bytes([*range(1, 256), 255])


def _agreement(strings: list[bytes], group: np.ndarray) -> np.ndarray:
    """For each string the longest prefix that it shares with any other of its group."""
    n = len(strings)
    out = np.zeros(n, np.int64)
    padded = np.array([s.translate(_FROM_ONE) for s in strings], "S")
    order = np.lexsort((padded, group))
    sizes = np.array([len(s) for s in strings], np.int64)[order]
    table, group = padded[order].view(np.uint8).reshape(n, -1), group[order]
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1])) * (group[1:] == group[:-1])
    most = np.zeros(n, np.int64)
    most[1:] = common
    most[:-1] = np.maximum(most[:-1], common)
    out[order] = most
    return out


_RANGES = pa.schema([("digest", pa.binary()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("hash", pa.int64()), ("context", pa.int64())])
_RANGES_SQL = "digest binary, key long, lo int, hi int, hash long, context long"


def _edges(table: pa.Table) -> pa.Table:
    """One bucket's strings: the repeated spans of each, by place in the text (found once) or in the string (no digest)."""
    digest, lo, ahead, hash_, context, kind, raw = (table.column(c).to_pylist() for c in ("digest", "lo", "ahead", "hash", "context", "kind", "bytes"))
    own = sorted({(digest[i], lo[i], kind[i]): i for i in range(len(raw))}.values(), key=lambda i: hash_[i])
    group = np.array([hash_[i] for i in own], np.int64)
    right = _agreement([raw[i][ahead[i] :] for i in own], group).tolist()
    left = _agreement([raw[i][: ahead[i]][::-1] or b"" for i in own], group).tolist()
    found: list[tuple[int, int, int]] = []  # (row, first span, last span)
    held: dict[tuple[bytes, int, int], list[tuple[int, int]]] = {}  # (bytes, place of the anchor, hash) -> (row, first span)
    size = 0
    for k, (i, a, b) in enumerate(zip(own, left, right, strict=True)):
        if kind[i] == _STRING:
            a, b = ahead[i], len(raw[i]) - ahead[i]
        if a + b >= SPAN:
            cut = raw[i][ahead[i] - a : ahead[i] + b]
            held.setdefault((cut, a, hash_[i]), []).append((i, ahead[i] - a))
            size += len(cut)
        if size >= COLLECTION_BYTES and (k + 1 == len(own) or hash_[own[k + 1]] != hash_[i]):
            found += _merged(held, kind)
            held, size = {}, 0
    found += _merged(held, kind)
    rows = []
    for i, a, b in found:
        if kind[i] == _OPEN:
            rows.append((digest[i], _key(digest[i]), lo[i] + a, lo[i] + b, hash_[i], context[i]))
        else:
            rows.append((None, None, a, b, hash_[i], context[i]))
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RANGES)], schema=_RANGES)


def _merged(held: dict[tuple[bytes, int, int], list[tuple[int, int]]], kind: list[int]) -> Iterator[tuple[int, int, int]]:
    """(row, first span, last span) of the repeated intervals of a collection of strings."""
    copies = np.array([len(m) + any(kind[i] == _STRING for i, _ in m) for m in held.values()], np.int64)
    for members, at in zip(held.values(), _bwt.repeated_starts([c for c, _, _ in held], SPAN, copies), strict=True):
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1)
            runs = list(zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True))
            yield from ((i, first + a, first + b) for i, first in members for a, b in runs)


def _covered(n: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the spans that begin in the ranges; an open range is the whole text."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        a, b = (0, n) if hi < lo else (lo, hi + SPAN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, removed runs, kept bytes)."""
    done: set[bytes] = set()
    for batch in batches:
        out = []
        for digest, text, ranges in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if digest in done:
                continue
            done.add(digest)
            runs = _covered(len(text), [(r["lo"], r["hi"]) for r in ranges])
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            out.append((digest, sum(b - a for a, b in runs), len(runs), [{"start": a, "end": b} for a, b in runs], b"".join(kept)))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["digest", "n_removed", "n_spans", "removed", "kept"])


def repeated(docs: DataFrame) -> DataFrame:
    """(digest, key, lo, hi): ranges of starts of repeated spans, by text; hi < lo stands for the whole text."""
    _store.bound_batches(docs.sparkSession)
    text = docs.select(F.col("text").cast("string").alias("text"))
    buckets = max(1, _store.total_bytes(text) // BUCKET_BYTES)
    packed = text.mapInArrow(_emit_anchors(buckets), "bucket long, packed binary")
    found = _store.pin(packed.groupBy("bucket").applyInArrow(_resolve, _FOUND), "anchors")
    asked = found.filter(F.col("kind").isin(_OPEN, _STRING))
    by_text = asked.groupBy("digest").agg(F.collect_list(F.struct("lo", "hi", "anchor", "hash", "context", "kind")).alias("asked"))
    texts = text.mapInArrow(_wanted(bloom(asked.select("key"))), "digest binary, bytes binary")
    contexts = texts.join(by_text.hint("shuffle_hash"), "digest").select("digest", "bytes", "asked").mapInArrow(_contexts(buckets), _CONTEXT)
    edges = _store.pin(contexts.groupBy("bucket").applyInArrow(_edges, _RANGES_SQL), "intervals")
    once = edges.filter("digest IS NOT NULL").select("digest", "key", "lo", "hi")
    string = edges.filter("digest IS NULL").select("hash", "context", F.col("lo").alias("first"), F.col("hi").alias("last"))
    copies = found.filter(F.col("kind") == _COPY).join(string, ["hash", "context"]).select("digest", "key", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last")).alias("hi"))
    whole = found.filter(F.col("kind") == _WHOLE).select("digest", "key", "lo", "hi")
    return _store.pin(once.union(copies).union(whole), "repeated")


def cut_texts(docs: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, removed, kept) of each text that loses bytes: byte ranges, and the bytes that stay."""
    found = repeated(docs)
    ranges = found.groupBy("digest").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    text = docs.select(F.col("text").cast("string").alias("text"))
    texts = text.mapInArrow(_wanted(bloom(found.select("key"))), "digest binary, bytes binary")
    joined = texts.join(ranges.hint("shuffle_hash"), "digest").select("digest", "bytes", "ranges")
    return joined.mapInArrow(_cut, "digest binary, n_removed long, n_spans long, removed array<struct<start:bigint,end:bigint>>, kept binary")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    cut = cut_texts(docs).select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).dropDuplicates(["digest"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.sha2(text.cast("binary"), 256).alias("whole"))
    out = rows.join(cut, "digest", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Exact n-gram Jaccard join with vertical partitioning.

A document's set holds its distinct n-word shingles (64-bit hashes).  Documents
with equal sets form a class, and only classes are compared.  All n-grams stand
in one global order: first those that are rare in prefixes, by hash, then the
most frequent ones, by frequency.  Linked classes share an n-gram among the
first few of each set in that order (prefix filter), so many of them that the
rest of a set can make up what is missing (prefix overlap filter), and have like
sizes (length filter); the first n-gram that they share leaves room for the rest
(position filter); pairs that pass become candidates.

N-grams are counted over all sets before they are ordered: a text's own n-grams
come before those that it shares with its near copies, so that prefixes of texts
that are alike, but not linked, meet seldom.

The global order is cut into fragments, each set into its pieces in them; the
overlap of a candidate pair is counted fragment by fragment and summed per pair.

Near copies come in groups whose members are nearly all linked with each other.
To lose no link between different texts and yet emit no group's pairs, there
are two rounds.  First each class meets one partner, the hub (the member that
shares most) of the posting lists that it is in; that gives most components.
Then only pairs whose ends lie in different components are left to verify, and
all of them are.  The components are those of the complete graph of links.

Posting lists of the frequent n-grams are dealt out with salt, as many as their
frequency asks for, before any list is looked at as a whole.

Null texts and texts without words have empty sets: they link with nothing and
``component_id`` is their own ``doc_id``.  A text with fewer than n words has one
shingle, the whole sequence.  Null ids are never the smallest; a component of
null ids only has a null id.  Repeated rows are one class.  Empty tables
give empty results; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _graph, _store, _tokens
from . import _text as tx
from ._bloom import bloom

N = 4
PERCENT = 85
FRAGMENTS = 8
#: N-grams are pre-aggregated in runs of texts with so many of them, and counted in buckets of about so many.
COUNTED_TOGETHER = 1 << 20
BUCKET_GRAMS = 1 << 22
#: The order's table of frequent n-grams: at least so frequent, at most so many (8 MB).
FREQUENT = 8
MOST_FREQUENT = 1 << 20
_MAY_BITS = 22
#: Members of a frequent n-gram's posting list for each grain of salt.
PER_SALT = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each row, ascending; first[i] is where row i begins."""
    low = tx.LOWER[data]
    starts, ends, first = tx.words(low, offsets, tx.NOT_SPACE)
    word = tx.run_hashes(low, starts, ends)
    count, at = np.diff(first), tx.whole_grams(first, n)
    row, gram = tx.row_of(first), tx.gram_hashes(word, n)
    rows, keys = [row[at]], [gram[at]]
    for m in range(1, n):  # too short for n words: the whole sequence
        few = np.flatnonzero(count == m)
        if len(few):
            rows.append(few)
            keys.append(tx.mix(tx.gram_hashes(word, m)[first[few]] + np.uint64(m)))
    r, k = np.concatenate(rows), np.concatenate(keys)
    if len(offsets) == 2:  # one long text
        k = np.unique(k)
        return k, np.array([0, len(k)])
    order = np.lexsort((k, r))
    r, k = r[order], k[order]
    new = np.ones(len(k), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    r, k = r[new], k[new]
    return k, np.searchsorted(r, np.arange(len(offsets)))


def set_digests(gram: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, as two halves."""
    halves = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(gram ^ np.uint64(salt)), dtype=np.uint64)])
        halves.append(tx.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return halves[0], halves[1]


class Sets:
    """Sets of a batch's texts and the ids of their classes."""

    def __init__(self, n: int, clashes: dict[tuple[int, int], int]):
        self.n, self.clashes = n, clashes

    def of(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, node ids, second halves, hashes, first) for each slice."""
        _tokens.forget()
        for i, _, data, offsets in tx.slices(column):
            gram, first = shingle_sets(data, offsets, self.n)
            a, b = set_digests(gram, first)
            if self.clashes:
                a = np.array([self.clashes.get((x, y), x) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
            yield i, a, b, gram, first


def _new_sets(sets: Sets, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, np.ndarray]]:
    """(node ids, rows, hashes, first) of the non-empty sets that this task meets for the first time."""
    seen: set[int] = set()
    for batch in batches:
        for _, node, _, gram, first in sets.of(batch.column(0)):
            fresh = []
            for row, (x, size) in enumerate(zip(node.tolist(), np.diff(first).tolist(), strict=True)):
                if size and x not in seen:
                    seen.add(x)
                    fresh.append(row)
            if fresh:
                yield node, fresh, gram, first


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


def short_keys(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and upper half of each n-gram's hash: what it is counted by, and known by in the order."""
    return gram % np.uint64(buckets) << np.uint64(32) | gram >> np.uint64(32)


class Order:
    """The global order of n-grams: by hash, the frequent ones last by frequency.

    Any order that depends on the n-gram alone is exact, so that two n-grams may
    share a short key.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, buckets: int):
        by_key = np.argsort(keys)
        self._sorted, counts, self._buckets = keys[by_key], counts[by_key], buckets
        self._by = np.empty(len(keys), np.int32)
        order = np.lexsort((self._sorted, counts))
        self._by[order] = np.arange(len(keys), dtype=np.int32)
        self._salts = np.maximum(1, counts[order] // PER_SALT).astype(np.int32)
        self._may = np.zeros(1 << _MAY_BITS, bool)  # by a hash's upper bits, which a short key holds
        self._may[(self._sorted & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - _MAY_BITS)] = True

    def __len__(self) -> int:
        return len(self._sorted)

    def rank(self, gram: np.ndarray) -> np.ndarray:
        """Rank among the frequent n-grams, or -1."""
        out = np.full(len(gram), -1, np.int64)
        may = np.flatnonzero(self._may[gram >> np.uint64(64 - _MAY_BITS)])
        if len(may):
            key = short_keys(gram[may], self._buckets)
            at = np.minimum(np.searchsorted(self._sorted, key), len(self._sorted) - 1)
            out[may] = np.where(self._sorted[at] == key, self._by[at], -1)
        return out

    def arrange(self, gram: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An ascending set in the global order, and its ranks, from the ranks of its n-grams."""
        often = rank >= 0
        late = np.argsort(rank[often], kind="stable")
        return np.concatenate([gram[~often], gram[often][late]]), np.concatenate([rank[~often], rank[often][late]])

    def salts(self, rank: np.ndarray) -> np.ndarray:
        return np.where(rank >= 0, self._salts[rank] if len(self._salts) else 1, 1)

    def fragment(self, gram: np.ndarray, fragments: int) -> np.ndarray:
        """Equal ranges of hashes, then all frequent n-grams: cuts of the global order."""
        cold = (gram >> np.uint64(32)).astype(np.int64) * (fragments - 1) >> 32
        return np.where(self.rank(gram) >= 0, fragments - 1, cold)


def _digests(sets: Sets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, node, half, _, first in sets.of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids[i : i + len(node)], pa.array(np.diff(first), pa.int64()), pa.array(node), pa.array(half)], ["doc_id", "n", "node", "half"])

    return run


_COUNTS = "bucket long, once binary, several binary, times binary"


def _packed_counts(sets: Sets, buckets: int):
    """The n-grams of runs of texts, by bucket: those that a run holds once, and those that it holds several times with how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, fresh, gram, first in _new_sets(sets, batches):
            held += [gram[first[r] : first[r + 1]] for r in fresh]
            size += sum(len(x) for x in held[-len(fresh) :])
            if size >= COUNTED_TOGETHER:
                yield _by_bucket(held, buckets)
                held, size = [], 0
        if held:
            yield _by_bucket(held, buckets)

    return run


def _by_bucket(held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    key, count = np.unique(short_keys(np.concatenate(held), buckets), return_counts=True)
    bucket, half, once = key >> np.uint64(32), key.astype(np.uint32), count == 1
    numbers, begin = np.unique(bucket, return_index=True)
    out: list[tuple[bytes, bytes, bytes]] = []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True):
        one = once[a:b]
        out.append((half[a:b][one].tobytes(), half[a:b][~one].tobytes(), count[a:b][~one].astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], ["bucket", "once", "several", "times"])


def _count_bucket(table: pa.Table) -> pa.Table:
    """One bucket's frequent n-grams, with the number of sets that hold them."""
    _tokens.forget()
    once, several, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32) for c in ("once", "several", "times"))
    single = np.sort(once)
    begin = np.flatnonzero(np.concatenate([[True], single[1:] != single[:-1]])) if len(single) else np.zeros(0, np.int64)
    runs = np.diff(np.append(begin, len(single)))
    single = single[begin]
    more, at = np.unique(several, return_inverse=True)
    total = np.bincount(at, times, len(more)).astype(np.int64)
    if len(single):
        where = np.minimum(np.searchsorted(single, more), len(single) - 1)
        total += np.where(single[where] == more, runs[where], 0)
    alone = (runs >= FREQUENT) & ~np.isin(single, more)
    often = total >= FREQUENT
    half, count = np.concatenate([more[often], single[alone]]), np.concatenate([total[often], runs[alone]])
    key = table.column("bucket")[0].as_py() << 32 | half.astype(np.int64)
    return pa.table({"key": pa.array(key, pa.int64()), "n": pa.array(count, pa.int64())})


_POSTING = "gram long, salt int, node long, size int, place int"


def _postings(sets: Sets, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, fresh, gram, first in _new_sets(sets, batches):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            ranks = order.value.rank(gram)
            for r in fresh:
                size = int(first[r + 1] - first[r])
                p = prefix_length(size, percent)
                own, rank = order.value.arrange(gram[first[r] : first[r + 1]], ranks[first[r] : first[r + 1]])
                salt = (int(node[r]) & 0x7FFFFFFF) % order.value.salts(rank[:p])
                salt = np.where(rank[:p] >= 0, salt, -1)
                for have, x in zip(out, (own[:p].view(np.int64), salt, np.full(p, node[r]), np.full(p, size), np.arange(p)), strict=True):
                    have.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(t) for x, t in zip(out, kinds, strict=True)], ["gram", "salt", "node", "size", "place"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted posting lists, those with two members or more; grains of salted lists as they are.

    Only a list's first row is ever held back, for the next batch to decide on.
    """
    held: pa.RecordBatch | None = None
    open_list: tuple[int, int] | None = None  # a list that has given out rows
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch]) if batch.num_rows else held
            held = None
        if not batch.num_rows:
            continue
        gram, salt = (batch.column(k).to_numpy() for k in (0, 1))
        same = (gram[1:] == gram[:-1]) & (salt[1:] == salt[:-1])
        keep = salt >= 0
        keep[1:] |= same
        keep[:-1] |= same
        k = 0
        while k < len(gram) and (gram[k], salt[k]) == open_list:  # at most one such row isn't kept already
            keep[k] = True
            if k + 1 < len(gram) and same[k]:
                break
            k += 1
        if not keep[-1]:
            held, open_list = batch.slice(len(gram) - 1), None
        else:
            open_list = (int(gram[-1]), int(salt[-1]))
        yield batch.filter(pa.array(keep))


def _segments(sets: Sets, order, wanted, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, fresh, gram, first in _new_sets(sets, batches):
            may = wanted.value.may_hold(node)
            rows: list[tuple[int, int, np.ndarray]] = []
            if not may[fresh].any():
                continue
            parts = order.value.fragment(gram, fragments)
            for r in fresh:
                if not may[r]:
                    continue
                own, part = gram[first[r] : first[r + 1]], parts[first[r] : first[r + 1]]
                rows += [(int(node[r]), f, own[part == f].view(np.int64)) for f in np.unique(part).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.list_(pa.int64()))], ["node", "fragment", "grams"])

    return run


def _need(a: str, b: str, percent: int):
    """Shared n-grams that sets of these sizes need for a link."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _like_sizes(a: str, b: str, percent: int):
    """Length filter: the smaller set can hold the overlap that is needed."""
    return _need(a, b, percent) <= F.least(F.col(a), F.col(b))


def _early(mine: str, place: str, other: str, percent: int):
    """Position filter: the first n-gram that a linked pair shares leaves room behind it for the rest."""
    return F.col(mine) - F.col(place) >= _need(mine, other, percent)


def _shared_enough(a: str, b: str, shared: str, percent: int):
    """Prefix overlap filter: a pair shares no more than what its prefixes share and the rest of the set whose prefix ends first."""
    rest = F.ceil(F.lit(percent) * F.greatest(F.col(a), F.col(b)) / F.lit(100)) - 1
    return F.col(shared) + rest >= _need(a, b, percent)


class Join:
    """The join's steps over one table of documents."""

    def __init__(self, docs: DataFrame, n: int = N, percent: int = PERCENT, fragments: int = FRAGMENTS):
        _store.bound_batches(docs.sparkSession)
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.text = self.docs.select("text")
        self.spark, self.n, self.percent, self.fragments = docs.sparkSession, n, percent, fragments
        self.sets = Sets(n, {})
        keys = self.docs.mapInArrow(_digests(self.sets), "doc_id long, n long, node long, half long")
        self.keys = _store.pin(keys, "keys")
        self._settle_clashes()

    def _settle_clashes(self) -> None:
        """Node ids are 64 of a set's 128 bits; the few sets that share theirs get others."""
        several = self.keys.groupBy("node").agg(F.min("half").alias("lo"), F.max("half").alias("hi")).filter("lo <> hi").select("node")
        rows = self.keys.join(_store.merged(several), "node").select("node", "half").distinct().collect()  # about (sets / 2**32)**2 of them
        if rows:
            self.sets.clashes = {(r.node, r.half): int(tx.mix(np.array([r.node ^ r.half], np.int64).view(np.uint64)).view(np.int64)[0]) for r in rows}
            self.keys = _store.pin(self.docs.mapInArrow(_digests(self.sets), "doc_id long, n long, node long, half long"), "keys")

    def order(self) -> Order:
        """Counts every n-gram of every set, and keeps the most frequent ones."""
        buckets = 1 + (self.keys.agg(F.sum("n")).first()[0] or 0) // BUCKET_GRAMS
        counts = self.text.mapInArrow(_packed_counts(self.sets, buckets), _COUNTS)
        often = counts.groupBy("bucket").applyInArrow(_count_bucket, "key long, n long")
        top = often.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toArrow()
        return Order(top.column("key").to_numpy().astype(np.uint64), top.column("n").to_numpy(), buckets)

    def lists(self, order) -> DataFrame:
        """(gram, node, size, place): the posting lists that have two members or more, written once."""
        made = self.text.mapInArrow(_postings(self.sets, self.percent, order), _POSTING).repartition("gram", "salt")
        met = made.dropDuplicates().sortWithinPartitions("gram", "salt").mapInArrow(_meet, _POSTING)
        return _store.pin(met.drop("salt"), "lists")

    def hubs(self, lists: DataFrame) -> DataFrame:
        """(gram, hub, hub_size): of each list the member whose lists are longest in all.

        The text that near copies stem from has no n-grams of its own in front of
        the shared ones, so it stands in more, and longer, lists than they do.
        """
        long = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        weight = lists.join(_store.merged(long), "gram").groupBy("node").agg(F.sum("members").alias("weight"))
        known = lists.select("gram", "node", "size").join(_store.merged(weight), "node")
        best = known.groupBy("gram").agg(F.max("weight").alias("weight"))
        top = known.join(_store.merged(best), ["gram", "weight"]).groupBy("gram").agg(F.min("node").alias("hub"))
        return top.join(_store.merged(lists.select("gram", F.col("node").alias("hub"), F.col("size").alias("hub_size"))), ["gram", "hub"])

    def first_pairs(self, lists: DataFrame) -> DataFrame:
        """For each class the hub that it shares most n-grams with."""
        met = lists.join(_store.merged(self.hubs(lists)), "gram").filter("node <> hub").filter(_like_sizes("size", "hub_size", self.percent))
        shared = met.groupBy("node", "size", "hub", "hub_size").count().filter(_shared_enough("size", "hub_size", "count", self.percent))
        return shared.groupBy("node").agg(F.max_by("hub", "count").alias("b")).select(F.col("node").alias("a"), "b")

    def cross_pairs(self, lists: DataFrame, comps: DataFrame) -> DataFrame:
        """All candidate pairs whose ends lie in different components.

        N-grams whose lists have the same members bring the same pairs, so one of
        them stands for all, with the earliest place that each member has among them.
        """
        own = lists.join(_store.merged(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        alike = [F.count(F.lit(1)).alias("members"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"digest{k}") for k in range(2))]
        mixed = own.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *alike).filter("lo <> hi").drop("lo", "hi")
        same = ["members", "digest0", "digest1"]
        named = mixed.join(_store.merged(mixed.groupBy(*same).agg(F.min("gram").alias("list"))), same).select("gram", "list")
        own = own.join(_store.merged(named), "gram").groupBy("list", "node").agg(F.min("place").alias("place"), F.first("size").alias("size"), F.first("comp").alias("comp"), F.collect_set("gram").alias("grams"))
        own = _store.pin(own, "mixed-lists")
        x = own.select("list", *[F.col(c).alias(f"x_{c}") for c in ("node", "size", "place", "comp")])
        y = own.select("list", *[F.col(c).alias(f"y_{c}") for c in ("node", "size", "place", "comp")])
        both = (F.col("x_node") < F.col("y_node")) & (F.col("x_comp") != F.col("y_comp")) & _like_sizes("x_size", "y_size", self.percent)
        both = both & _early("x_size", "x_place", "y_size", self.percent) & _early("y_size", "y_place", "x_size", self.percent)
        pairs = x.join(_store.merged(y), "list").filter(both).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"), "x_size", "y_size").distinct()
        prefix = own.groupBy("node").agg(F.flatten(F.collect_list("grams")).alias("grams"))  # a prefix is as short as its text asks for
        left, right = (prefix.select(F.col("node").alias(end), F.col("grams").alias(side)) for end, side in (("a", "left"), ("b", "right")))
        known = pairs.join(_store.merged(left), "a").join(_store.merged(right), "b")
        known = known.withColumn("count", F.size(F.array_intersect("left", "right")))
        return known.filter(_shared_enough("x_size", "y_size", "count", self.percent)).select("a", "b")

    def linked(self, pairs: DataFrame, order) -> DataFrame:
        """Of candidate pairs (a, b), those with enough shared n-grams: partial overlaps by fragment, summed per pair."""
        pairs = _store.pin(pairs, "pairs")
        ends = pairs.select("a").union(pairs.select("b"))
        pieces = self.text.mapInArrow(_segments(self.sets, order, bloom(ends), self.fragments), "node long, fragment int, grams array<long>")
        pieces = pieces.groupBy("node", "fragment").agg(F.first("grams").alias("grams"))
        sized = pairs.withColumn("fragment", F.explode(F.array(*[F.lit(k) for k in range(self.fragments)])))
        one = pieces.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("left"))
        two = pieces.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("right"))
        partial = sized.join(_store.merged(one), ["a", "fragment"]).join(_store.merged(two), ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("left", "right")).alias("shared"))
        total = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        size = self.keys.select("node", "n").distinct()
        n_a, n_b = (size.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")) for end in "ab")
        whole = total.join(_store.merged(n_a), "a").join(_store.merged(n_b), "b")
        return whole.filter(100 * F.col("shared") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")

    def components(self) -> DataFrame:
        """(node, comp) of the classes that are linked with another."""
        order = self.spark.sparkContext.broadcast(self.order())
        lists = self.lists(order)
        links = _store.pin(self.linked(self.first_pairs(lists), order), "links")
        comps = _store.pin(_graph.components(links), "components")
        more = _store.pin(self.linked(self.cross_pairs(lists, comps), order), "links")
        if more.isEmpty():
            return comps
        return _store.pin(_graph.components(links.union(more)), "components")

    def documents(self) -> DataFrame:
        """(doc_id, n, node, comp, component_id) of every row."""
        classes = self.keys.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
        member = classes.join(_store.merged(self.components()), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = member.groupBy("comp").agg(F.min("least").alias("component_id"))
        known = member.select("node", "comp").join(_store.merged(least), "comp")
        named = self.keys.join(_store.merged(known), "node", "left")
        return named.select("doc_id", "n", "node", "comp", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def join(docs: DataFrame, n: int = N, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    return Join(docs, n, percent, fragments).documents().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _keyed(sets: Sets, doubtful, passed: bool) -> Callable:
    """Rows (row, doc_id, text) that a Bloom filter over (class, id) passes or not; passed ones with their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [a for _, a, _, _, _ in sets.of(batch.column(2))]
            node = np.concatenate(node) if node else np.zeros(0, np.int64)
            ids = batch.column(1).fill_null(0).to_numpy()
            keep = pa.array(doubtful.value.may_hold(node ^ ids) == passed)
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node)], ["row", "doc_id", "node"])
            yield rows.filter(keep)

    return run


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows without doubt (alone under their id and smallest in their component)
    pass where they are read; the others meet their decision in a join.
    """
    job = Join(docs, n, percent)
    rows = job.documents().filter("n > 0")
    same = ["comp", "doc_id", "component_id"]
    held = rows.groupBy(*same, "node").count()
    held = _store.pin(held.withColumn("keep", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.min("node").over(Window.partitionBy("comp", "doc_id")))), "decisions")
    doubt = held.filter("NOT keep OR count > 1")
    sure = bloom(doubt.select(F.col("node").bitwiseXOR(F.coalesce("doc_id", F.lit(0)))))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = f"row {source.schema['row'].dataType.simpleString()}, doc_id long, node long"
    clear = source.mapInArrow(_keyed(job.sets, sure, False), schema).select("row.*")
    rest = source.mapInArrow(_keyed(job.sets, sure, True), schema)
    decided = held.select(F.col("node").alias("h_node"), F.col("doc_id").alias("h_id"), "keep", "count")
    met = rest.join(_store.merged(decided), (F.col("node") == F.col("h_node")) & F.col("doc_id").eqNullSafe(F.col("h_id")), "left")
    met = met.filter("keep IS NULL OR keep")  # no decision: an empty set
    once = met.filter("count > 1").dropDuplicates(["node", "doc_id"])
    return clear.unionByName(met.filter("count IS NULL OR count = 1").select("row.*")).unionByName(once.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
i AS (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT r, array_to_string(list_slice(ws, k, k + 3), ' ') AS g FROM i),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (SELECT r AS x, r AS y FROM w UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM w LEFT JOIN n USING (r) JOIN reach ON reach.x = w.r JOIN w o ON o.r = reach.y
GROUP BY w.r, w.doc_id, n.n
"""

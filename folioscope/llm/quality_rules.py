"""Quality rules: a ledger of rule outcomes as bit masks.

Every rule is evaluated once for each document.  The ledger keeps the
measurements and a mask with one bit for each failed rule; versioned policies
and ablations are bitwise work on that mask and never look at a text again.

Null and empty texts measure zero everywhere, so they fail ``few_words``.
Null ``doc_id`` values pass through; repeated rows are judged one by one; an
empty table gives an empty ledger; other columns of the input are ignored, so
their names cannot clash.
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

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bang", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


#: Order and bits are part of the stored ledger: append, never renumber.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * word_chars"),
    Rule(3, "duplicate_lines", "n_dup_lines >= 5"),
    Rule(4, "shouting", "2 * n_upper > word_chars"),
    Rule(5, "exclamations", "100 * n_bang > 10 * word_chars"),
    Rule(6, "long_words", "word_chars > 14 * n_words"),
    Rule(7, "short_words", "word_chars < 2 * n_words"),
    Rule(8, "duplicate_line_share", "n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines"),
)

#: Rules that a document may not fail, by policy version.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "exclamations"),
    "v2": tuple(r.name for r in RULES[:8]),
    "v3": ("few_words", "repeated_windows", "symbols", "duplicate_line_share", "shouting", "exclamations"),
}
#: v1 counts repeated lines whatever the length of the text, which long clean texts fail; v3 judges their share.
CURRENT = "v3"


def policy_mask(version: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[version])


def _repeated_words(word: np.ndarray, first: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """How many words of each row lie in n-word windows found twice or more in that row."""
    at = tx.whole_grams(first, n)
    rows = len(first) - 1
    if not len(at):
        return np.zeros(rows, np.int64)
    row = tx.row_of(first)
    key = tx.mix(tx.gram_hashes(word, n)[at] + tx.mix(row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(word) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + n, -1)
    return np.bincount(row[np.cumsum(step[:-1]) > 0], minlength=rows)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their row, and all lines with a word."""
    out, n_lines = np.zeros((2, len(offsets) - 1), np.int64)
    raw = data.tobytes()
    for i in range(len(out)):
        text = raw[offsets[i] : offsets[i + 1]]
        if b"\n" not in text:
            n_lines[i] = bool(text.strip(b" \t\n\x0b\x0c\r"))
            continue
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        out[i], n_lines[i] = len(lines) - len(set(lines)), len(lines)
    return out, n_lines


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got: list[list[np.ndarray]] = [[] for _ in _FIELDS]
        for _, _, data, offsets in tx.slices(batch.column(1)):
            starts, ends, first = tx.words(data, offsets, tx.NOT_SPACE)
            word = tx.run_hashes(data, starts, ends)

            def per_row(flag: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
                if len(offsets) == 2:  # one long text
                    return np.array([np.count_nonzero(flag)])
                total = np.concatenate([[0], np.cumsum(flag)])
                return total[offsets[1:]] - total[offsets[:-1]]

            points = per_row(tx.NOT_SPACE[data] & ((data & 0xC0) != 0x80))
            n_dup_lines, n_lines = _duplicate_lines(data, offsets)
            found = (
                np.diff(first), points, per_row(_SYMBOL[data]), n_dup_lines,
                _repeated_words(word, first), per_row((data >= 65) & (data <= 90)), per_row(data == 33), n_lines,
            )
            for have, x in zip(got, found, strict=True):
                have.append(x)
        columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in got]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *_FIELDS])


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): each rule evaluated once; bit b of ``failed`` is rule b."""
    _store.bound_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{x} long" for x in _FIELDS)
    measured = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measure, schema)
    return _with_bits(measured)


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy; kept is false wherever base_failed is true."""
    base, mask = policy_mask("base"), policy_mask(version)
    return entries.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(base)) != 0).withColumn(
        "kept", F.col("failed").bitwiseAND(F.lit(base | mask)) == 0
    )


def ablations(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents failing it, and documents that only it rejects."""
    mask = policy_mask(version)
    masked = F.col("failed").bitwiseAND(F.lit(mask))
    rules = [r for r in RULES if mask >> r.bit & 1]
    one = entries.groupBy(masked.alias("m")).count().agg(
        *[F.sum(F.when(F.col("m").bitwiseAND(F.lit(1 << r.bit)) != 0, F.col("count")).otherwise(0)).alias(f"f{r.bit}") for r in rules],
        *[F.sum(F.when(F.col("m") == (1 << r.bit), F.col("count")).otherwise(0)).alias(f"o{r.bit}") for r in rules],
    )
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.coalesce(F.col(f"f{r.bit}"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"o{r.bit}"), F.lit(0)).alias("n_only")) for r in rules])
    return one.select(F.inline(rows))


def filter_documents(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns, judged in place (no join)."""
    _store.bound_batches(docs.sparkSession)
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    fields = "".join(f", {x} long" for x in _FIELDS)
    out_schema = f"row {inner.schema['row'].dataType.simpleString()}{fields}"
    judged = apply_policy(_with_bits(inner.mapInArrow(_measure_rows, out_schema)), version)
    return judged.filter("kept").select("row.*")


def _measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(0)
        texts = rows.flatten()[rows.type.get_field_index("text")]
        for out in measure(iter([pa.RecordBatch.from_arrays([rows, texts], ["row", "t"])])):
            yield pa.RecordBatch.from_arrays(out.columns, ["row", *_FIELDS])


def _with_bits(measured: DataFrame) -> DataFrame:
    failed: Column = F.lit(0)
    for r in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0))
    return measured.withColumn("failed", failed.cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


#: What the query returns (policy v3), in DuckDB's SQL.  White space is 0x20 and 0x09-0x0D.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
g AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS s FROM p),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g),
h AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i, unnest(range(0, 8)) AS k FROM c WHERE n >= 2) GROUP BY r),
m AS (
  SELECT d.doc_id,
    CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(h.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    length(t) - length(replace(t, '!', '')) AS n_bang,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN h USING (r)),
f AS (SELECT *, CAST(
    (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines >= 5 THEN 8 ELSE 0 END)
  + (CASE WHEN 2 * n_upper > word_chars THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_bang > 10 * word_chars THEN 32 ELSE 0 END)
  + (CASE WHEN word_chars > 14 * n_words THEN 64 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 128 ELSE 0 END)
  + (CASE WHEN n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines THEN 256 ELSE 0 END) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & 3) <> 0 AS base_failed, (failed & 311) = 0 AS kept, failed FROM f
"""

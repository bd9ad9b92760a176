"""Secret scans: fixed base patterns, and credential formats learned as automata.

Three base patterns give the spans that every scan reports.  Beside them the
operator learns the format of credentials from labelled examples by grammar
inference: a prefix tree of the examples' character classes with counts, in
which states whose outgoing frequencies agree (Hoeffding bound, recursively)
are merged, red-blue, into a probabilistic automaton.  One automaton is learned
for each labelled family and one for harmless tokens; every candidate (a maximal
run of credential characters that is no shorter than the shortest credential
that the formats allow) is scored by its log likelihood per character under
each, and reported when a family beats the harmless automaton by ``MARGIN``.

The labelled examples are made by rule from public format descriptions, at most
``PER_FAMILY`` of each, with a fixed seed; no corpus row is used for learning.

Null texts are empty and hold nothing; empty tables give empty results; rows
with equal ids are scanned one by one; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store

PER_FAMILY = 400
ALPHA = 0.05
MARGIN = 0.9
#: Log likelihoods of a step that no example took: credentials keep to their format, harmless tokens have none.
FOREIGN = -25.0
UNSEEN = -9.21
#: Scores of so many tokens are kept by a worker; a token's score depends on nothing else.
KEPT_SCORES = 1 << 16
KINDS = ("assign", "access", "hex", "learned")

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ASSIGN_HINT = re.compile(r"(?i)passw|secret|token|api_?key", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, so the same as [0-9a-f]+ with the short ones dropped

_B62 = string.ascii_letters + string.digits
#: Families of credentials: a literal head, alphabet and length of the rest.
FORMATS = {
    "access_key": [("AKIA", string.ascii_uppercase + "234567", 16, 16), ("ASIA", string.ascii_uppercase + "234567", 16, 16)],
    "hex_token": [("", "0123456789abcdef", 32, 64)],
    "forge_token": [("ghp_", _B62, 36, 36), ("gho_", _B62, 36, 36), ("glpat-", _B62 + "_-", 20, 20)],
    "chat_token": [("xoxb-", string.digits + "-", 12, 24), ("xoxp-", string.digits + "-", 12, 24)],
    "pay_key": [("sk_live_", _B62, 24, 32), ("pk_live_", _B62, 24, 32)],
    "signed_token": [("eyJ", _B62 + "_-", 40, 90)],
    "map_key": [("AIza", _B62 + "_-", 35, 35)],
    "base64_key": [("", _B62 + "+/", 40, 44)],
}
MIN_LENGTH = min(len(head) + least for shapes in FORMATS.values() for head, _, least, _ in shapes)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, in code points."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def symbol(c: str) -> str:
    """Literal heads stay as they are; bodies are classes of characters."""
    if "0" <= c <= "9":
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "g"
    if "A" <= c <= "F":
        return "A"
    if "G" <= c <= "Z":
        return "G"
    return c


def _labelled(per_family: int) -> dict[str, list[str]]:
    """Credentials of each family, and harmless tokens, by rule."""
    rng = random.Random(7)
    made = {}
    for family, shapes in FORMATS.items():
        rows = []
        for i in range(per_family):
            head, alphabet, least, most = shapes[i % len(shapes)]
            rows.append(head + "".join(rng.choices(alphabet, k=rng.randint(least, most))))
        made[family] = rows
    rows = []
    digits = lambda k, of=string.digits: "".join(rng.choices(of, k=k))
    for i in range(6 * per_family):
        word = lambda: "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") + rng.choice(["", "n", "r", "st"]) for _ in range(rng.randint(2, 5)))
        kind = i % 12
        if kind == 0:
            rows.append("".join(word() for _ in range(rng.randint(3, 5))))
        elif kind == 1:
            rows.append(word().capitalize() + "".join(word() for _ in range(3)))
        elif kind == 2:
            rows.append("-".join(word() for _ in range(rng.randint(2, 6))))
        elif kind == 3:
            rows.append("_".join(word() for _ in range(rng.randint(2, 6))) + rng.choice(["", f"_{rng.randint(1, 9999)}"]))
        elif kind == 4:
            rows.append("/".join(word() for _ in range(rng.randint(3, 7))) + rng.choice(["", f"/{rng.randint(1, 99999)}"]))
        elif kind == 5:
            rows.append("".join(rng.choices(string.digits, k=rng.randint(16, 24))))
        elif kind == 6:
            rows.append("".join(word().upper() for _ in range(rng.randint(3, 6))))
        elif kind == 7:
            rows.append("".join(word().capitalize() for _ in range(rng.randint(3, 6))) + rng.choice(["", str(rng.randint(1, 9999))]))
        elif kind == 8:
            rows.append(word() + str(rng.randint(1, 99999)) + rng.choice(["", word()]))
        elif kind == 9:
            rows.append("_".join(word() for _ in range(rng.randint(3, 5))))
        elif kind == 10:  # dates, times, numbered papers
            rows.append(rng.choice([f"{word().upper()}-20{digits(2)}-{digits(6)}", f"20{digits(2)}-{digits(2)}-{digits(2)}T{digits(6)}Z", f"{word()}_20{digits(2)}-{digits(2)}-{digits(2)}", f"{word()}-20{digits(2)}{digits(4)}-{digits(6)}"]))
        else:  # identifiers of programs
            rows.append(word() + "".join(word().capitalize() for _ in range(rng.randint(2, 4))) + rng.choice(["", f"V{rng.randint(1, 9)}", f"_{digits(2)}"]))
    made["harmless"] = [r for r in rows if len(r) >= 8]
    short = lambda: rng.choice([digits(rng.randint(1, 2)), digits(rng.randint(1, 2), string.ascii_lowercase)])
    made["harmless_parts"] = [rng.choice("-_/").join(short() for _ in range(rng.randint(7, 14))) for _ in range(per_family)]
    for name, alphabet in (("harmless_id", "0123456789abcdef"), ("harmless_ID", "0123456789ABCDEF")):  # universally unique identifiers
        made[name] = ["-".join(digits(k, alphabet) for k in (8, 4, 4, 4, 12)) for _ in range(per_family)]
    return made


class Automaton:
    """A probabilistic automaton from positive examples, by state merging."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [defaultdict(int)]
        self.ends: list[int] = [0]
        self.size: list[int] = [0]
        for x in examples:
            at = 0
            for c in map(symbol, x):
                self.size[at] += 1
                self.seen[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({}), self.seen.append(defaultdict(int)), self.ends.append(0), self.size.append(0)
                at = self.next[at][c]
            self.size[at] += 1
            self.ends[at] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._costs = self._log_costs()

    def _differ(self, fa: int, na: int, fb: int, nb: int) -> bool:
        return bool(na and nb) and abs(fa / na - fb / nb) > self._bound * (na**-0.5 + nb**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.size[a], self.ends[b], self.size[b]):
                return False
            for c in {**self.seen[a], **self.seen[b]}:
                if self._differ(self.seen[a].get(c, 0), self.size[a], self.seen[b].get(c, 0), self.size[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """State b and the tree below it go into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.size[a] += self.size[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] += n
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_states(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            known = set(red)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in known]

    def _log_costs(self) -> dict[tuple[int, str], tuple[float, int]]:
        reach, todo = {0}, [0]
        while todo:
            for t in self.next[todo.pop()].values():
                if t not in reach:
                    reach.add(t)
                    todo.append(t)
        width = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}
        return {(s, c): (math.log(n / (self.size[s] + 1) / width.get(c, 1)), self.next[s][c]) for s in reach for c, n in self.seen[s].items()}

    def score(self, token: str, unseen: float) -> float:
        """Mean log likelihood of a character; steps that no example took have a fixed one and restart."""
        at, total = 0, 0.0
        for c in token:
            step = self._costs.get((at, symbol(c)))
            if step is None:
                total, at = total + unseen, 0
            else:
                total, at = total + step[0], step[1]
        return total / max(1, len(token))


@lru_cache(maxsize=1)
def models(per_family: int = PER_FAMILY) -> tuple[dict[str, Automaton], list[Automaton]]:
    """Automata of the families, and of harmless tokens."""
    made = {k: Automaton(v) for k, v in _labelled(per_family).items()}
    return {k: a for k, a in made.items() if k in FORMATS}, [a for k, a in made.items() if k not in FORMATS]


@lru_cache(maxsize=KEPT_SCORES)
def classify(token: str) -> tuple[str, float] | None:
    """The best family and its margin over the harmless automaton, if that is MARGIN or more."""
    families, harmless = models()
    name, best = max(((k, a.score(token, FOREIGN)) for k, a in families.items()), key=lambda x: (x[1], x[0]))
    margin = best - max(a.score(token, UNSEEN) for a in harmless)
    return (name, margin) if margin >= MARGIN else None


def learned_spans(text: str) -> list[tuple[str, int, int]]:
    return [("learned", *m.span()) for m in _CANDIDATE.finditer(text) if classify(m[0])]


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans; a learned span that a base span covers adds nothing."""
    base, extra, k, far = in_order(base_spans(text)), [], 0, 0
    for span in learned_spans(text):
        while k < len(base) and base[k][1] <= span[1]:
            far = max(far, base[k][2])  # the furthest end of the base spans that begin no later
            k += 1
        if far < span[2]:
            extra.append(span)
    return base, in_order(base + extra)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by a mark of its first kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find(t.as_py() or "") for t in batch.column(1)]
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:3]]
        digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([written(s) for _, s in found], pa.string())], ["row", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _scan_redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [None if t is None else redact(t, find(t)[1]) for t in map(pa.StringScalar.as_py, batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "t"])


def _rows(docs: DataFrame) -> DataFrame:
    _store.bound_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("t"))


def scan(docs: DataFrame) -> DataFrame:
    """(row, n_assign, n_access, n_hex, base_sha256, spans); ``row`` holds the input columns."""
    rows = _rows(docs)
    return rows.mapInArrow(_scan, f"row {rows.schema['row'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; ``n_chars`` follows where it is present."""
    rows = _rows(docs)
    out = rows.mapInArrow(_scan_redact, f"row {rows.schema['row'].dataType.simpleString()}, t string")
    new = {"text": F.col("t"), "n_chars": F.length("t").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")

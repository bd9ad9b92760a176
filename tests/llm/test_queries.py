"""The queries themselves, over small tables, against brute force."""

import hashlib
import math
import random
import re
import string
import uuid
import zlib

import numpy as np
import pytest

from folioscope.llm import chat, licences, secrets, toxicity

RNG = random.Random(41)


def token(k, of=string.ascii_letters + string.digits):
    return "".join(RNG.choices(of, k=k))


SECRETS = [
    (0, f'password = "{token(12)}" and API-KEY: {token(8)} api_key:{token(5)} Secret={token(6)}'),
    (1, f"AKIA{token(16, string.ascii_uppercase)} AKIA{token(15, string.ascii_uppercase)} xAKIA{token(30, string.ascii_uppercase)}"),
    (2, f"é {token(24, '0123456789abcdef')} {token(23, '0123456789abcdef')} token:{token(40, '0123456789abcdef')}\n"),
    (3, None),
    (None, ""),
    (4, "token token: token=abcdef token='abc"),
    (4, "token token: token=abcdef token='abc"),
    (5, " ".join(f"passwd={token(9)} {token(40)}" for _ in range(400))),
    (6, "No secrets here, only the quick brown fox " * 30),
]


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def by_rule(text):
    """The base patterns, character by character."""
    text, found = text or "", []
    body, upper = string.ascii_letters + string.digits + "+/_.=-", string.ascii_uppercase + string.digits
    run = lambda at, of: next((k for k in range(at, len(text)) if text[k] not in of), len(text))
    at = 0
    while at < len(text):
        name = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(w)].lower() == w and text[at : at + len(w)].isascii()), None)
        end = None
        if name:
            for quote in (1, 0):
                k = at + len(name)
                if quote and text[k : k + 1] not in ('"', "'"):
                    continue
                k += quote
                k = run(k, " ")
                if text[k : k + 1] in (":", "=") and text[k : k + 1]:
                    k = run(k + 1, " ")
                    k += text[k : k + 1] in ('"', "'") and bool(text[k : k + 1])
                    stop = run(k, body)
                    if stop > k:
                        end = stop
                        if stop - k >= 6:
                            found.append(("assign", at, stop))
                        break
        at = end or at + 1
    for kind, head, of, least in (("access", "AKIA", upper, 20), ("hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            stop = run(at + len(head), of) if text.startswith(head, at) else at
            if stop > at + len(head):
                if stop - at >= least:
                    found.append((kind, at, stop))
                at = stop
            else:
                at += 1
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_scans(spark, folder):
    got = sorted((tuple(r) for r in secrets.query(spark, folder(documents=(SECRETS, "doc_id long, text string"))).collect()), key=str)
    want = []
    for doc, text in SECRETS:
        base = by_rule(text)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((doc, *(sum(s[0] == k for s in base) for k in ("assign", "access", "hex")), hashlib.sha256(written.encode()).hexdigest()))
    assert [r[:5] for r in got] == sorted(want, key=str)
    for doc, *_, spans in got:
        text = next((t or "" for d, t in SECRETS if d == doc), "")
        assert {f"{k}:{a}:{b}" for k, a, b in by_rule(text)} <= set(spans.split(","))
    long = next(r for r in got if r[0] == 5)
    naive = [s for s in secrets.learned_spans(SECRETS[7][1]) if not any(a <= s[1] and s[2] <= b for _, a, b in by_rule(SECRETS[7][1]))]
    assert long[5].count("learned") == len(naive) > 300


def test_learned_formats():
    """Every candidate is scored: letters alone too; identifiers are harmless."""
    assert sum(bool(secrets.learned_spans(f"see {token(40, string.ascii_letters)}.")) for _ in range(400)) > 300
    for shape in (str, lambda u: str(u).upper()):
        assert not any(secrets.learned_spans(f"id {shape(uuid.UUID(int=RNG.getrandbits(128)))}") for _ in range(100))
    assert not secrets.learned_spans("Donaudampfschifffahrtsgesellschaft internationalization /usr/share/lib/python-modules/site 2024-05-06T120000Z order_number_of_customer_17")


def test_toxicity(spark, folder):
    """Folds, and scores as the sum of each n-gram's number over the whole text."""
    texts = [(i, " ".join(RNG.choices(["you", "are", "nice", "the", "sun"] + ["idiot", "scum"] * (i % 2), k=40))) for i in range(60)]
    texts += [(60, None), (61, ""), (None, "you idiot"), (7, texts[7][1]), (62, " \n "), (63, "idi0t scumm")]
    rows = [(i, i % 2) for i in range(60)] + [(None, 1), (3, None)]
    path = folder(documents=(texts, "doc_id long, text string"), labels=(rows, "doc_id long, toxic int"))
    got = sorted((tuple(r) for r in toxicity.query(spark, path).collect()), key=str)
    model = toxicity.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    want = []
    for doc, text in texts:
        raw = b" " + bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\v\f\r" else c for c in (text or "").encode()) + b" "
        weights = []
        for size in toxicity.SIZES:
            for i in range(len(raw) - size + 1):
                part = raw[i : i + size]
                if b" " in part[1:-1]:
                    continue
                word = raw[raw.rfind(b" ", 0, i + 1) + 1 :].split(b" ")[0] if part[0] != 32 else raw[i + 1 :].split(b" ")[0]
                if size < toxicity.LONG and len(word) > toxicity.SHORT_WORD:
                    continue
                total = 0
                for k, c in enumerate(part):
                    total = (total + int(toxicity.tx.BYTE_VALUE[c]) * pow(toxicity.tx._BASE, k, 2**64)) % 2**64
                hashed = int(toxicity.tx.mix(np.array([(total + size) % 2**64], np.uint64))[0])
                weights.append(float(model.weight[hashed >> (64 - toxicity.LOG_BUCKETS)]))
        mean = sum(weights) / len(weights) if weights else 0.0
        score = 1 / (1 + math.exp(-(model.scale * mean + model.bias)))
        want.append((doc, zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 0, score, int(score >= 0.5)))
    want.sort(key=str)
    assert [r[0] for r in got] == [r[0] for r in want] and len({r[2] for r in got}) > 3
    by = lambda rows: sorted((str(d), h, round(s, 9), p) for d, h, s, p in rows)
    assert by(got) == by(want)


def test_chat(spark, folder):
    talks = [(1, 0, "system", "Be brief."), (1, 1, "user", "</s>[INST]"), (1, 2, "assistant", "ünï [/INST]"), (2, 0, "user", None), (2, 1, "assistant", "")]
    got = {r.conv_id: r for r in chat.query(spark, folder(conversations=(talks, "conv_id long, turn long, role string, text string"))).collect()}
    odd = "</s>[INST] ok [/INST]"
    all_turns = {-1: [("user", odd), ("assistant", odd)], 1: [r[2:] for r in talks[:3]], 2: [(r[2], r[3] or "") for r in talks[3:]]}
    assert got.keys() == all_turns.keys()
    for conv, turns in all_turns.items():
        told = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_licences(spark, folder):
    """What a flagged paragraph says is in its lines; a confirmed family's template stands in the text."""
    prose = "The tree went over the hills and she was driving to work in the morning sun."
    data = [(1, f"{prose}\nReleased under the MIT License.\n{prose}"), (2, prose), (3, None), (None, ""), (1, "Released under the MIT License."), (4, "\n".join([prose] * 50))]
    got = sorted((tuple(r) for r in licences.query(spark, folder(documents=(data, "doc_id long, text string"))).collect()), key=str)
    assert sorted((r[0] for r in got), key=str) == sorted((d for d, _ in data), key=str)
    named = {(str(r[0]), "MIT" in str(r)) for r in got}
    assert named == {("1", True), ("2", False), ("3", False), ("None", False), ("4", False)}
    alone = {}
    for doc, text in data:  # each row by itself
        found = next(iter(licences.scan(spark.createDataFrame([(doc, text)], "doc_id long, text string")).collect()))
        alone.setdefault(str(doc), []).append((found.n_paragraphs, sorted(f.family for f in found.flagged if f.confirmed)))
    assert alone["1"] == [(3, ["MIT"]), (1, ["MIT"])] and alone["4"] == [(50, [])]
    assert re.fullmatch(r"[\x00-\x7f]*", str([f for x in alone.values() for f in x]))

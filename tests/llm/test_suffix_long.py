"""Anchors of texts that are longer than positions have room for."""

import random

import numpy as np

from folioscope.llm import suffix_dedup


def entries(texts):
    batches = list(suffix_dedup._flush(texts, 1))
    x = suffix_dedup._unpack(batches[-1].column(1).to_pylist())
    known = [(y["digest"].tobytes(), int(y["lo"]), int(y["runs"])) for b in batches[:-1] for y in np.frombuffer(b.column(1)[0].as_py(), suffix_dedup._DIRECT)]
    return sorted(zip(*(x[k].tolist() for k in ("hash", "context", "lo", "runs", "ahead", "many")), strict=True)), sorted(known)


def test_positions_of_long_texts(monkeypatch):
    rng = random.Random(21)
    passage = bytes(rng.choices(b"abcdefg ", k=400))
    fresh = lambda n: bytes(rng.choices(b"abcdefg ", k=n))
    texts = [(b"0" * 16, fresh(700)), (b"1" * 16, passage + fresh(9000) + passage + fresh(3000)), (b"2" * 16, fresh(200)), (b"3" * 16, fresh(5000) + passage)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    want = entries(texts)
    monkeypatch.setattr(suffix_dedup, "_POS", np.uint64((1 << 11) - 1))
    assert entries(texts) == want and want[1]

"""Scans of texts that are longer than a chunk."""

import random
import re

import numpy as np
import pytest

from folioscope.llm import _text as tx
from folioscope.llm import toxicity


def column(texts):
    offsets = np.cumsum([0, *map(len, texts)])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_words_across_chunks(monkeypatch, chunk):
    rng = random.Random(chunk)
    texts = [bytes(rng.choices(b"ab \n", k=rng.randint(0, 90))) for _ in range(60)] + [b"x" * 200, b"", b"x" * 200, b" "]
    data, offsets = column(texts)
    whole = tx.words(data, offsets, tx.NOT_SPACE)
    hashes = tx.run_hashes(data, *whole[:2])
    found = [[(m.start() + int(o), m.end() + int(o)) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t, o in zip(texts, offsets, strict=False)]
    assert list(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) == [x for row in found for x in row]
    assert whole[2].tolist() == np.cumsum([0, *map(len, found)]).tolist()
    monkeypatch.setattr(tx, "CHUNK", chunk)
    parts = tx.words(data, offsets, tx.NOT_SPACE)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts, strict=True))
    assert (tx.run_hashes(data, *parts[:2]) == hashes).all()
    spelled = [data[a:b].tobytes() for a, b in zip(*whole[:2], strict=True)]
    assert len(set(spelled)) == len(set(hashes.tolist())) == len(set(zip(spelled, hashes.tolist(), strict=True)))


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_features_across_chunks(monkeypatch, chunk):
    rng = random.Random(chunk)
    texts = [bytes(rng.choices(b"abC  \n", k=rng.randint(0, 150))) for _ in range(20)] + [b"y" * 300, b""]
    data, offsets = column(texts)
    told = lambda: sorted((int(b), int(r)) for bucket, row in toxicity.features(data, offsets) for b, r in zip(bucket, row, strict=True))
    whole = told()
    monkeypatch.setattr(tx, "CHUNK", chunk)
    assert told() == whole


def test_licences_across_chunks(monkeypatch):
    """Lines and stretches are judged alike, whatever a chunk holds of them."""
    import pyarrow as pa

    from folioscope.llm import licences

    rng = random.Random(5)
    prose = lambda k: "\n".join(" ".join(rng.choices(["the", "tree", "went", "over", "hills", "license", "use"], k=8)) for _ in range(k))
    notice = "Redistribution and use in source\nand binary forms, with or without modification,\nare permitted provided that the\nfollowing conditions are met"
    texts = [f"{prose(20)}\n\n{notice}\n\n{prose(9)}\nReleased under the MIT License\n{prose(3)}", f"{prose(30)}\n{notice}\n{prose(30)}", None, "", prose(12) + "\n\n" * 3 + notice]
    model = type("Held", (), {"value": licences.train(60, 60)})
    told = lambda: [b.to_pylist() for b in licences._scanner(model)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "t"])]))]
    whole = told()
    assert sum(f["confirmed"] for r in whole[0] for f in r["flagged"]) >= 3
    for chunk in (1, 100, 700):
        monkeypatch.setattr(tx, "CHUNK", chunk)
        assert told() == whole

"""Short words with an inner letter changed, never seen in training."""

import random

import numpy as np
import pyarrow as pa

from folioscope.llm import toxicity

CALM = ["river", "stone", "morning", "garden", "paper", "window", "letter", "summer", "is", "the", "of", "a", "clear", "train", "table"]
RUDE = ["idiot", "scum", "trash", "clown", "loser", "moron"]
CHANGED = ["idi0t", "sc0m", "tr4sh", "cl0wn", "l0ser", "mor0n"]
SWAPPED = ["idoit", "scmu", "tarsh", "clwon", "lsoer", "mroon"]


def test_misspelt_short_words():
    rng = random.Random(8)
    text = lambda words, k=3: " ".join(rng.sample(rng.choices(CALM, k=30 - k) + rng.choices(words, k=k), 30))
    model = toxicity.train([text(RUDE if i % 4 == 0 else CALM) for i in range(600)], [int(i % 4 == 0) for i in range(600)])
    clean = model.scores(pa.array([text(CALM) for _ in range(200)]))
    for words in (CHANGED, SWAPPED):
        bent = model.scores(pa.array([text(words) for _ in range(200)]))
        assert np.mean(bent[:, None] > clean[None, :]) > 0.85


def test_every_word_has_features():
    for word in ("a", "of", "the"):
        raw = np.frombuffer(word.encode(), np.uint8)
        assert sum(len(b) for b, _ in toxicity.features(raw, np.array([0, len(raw)], np.int64))) > 0

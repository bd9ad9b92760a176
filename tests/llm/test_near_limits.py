"""The pipeline's near-duplicate stage at its own limits, against brute force."""

import random

import corpus_pipeline

from folioscope.llm import jaccard_join

from .test_small import components, near_copies, rows


def between_limits(seed=3):
    """Pairs linked by five words and 0.8 that four words and 0.85 don't link: 100 words, and the same with 20 more."""
    rng = random.Random(seed)
    out = []
    for k in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(100 + k % 3)]
        out += [" ".join(words), " ".join(words + [f"m{rng.randint(0, 10**6)}" for _ in range(20)])]
    return list(enumerate(out))


def test_near_duplicate_stage(spark, table):
    data = between_limits() + [(1000 + i, t) for i, t in near_copies(8)]
    want = components(data, 5, 80)
    assert {c for _, _, c in want} < {c for _, _, c in components(data)}
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(data), "").collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})
    assert rows(jaccard_join.join(table(data), 5, 80)) == want

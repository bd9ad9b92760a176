"""What packing keeps in a worker isn't there any more when near duplicates are looked for."""

import numpy as np
import pyarrow as pa

from folioscope.llm import _tokens, jaccard_join


def test_words_are_forgotten():
    kept = lambda: _tokens.encoder.cache_info().currsize
    ids = _tokens.encoder(_tokens.default_path()).ids([b"one two", b"two three"])
    assert kept()
    assert [len(x) for x in (next(jaccard_join.Sets(2, {}).of(pa.array(["a b c"])))[1],)] == [1]
    assert not kept()
    assert _tokens.encoder(_tokens.default_path()).ids([b"one two", b"two three"]) == ids
    none = np.zeros(0, np.uint32).tobytes()
    table = {"bucket": [3], "once": [np.full(9, 7, np.uint32).tobytes()], "several": [none], "times": [none]}
    assert jaccard_join._count_bucket(pa.table(table)).to_pylist() == [{"key": 3 << 32 | 7, "n": 9}]
    assert not kept()

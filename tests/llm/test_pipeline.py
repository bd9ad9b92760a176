import random

from folioscope.llm import secrets

import corpus_pipeline

from .test_small import components, contaminated, measure, whole


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(25, 200))) for _ in range(60)]
    texts[3] = texts[2]
    texts[5] = texts[4] + " more"
    texts[7] = "### $$$ " * 60
    texts[9] = texts[9] + " token = abcdef123456"
    bench = " ".join(word() for _ in range(30))
    texts[11] = f"{texts[11]} {bench}"
    texts += ["", None, "short"]
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t, *_ in rows if t and measure(t)[0] >= 20 and 100 * measure(t)[4] <= 30 * measure(t)[0] and 100 * measure(t)[2] <= 10 * measure(t)[1]]
    kept = [(i, t) for i, t in kept if {c for d, _, c in components(kept) if d == i} == {i}]
    hit = {r[0] for r in contaminated(kept, [(1, bench)]) if r[2]}
    kept = [(i, secrets.redact(t, secrets.find(t)[1])) for i, t in kept if i not in hit]
    want = {i: len(ids) + 1 for (i, _), ids in zip(kept, whole([t for _, t in kept]), strict=True)}

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r.text for r in docs.collect()} == dict(kept)
    assert 11 not in want and 3 not in want and 7 not in want and "<assign>" in dict(kept)[9]
    got = {r.doc_id: r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_odd_tables(spark, tmp_path):
    """Null ids, ties, repeated rows, clashing columns and no rows at all, through every stage."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b, c, d = text(60), text(60), text(100), text(80)
    rows = [(None, a), (None, a), (None, b), (5, c), (5, c), (6, c + " more"), (None, c), (7, d), (8, None), (None, None), (9, "")]
    schema = "doc_id long, text string, node string, kept boolean, row int, n_words long, lang string"
    spark.createDataFrame([(i, t, "x", True, k, None, None) for k, (i, t) in enumerate(rows)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert got == sorted([(None, a), (None, b), (5, c), (7, d)], key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id) for r in packed)) == ["5", "7", "None", "None"]
    none = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, none, str(tmp_path))
        assert made.count() == 0

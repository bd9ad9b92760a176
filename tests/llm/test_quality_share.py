"""Repeated lines are judged against the length of the text."""

from folioscope.llm import quality_rules

import corpus_pipeline


def test_long_texts_with_a_few_repeated_lines(spark, table):
    own = [f"line {i} tells of thing {i * i} and of its place {i * 7} by the river" for i in range(400)]
    long = "\n".join(x + ("\n---" if i % 40 == 0 else "") for i, x in enumerate(own))
    few = "\n".join([f"word{i} other{i} third{i} fourth{i}" for i in range(12)] + ["the same line"] * 7)
    one = " ".join(f"w{i}" for i in range(30))
    data = [(1, long), (2, few), (3, one), (4, None)]
    found = {r.doc_id: r for r in quality_rules.ledger(table(data)).collect()}
    assert [found[i].n_lines for i in (1, 2, 3, 4)] == [410, 19, 1, 0] and found[1].n_dup_lines == 9 and found[2].n_dup_lines == 6
    kept = lambda version: {r.doc_id for r in quality_rules.filter_documents(table(data), version).collect()}
    assert kept("v1") == {3} and kept("v3") == {1, 3}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, table(data), "").collect()} == {1, 3}

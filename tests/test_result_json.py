"""Result JSON of long documents: pages are escaped one by one."""

import json

from pyspark.sql import functions as F

from folioscope import sinks
from folioscope.operators import summary


def pages_of(spark, rows):
    nothing = F.lit(None).cast("string")
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string")
    return pages.select("doc_id", "page", "text", F.lit("text").alias("method"), F.lit(0.0).alias("seconds"), F.length("text").cast("long").alias("chars"), F.lit(False).alias("cached"), nothing.alias("error"), nothing.alias("model"), nothing.alias("api_url"), nothing.alias("warning"))


def test_escapes_runs(spark, apply):
    texts = ["", "plain", "é", "aé", "éa", "naïve Ünï", "日本語 text 日", "\U0001f600\U0001f601é x \U0001f600", "\x7f\x80", "\U0010ffff", "퟿"]
    want = [json.dumps(t)[1:-1].replace('\\u007f', '\x7f') for t in texts]
    assert apply(sinks.ascii_escaped, texts) == want


def test_pages_in_order(spark):
    rows = [("a", 10, "zehn ü"), ("a", 2, 'zwei "é"\n'), ("a", 1, None), ("b", 1, "\U0001f600"), (None, 3, "kein Name")]
    pages = pages_of(spark, rows)
    got = {r.doc_id: r.json for r in sinks.result_json(pages, summary.run_summary(pages), {"who": "Jürgen"}).collect()}
    assert set(got) == {"a", "b", None} and all(x.isascii() for x in got.values())
    for name, text in got.items():
        told = json.loads(text)
        assert [(p["page"], p["text"], p["stats"]["page"]) for p in told["pages"]] == [(n, t or "", n) for d, n, t in sorted(rows, key=lambda r: r[1]) if d == name]
        assert told["config"] == {"who": "Jürgen"} and told["summary"]["total_pages"] == len(told["pages"])
    assert [r.json for r in sinks.result_json(pages.filter("doc_id = 'b'"), summary.run_summary(pages.filter("doc_id = 'a'")), {}).collect()] == [None]


def test_no_document_is_split_into_characters(spark):
    """What is worked out on whole documents neither parses nor splits them."""
    pages = pages_of(spark, [("a", k, "é" * 10) for k in range(5)])
    plan = sinks.result_json(pages, summary.run_summary(pages), {})._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Aggregate")]
    assert "split(" not in above and "to_json" not in above and "transform(" not in above

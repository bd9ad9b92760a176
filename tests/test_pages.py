import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import sinks
from folioscope.config import PRESETS, Config, ask, build_providers, decode_escapes, from_args, parse_keys, parse_urls, wizard
from folioscope.functions import lists, prompts, tables
from folioscope.operators import crosspage, hooks, images, layout, ocr, replacements, routing, summary
from folioscope.plans.pipeline import clean_pages, convert
from folioscope.sources import cache, pages as source
from folioscope.streaming import ingest

PARA = "This paragraph stands on every page of the report and has more than eighty characters in it."


def make(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i, x) for i, x in enumerate(texts, 1)], "doc_id string, page int, text string")


def texts(df):
    return [r.text for r in df.orderBy("doc_id", "page").collect()]


def test_ranges_and_lists(apply):
    assert apply(lists.page_ranges, ["2,20-21,34", "5-3", "0", "", None, "1 1,1"]) == [[2, 20, 21, 34], [3, 4, 5], [], [], [], [1]]
    assert routing.parse_pages("2,20-21, 34 5-3") == [2, 3, 4, 5, 20, 21, 34]
    with pytest.raises(ValueError):
        routing.parse_pages("x")
    assert apply(lambda c: lists.unique(lists.split_csv(c)), ["b, a,,b ", ""]) == [["b", "a"], []]


def test_thresholds(spark):
    got = spark.createDataFrame([(5,), (10,), (1,)], "n long").select(lists.threshold(F.col("n"), 0.6, 3).alias("t")).collect()
    assert [r.t for r in got] == [3, 6, 3]


def test_medians(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([2.0, 1.0],), ([],)], "a array<double>")
    assert [r.m for r in df.select(lists.median_of(F.col("a")).alias("m")).collect()] == [2.0, 1.5, 0.0]
    assert df.filter("false").agg(lists.median(F.col("a")[0]).alias("m")).first().m == 0.0


def test_headers_and_footers(spark):
    pages = make(spark, [f"Report A\nbody {i} x\nmore {chr(96 + i)}\nPage {i}" for i in range(1, 6)] + ["Report A\nReport A"])
    found = {(r.kind, r.sig): r.n for r in crosspage.detect_headers_footers(pages).collect()}
    assert found[("header", "report a")] == 7 and found[("footer", "page #")] == 5
    out = texts(crosspage.remove_headers_footers(pages, crosspage.detect_headers_footers(pages)))
    assert out[-1] == "" and all("Report" not in x and "Page" not in x for x in out) and out[0] == "more a"


def test_untouched_without_signatures(spark):
    pages = make(spark, [" a \n3\n"])
    none = spark.createDataFrame([], "doc_id string, kind string, sig string, n long")
    assert texts(crosspage.remove_headers_footers(pages, none, page_numbers=False)) == [" a \n3\n"]
    assert texts(crosspage.remove_headers_footers(pages, none)) == ["a"]


def test_dedupe(spark):
    short = "x" * 79
    pages = make(spark, [f"{PARA}\n\n{short}\n\nown {i}" for i in range(3)] + [PARA + "\n\n" + PARA])
    out = crosspage.dedupe_paragraphs(pages)
    assert texts(out) == [f"{short}\n\nown {i}" for i in range(3)] + [""]
    assert [r.n_removed for r in out.orderBy("page").collect()] == [1, 1, 1, 2]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, page int, text string")
    assert clean_pages(none).count() == 0 and crosspage.dedupe_paragraphs(none).count() == 0


def test_replacements(apply):
    rules = replacements.parse_rules("# c\n\na=>b->c\nx -> y\nq\tr\nnone\n")
    assert rules == [("a", "b->c"), ("x", "y"), ("q", "r")]
    plain = lambda c: replacements.apply_rules(c, [("a", "b"), ("b", "$1\\")])
    assert apply(plain, ["ab"]) == ["$1\\$1\\"]
    assert apply(lambda c: replacements.apply_rules(c, [("The", "$x")], "word", True), ["the then THE"]) == ["$x then $x"]
    assert apply(lambda c: replacements.apply_rules(c, [("a.b", r"x\ny")], "plain", True), ["A.B aXb"]) == ["x\ny aXb"]


def test_tables(spark):
    df = spark.createDataFrame([([["a", " b "], ["1"]],), ([],), (None,)], "t array<array<string>>")
    got = [r.m for r in df.select(tables.table_markdown(F.col("t")).alias("m")).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| 1 |  |", "", ""]
    head = df.limit(1).select(tables.table_markdown(F.col("t"), False).alias("m")).first().m
    assert head.startswith("| col1 | col2 |\n| --- | --- |\n| a | b |")


def test_prompts(spark):
    df = spark.range(1).select(prompts.prompt(F.lit(3), F.lit("zh")).alias("a"), prompts.prompt(F.lit(3), F.lit(None)).alias("b"), prompts.prompt(F.lit(3), F.lit("zh"), " {page}/{language}/{x} ").alias("c")).first()
    assert "Language hint: zh\n" in df.a and "hint" not in df.b and df.c == "3/zh/{x}"
    assert df.a == ocr.prompt_text(3, "zh") and df.b == ocr.prompt_text(3) and df.c == ocr.prompt_text(3, "zh", " {page}/{language}/{x} ")


def test_merge_and_files(spark):
    pages = make(spark, ["one", "", "three"])
    want = "# T\n\n## Page 1\n\none\n\n\n---\n\n## Page 2\n\n\n\n---\n\n## Page 3\n\nthree\n"
    assert sinks.merge_pages(pages, title="T").first().markdown == want
    files = {r.name: r.content for r in sinks.page_files(pages, "## Page {page}").collect()}
    assert files == {"page_01.md": "## Page 1\n\none\n", "page_02.md": "## Page 2\n", "page_03.md": "## Page 3\n\nthree\n"}


def test_written_files(spark, tmp_path):
    sinks.write_merged(make(spark, ["é"]), str(tmp_path / "m"))
    assert "é" in "".join(p.read_text() for p in (tmp_path / "m").rglob("*.txt"))
    sinks.write_page_files(make(spark, ["a\nb"]), str(tmp_path / "p"))
    assert [p.read_text() for p in (tmp_path / "p").rglob("*.txt")] == ["a\nb\n"]


def test_json(spark):
    import json

    pages = make(spark, ["é𝄞\"", "b"]).selectExpr("*", "'text' method", "0D seconds", "1L chars", "false cached", "CAST(NULL AS STRING) error", "CAST(NULL AS STRING) model", "CAST(NULL AS STRING) api_url", "CAST(NULL AS STRING) warning")
    whole = sinks.result_json(pages, summary.run_summary(pages), {"k": "é"}).first().json
    assert whole.isascii()
    got = json.loads(whole)
    assert [p["text"] for p in got["pages"]] == ["é𝄞\"", "b"] and got["pages"][0]["stats"]["error"] is None and got["summary"]["total_pages"] == 2 and got["config"]["k"] == "é"
    stats = json.loads(sinks.stats_json(pages, summary.run_summary(pages), {}).first().json)
    assert stats["selected_pages"] == [1, 2] and stats["pages"][0]["warning"] is None


def test_routing(spark):
    good = "word word word word. " * 20
    pages = make(spark, [good, "x", good, "y"])
    known = spark.createDataFrame([("d", 1, None), ("d", 4, "timeout")], "doc_id string, page int, error string")
    plan = lambda **k: [r.plan for r in routing.route(pages, known, **k).orderBy("page").collect()]
    assert plan() == ["text", "ocr", "text", "ocr"]
    assert plan(resume=True) == ["cached", "ocr", "text", "cached"]
    assert plan(resume=True, retry_failed=True) == ["cached", "ocr", "text", "ocr"]
    assert plan(mode="text") == ["text"] * 4 and plan(mode="ocr") == ["ocr"] * 4
    assert [r.page for r in routing.pending(pages, known, True).orderBy("page").collect()] == [2, 3, 4]
    assert [r.page for r in routing.select_pages(pages, "3-1", "2").orderBy("page").collect()] == [1, 3]
    with pytest.raises(RuntimeError):
        routing.require_pages(routing.select_pages(pages, "9"))
    picked = pages.withColumn("inc", F.lit("1-2")).withColumn("skip", F.lit("2"))
    assert [r.page for r in routing.select_by_column(picked, F.col("inc"), F.col("skip")).collect()] == [1]


def test_summary_of_failures(spark):
    stats = spark.createDataFrame([("d", '{"summary":{"error_pages":[3,1,3]},"pages":[]}'), ("e", '{"summary":{"error_pages":[]},"pages":[{"page":2,"stats":{"error":"x"}},{"page":4,"stats":{"error":null}}]}')], "doc_id string, stats string")
    assert sorted((r.doc_id, r.page) for r in routing.failed_in_stats(stats).collect()) == [("d", 1), ("d", 3), ("e", 2)]


def words_page(spark, words, chars=(), height=100.0):
    row = ("d", 1, 600.0, height, [(w, float(a), float(a) + 50, float(y), float(y) + 10) for w, a, y in words], [(float(s), float(y)) for s, y in chars])
    return spark.createDataFrame([row], layout.GEOMETRY)


def test_line_blocks(spark):
    page = words_page(spark, [("b", 60, 11.0), ("a", 0, 10.0), ("c", 0, 30.0), ("d", 10, 32.9), ("e", 0, 33.1)], [(9, 21), (11, 21.5), (20, 70)])
    got = page.select(layout.line_blocks(F.col("words"), F.col("chars")).alias("b")).first().b
    assert [b.text for b in got] == ["a b", "c d", "e"] and (got[0].top, got[0].bottom, got[0].size, got[1].size) == (10.0, 21.0, 10.0, 11.0)
    assert words_page(spark, []).select(layout.line_blocks(F.col("words"), F.col("chars")).alias("b")).first().b == []


def test_columns(spark):
    two = words_page(spark, [(str(i), 0 if i % 2 else 400, i) for i in range(20)])
    got = two.select(layout.decide_layout(F.col("words"), F.col("width")).alias("d")).first().d
    assert got.mode == "columns" and abs(got.split_ratio - (50 + 400) / 2 / 600) < 1e-9
    one = words_page(spark, [("a", 0, 1)])
    assert one.select(layout.decide_layout(F.col("words"), F.col("width")).alias("d")).first().d.mode == "single"
    assert one.select(layout.decide_layout(F.col("words"), F.col("width"), "columns").alias("d")).first().d.split_ratio == 0.5


def test_images():
    assert images.otsu(np.full((4, 4), 9, np.uint8)) == 127
    gray = np.full((90, 60), 255, np.uint8)
    gray[10:20], gray[60:70] = 0, 0
    assert images.otsu(gray) == 0 and images.binarize(gray).min() == 255  # a pixel at the threshold is white
    gray[10:20, :55] = gray[60:70, :55] = 40
    gray[10:20, 55:] = gray[60:70, 55:] = 60
    assert images.otsu(gray) == 60 and set(np.unique(images.binarize(gray))) == {0, 255}
    assert images.split_blocks(gray) == [(10, 20), (60, 70)] and images.split_blocks(np.zeros((9, 9), np.uint8)) == [(0, 9)]
    assert images.contrast(gray, 1.0) is gray and images.denoise(gray, 1) is gray and images.denoise(gray).shape == gray.shape
    tilted = images.rotate(gray, -1.5)
    assert images.skew_angle(tilted) == 1.5 and images.skew_angle(gray) == 0.0
    assert images.limited_side(4000, 3000, 2000, 3_000_000) == 1000 and images.limited_side(10, 10, 2000, 100) == 2000
    assert [p.shape for p in images.split_columns(gray, 0.5)] == [(90, 31), (90, 31)]
    assert images.data_url(gray, 45).startswith("data:image/png;base64,") and images.preprocess(gray, enabled=False) is gray
    assert set(np.unique(images.preprocess(gray))) <= {0, 255}


def test_images_in_tables(spark):
    gray = np.arange(6, dtype=np.uint8).reshape(2, 3)
    df = spark.createDataFrame([("d", 3, 2, bytearray(gray.tobytes())), ("e", 1, 1, None)], "doc_id string, width int, height int, pixels binary")
    got = {r.doc_id: r.m for r in images.map_images(df, lambda g: int(g.sum()), "m", "long").collect()}
    assert got == {"d": 15, "e": None}


class Service:
    """Replies in turn, and what was asked."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def __call__(self, url, key, payload, timeout):
        self.asked.append((url, payload["model"], len(payload["messages"])))
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r


def answer(text, finish="stop"):
    return ocr.Reply(200, {"choices": [{"message": {"content": text}, "finish_reason": finish}]})


LONG = "Readable text of a page. " * 8


def reader(service, **k):
    return ocr.Reader((ocr.Provider("u1", "k"), ocr.Provider("u2", "k")), ("m1", "m2"), service, sleep=lambda s: None, **k)


def test_reading():
    s = Service(answer(LONG, "length"), answer("rest"))
    assert reader(s).call("data:", 1) == (LONG.strip() + "\nrest", "m1", "u1") and [a[2] for a in s.asked] == [1, 3]
    s = Service(answer("bad"), answer(LONG))
    assert reader(s).call("data:", 1)[1] == "m2"
    s = Service(ocr.Reply(429, {}, "busy", "0.5"), TimeoutError("slow"), answer(LONG))
    assert reader(s).call("data:", 1)[2] == "u1"
    s = Service(*[ocr.Reply(401, {}, "no")] * 4)
    with pytest.raises(RuntimeError, match="401"):
        reader(s).call("data:", 1)
    assert len(s.asked) == 4  # a refusal is not tried again


def test_page_results():
    s = Service(*[answer("bad")] * 4, answer(LONG))
    got = reader(s).page(7, lambda high: ["fine" if high else "coarse"], finer=True)
    assert got["method"] == "ocr" and got["model"] == "m1"
    bad = reader(Service(*[answer("bad")] * 40), page_retries=2).page(7, lambda high: ["x"])
    assert bad["method"] == "error" and bad["text"].startswith("[Error processing page 7: OCR failed after 2 retries") and "quality check failed" in bad["error"]


def test_limiter():
    now, slept = [0.0], []
    limit = ocr.RateLimiter(2.0, clock=lambda: now[0], sleep=slept.append)
    limit.wait(), limit.wait()
    assert slept == [0.5]
    for _ in range(9):
        limit.backoff()
    assert limit.pause == 10.0


def test_crops():
    gray = np.full((90, 60), 255, np.uint8)
    assert len(ocr.crops(gray, "columns")) == 2 and len(ocr.crops(gray)) == 1
    with pytest.raises(RuntimeError):
        ocr.crops(gray, max_pixels=10, skip_large=True)


def test_hooks(spark):
    pages = make(spark, ["a"]).withColumn("method", F.lit("text"))
    assert texts(hooks.apply_hook(pages, "tr a-z A-Z", "pre")) == ["A"]
    assert texts(hooks.apply_hook(pages, lambda t, about: f"{t}{about['page']}{about['stage']}", "post")) == ["a1post"]
    assert hooks.run_hook("false", "x", {"doc_id": 1, "page": 1, "method": "t", "stage": "pre"}, True) == "x"
    with pytest.raises(RuntimeError):
        hooks.run_hook("false", "x", {"doc_id": 1, "page": 1, "method": "t", "stage": "pre"})
    assert hooks.run_hook("printenv PAGE_NUMBER", "", {"doc_id": 1, "page": 4, "method": "t", "stage": "pre"}) == "4"


def test_pdf_source(spark, tmp_path):
    def fake_pdf(content, wanted):
        for n, text in enumerate(content.decode().split("|"), 1):
            if not wanted or n in wanted:
                yield n, text or None

    (tmp_path / "a.pdf").write_bytes(b"one||three ")
    got = source.read_pdfs(spark, str(tmp_path), fake_pdf, "2-3").orderBy("page").collect()
    assert [(r.page, r.text) for r in got] == [(2, ""), (3, "three")]


def test_rendering_and_tables(spark):
    files = spark.createDataFrame([("d", bytearray(b"x"))], "doc_id string, content binary")
    wanted = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page int")

    def render(content, page, dpi):
        if page == 2:
            raise RuntimeError("no")
        return np.zeros((2, 3), np.uint8)

    first = source.render_pages(files, wanted, render)
    rows = {r.page: r for r in first.collect()}
    assert (rows[1].width, rows[1].height, len(rows[1].pixels)) == (3, 2, 6) and "no image of page 2" in rows[2].error
    again = source.render_or_reuse(files, wanted.filter("page = 1"), lambda *a: 1 / 0, first)
    assert again.first().width == 3
    finer = source.render_or_reuse(files, wanted.filter("page = 1"), lambda *a: np.ones((1, 1), np.uint8), first, dpi=450)
    assert finer.first().width == 1

    def broken(content, page):
        raise ImportError

    got = source.extract_tables(files, wanted, [("a", broken), ("b", lambda c, p: [[["x"]]] if p == 1 else [])]).orderBy("page").collect()
    assert [(r.backend, r.tables) for r in got] == [("b", [[["x"]]]), ("b", [])]
    assert [n for n, _ in source.backends()] == ["camelot", "tabula"]


def test_cache(spark, tmp_path):
    path = str(tmp_path / "c")
    assert cache.read_cache(spark, path, "s").count() == 0
    cache.write_cache(make(spark, ["a  ", None]), path, "s")
    cache.write_cache(make(spark, ["new"]), path, "s")
    cache.write_cache(make(spark, ["other"]), path, "other")
    assert texts(cache.read_cache(spark, path, "s")) == ["new", ""]
    stats = summary.stats_from_meta(cache.read_cache(spark, path, "s")).orderBy("page").collect()
    assert (stats[0].method, stats[0].chars, stats[0].cached) == ("cached", 3, True)


def test_conversion(spark, tmp_path):
    read = LONG

    def read_or_fail(url, key, payload, timeout):  # nested, so that it travels by value
        image = payload["messages"][0]["content"][0]["image_url"]["url"]
        body = {"choices": [{"message": {"content": read}, "finish_reason": "stop"}]}
        return ocr.Reply(200, body) if image == "scan" else ocr.Reply(500, {}, "down")

    good = "word word word word. " * 20
    pages = make(spark, [f"Head\n{good}\nend {i}" for i in range(4)] + ["scan", "scan too"])
    path = str(tmp_path / "cache")
    config = Config(page_retries=1, hf_use_layout=False)
    with pytest.raises(RuntimeError):
        convert(spark, pages, config, path + "x")
    answered = ocr.Reader((ocr.Provider("u", "k"),), ("m",), read_or_fail, sleep=lambda s: None, page_retries=1, retries=1)
    out = convert(spark, pages, config, path, answered, lambda row, high: [row["text"]])
    rows = out.pages.orderBy("page").collect()
    assert [r.method for r in rows] == ["text"] * 4 + ["ocr", "error"] and "Head" not in rows[0].text
    told = out.summary.first()
    assert (told.text_pages, told.ocr_pages, told.error_pages) == (4, 1, [6])
    again = convert(spark, pages, Config(page_retries=1, resume=True, hf_use_layout=False), path, None)
    assert again.summary.first().cached_pages == 6
    plan = convert(spark, pages, Config(dry_run=True), path + "y")
    assert {(r.plan, r.n) for r in plan.summary.collect()} == {("text", 4), ("ocr", 2)}
    merged = out.merged().first().markdown
    assert merged.count("## Page") == 6


def test_config():
    where, c = from_args(["in", "--preset", "economy", "--max-retries", "7", "--no-reflow", "--separator", r"\n==\n", "--no-title"])
    assert (where, c.max_retries, c.page_retries, c.reflow, c.separator, c.include_title) == ("in", 7, 1, False, "\n==\n", False)
    assert set(PRESETS) == {"fast-text", "balanced-ocr", "scan-ocr", "table-heavy", "economy"}
    calm = from_args(["in", "--deterministic", "--temperature", "1"])[1]
    assert (calm.temperature, calm.ocr_workers, calm.page_retries) == (0.0, 1, 1)
    assert decode_escapes(r"a\tb\\nA") == "a\tb\\nA"
    assert parse_urls("a", "b, a") == ["a", "b"] and parse_keys("k", "", 2) == ["k", "k"] and parse_keys(None, "", 1) == [None]
    with pytest.raises(ValueError):
        parse_keys("a,b", "", 3)
    assert [p.url for p in build_providers(["a", "b"], ["k", None])] == ["a"]
    shown = Config(api_key="secret").snapshot()
    assert "secret" not in str(shown)
    answers = iter(["nope", "ocr", "", "", "", "", ""])
    assert wizard(lambda q: next(answers), True)["mode"] == "ocr"
    assert ask("q", ("a", "b"), "b", lambda q: "") == "b"
    with pytest.raises(SystemExit):
        wizard(interactive=False)


def test_command_line(spark, tmp_path):
    from folioscope.cli import main

    make(spark, ["word word word word. " * 20, "b"]).write.parquet(str(tmp_path / "in"))
    assert main([str(tmp_path / "in"), "--mode", "text", "--out", str(tmp_path / "o"), "--json-out", str(tmp_path / "j"), "--stats-out", str(tmp_path / "s"), "--config-out", str(tmp_path / "k"), "--per-page-dir", str(tmp_path / "p"), "--quiet"], spark) == 0
    assert all((tmp_path / x).exists() for x in "ojskp")


def test_stream(spark, tmp_path):
    make(spark, ["word word word word. " * 20, "b"]).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "k")).awaitTermination()
    got = ingest.ingested(spark, str(tmp_path / "c")).orderBy("page").collect()
    assert [r.method for r in got] == ["text", "unknown"]
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_reading_scans_from_the_command_line(spark, tmp_path):
    """Files in, Markdown out: text layers, two-column scans, tables, a prompt file, retries from statistics."""
    from folioscope.cli import Adapters, main

    good, read = "word word word word. " * 20, LONG
    asked = tmp_path / "asked"
    asked.mkdir()

    def pdf_text(content, wanted):
        for n, text in enumerate(content.decode().split("|"), 1):
            if not wanted or n in wanted:
                yield n, text

    def words(content, wanted):
        for n, text in enumerate(content.decode().split("|"), 1):
            columns = [{"text": "w", "x0": 10.0 if k % 2 else 60.0, "x1": 40.0 if k % 2 else 90.0, "top": 10.0 * k, "bottom": 10.0 * k + 8} for k in range(24)]
            yield n, 100.0, 300.0, columns if text == "two" else columns[:2], [{"size": 9.0, "top": 1.0}]

    def render(content, page, dpi):
        if page == 5:
            raise RuntimeError("torn")
        return np.full((dpi // 10, 40, 3), 255, np.uint8)

    def serve(url, key, payload, timeout):  # nested, so that it travels by value
        import uuid

        told = payload["messages"][0]["content"]
        (asked / uuid.uuid4().hex).write_text(f"{payload['model']} {payload['max_tokens']} {told[0]['image_url']['detail']} {told[0]['image_url']['url'][:15]} {told[1]['text']}")
        return ocr.Reply(200, {"choices": [{"message": {"content": read}, "finish_reason": "stop"}]})

    def grid(content, page):
        return [[["a", "b"], ["1", "2"]]] if page == 4 else []

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_bytes(f"{good}|scan|two|table|torn".encode())
    (tmp_path / "prompt").write_text("  Read page {page}. \n")
    use = Adapters(pdf_text, words, render, [("grid", grid)], serve)
    flags = ["--source", "pdf", "--api-url", "u", "--api-key", "k", "--model", "m", "--max-tokens", "99", "--detail", "low", "--table-mode", "auto", "--page-retries", "1", "--dpi", "200", "--quiet"]
    files = ["--out", str(tmp_path / "o"), "--json-out", str(tmp_path / "j"), "--stats-out", str(tmp_path / "s"), "--prompt-file", str(tmp_path / "prompt"), "--cache-dir", str(tmp_path / "c")]
    assert main([str(tmp_path / "in"), *flags, *files, "--cache-images"], spark, use) == 0
    row = spark.read.json(str(tmp_path / "s")).first()
    import json

    told = json.loads(row.json)
    assert [p["method"] for p in told["pages"]] == ["text", "ocr", "ocr", "table", "error"] and told["summary"]["error_pages"] == [5]
    sent = sorted(x.read_text() for x in asked.iterdir())
    assert sent == ["m 99 low data:image/png; Read page 2.", *["m 99 low data:image/png; Read page 3."] * 2]  # two columns are two images
    markdown = next((tmp_path / "o").rglob("*.txt")).read_text()
    assert "| a | b |" in markdown and markdown.count(read.strip()) == 3 and "Error processing page 5" in markdown
    assert spark.read.parquet(str(tmp_path / "c.images")).filter("pixels IS NOT NULL").count() == 2
    mended = Adapters(pdf_text, words, lambda content, page, dpi: np.full((9, 9), 255, np.uint8), [("grid", grid)], serve)
    again = [str(tmp_path / "in"), *flags, *files[:2], "--stats-out", str(tmp_path / "s2"), *files[6:], "--retry-failed-from", str(tmp_path / "s")]
    assert main(again, spark, mended) == 0 and len(list(asked.iterdir())) == 4
    assert [p["method"] for p in json.loads(spark.read.json(str(tmp_path / "s2")).first().json)["pages"]] == ["text", "ocr", "ocr", "table", "ocr"]


def test_hooks_run_once(spark, tmp_path):
    log = tmp_path / "log"
    pages = make(spark, ["word word word word. " * 20] * 3)
    out = convert(spark, pages, Config(mode="text", pre_hook=f"tee -a {log}"), str(tmp_path / "c"))
    assert out.summary.first().total_pages == 3 and out.pages.count() == 3 and log.read_text().count("word. ") + log.read_text().count("word.") >= 3
    assert len(log.read_bytes()) == 3 * len(("word word word word. " * 20).strip())


def test_every_setting_is_read():
    import dataclasses
    from pathlib import Path

    import folioscope

    code = "\n".join(p.read_text() for p in Path(folioscope.__file__).parent.rglob("*.py") if "llm" not in p.parts)
    unread = [f.name for f in dataclasses.fields(Config) if f"c.{f.name}" not in code and f"self.{f.name}" not in code]
    assert not unread


def test_coloured_images():
    image = np.random.default_rng(3).integers(0, 256, (30, 20, 3), dtype=np.uint8)
    assert images.to_gray(image).shape == (30, 20) and (images.to_gray(np.repeat(image[..., :1], 3, axis=2)) == image[..., 0]).all()
    assert images.preprocess(image).ndim == 2 and images.preprocess(image, black_white=False, straighten=False).shape == image.shape
    assert images.shrink(image, 15)[0].shape == (15, 10, 3) and images.rotate(image, 90.0).shape == (20, 30, 3)
    assert images.png(image)[25] == 2 and (images.from_row(image.tobytes(), 20, 30) == image).all()
    look = images.Look(max_pixels=100, min_side=5, blocks=True)
    assert len(look.urls(image, 0.5)) == 2 and len(look.urls(image)) == 1
    with pytest.raises(RuntimeError):
        images.Look(max_pixels=100, skip_large=True).urls(image)


def test_page_headers(spark):
    head = lambda template, page: spark.range(1).select(sinks.page_header(template, F.lit(page)).alias("h")).first().h
    assert [head("## {page}", 7), head("{page:03d}/{page}", 7), head("{page:3}", 7), head("{page:02d}", 123), head("{{x}} {page:d}", 7)] == ["## 7", "007/7", "  7", "123", "{x} 7"]


def test_numbered_pages(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 3, "w"), ("b", None, "n"), ("b", 2, "m"), (None, 1, "z")], "d string, o int, t string")
    got = {(r.doc_id, r.page, r.text) for r in source.number_pages(rows, "d", "o", "t").collect()}
    assert got == {("a", 1, "y"), ("a", 2, "w"), ("a", 3, "x"), ("b", 1, "n"), ("b", 2, "m"), (None, 1, "z")}

"""Queries over the driver's tables, one for each operator family, with DuckDB SQL.

Most read ``paged``: all documents, each source taken as one document of many
pages, with page furniture put in by rule so that every operator has work to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import Config
from ..functions import lists, prompts, tables
from ..functions import text as t
from ..operators import crosspage, layout, reflow, replacements, routing, summary
from ..sources.pages import number_pages
from .pipeline import clean_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOTE = "This page is provided for information only and may change without notice at any time, copy "


def query(sql: str = ""):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    numbered = number_pages(docs.withColumn("both", F.struct("doc_id", "text")), "source", "doc_id", "both")
    pg, five = F.col("page"), F.col("page") % 5
    head = (
        F.when(five == 0, F.concat(F.lit("1."), (pg % 7).cast("string"), F.lit(" Overview\n")))
        .when(five == 1, F.concat(F.lit("Chapter "), (pg % 9 + 1).cast("string"), F.lit("\n")))
        .when(five == 2, "- item one\n- item two\n")
        .when(five == 3, "```\nx  = 1\n```\n")
        .otherwise("")
    )
    body = F.regexp_replace(F.col("text.text"), "([a-z]{4})([a-z]{3}) ", "$1-\n$2 ")
    text = F.concat(
        F.lit("Report "), F.col("doc_id"), F.lit(" vol "), pg.cast("string"), F.lit("\n"), head, body,
        F.lit(f"\n\n{NOTE}"), F.col("text.doc_id").cast("string"), F.lit(" of the series.\n\nPage "), pg.cast("string"),
    )
    return numbered.select("doc_id", "page", text.alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


_FAULTS = ("OCR quality check failed: ", "no answer: ", "ocr QUALITY check failed by ")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page statistics: users are documents, events their pages."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    method = F.element_at(F.array(*map(F.lit, ("text", "ocr", "table", "error"))), (F.col("event_id") % 4 + 1).cast("int"))
    return rows.select(
        (F.col("user_id") % 97).cast("string").alias("doc_id"), F.col("event_id").cast("int").alias("page"), method.alias("method"),
        (F.col("event_id") % 1000 / 8).alias("seconds"), (F.col("event_id") * 3).alias("chars"), (F.col("event_id") % 5 == 0).alias("cached"),
        F.when(F.col("event_id") % 4 == 3, F.concat(F.element_at(F.array(*map(F.lit, _FAULTS)), (F.col("event_id") % 3 + 1).cast("int")), "event_type")).alias("error"),
        F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("api_url"), F.lit(None).cast("string").alias("warning"),
    )


_EVENTS = """
ev AS (SELECT CAST(user_id % 97 AS VARCHAR) AS doc_id, CAST(event_id AS INT) AS page, ['text', 'ocr', 'table', 'error'][CAST(event_id % 4 + 1 AS INT)] AS method,
  CAST(event_id % 1000 AS DOUBLE) / 8 AS seconds, event_id * 3 AS chars, event_id % 5 = 0 AS cached,
  CASE WHEN event_id % 4 = 3 THEN ['OCR quality check failed: ', 'no answer: ', 'ocr QUALITY check failed by '][CAST(event_id % 3 + 1 AS INT)] || event_type END AS error FROM events)"""

# --- pieces of DuckDB SQL -------------------------------------------------------

_W = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_NW = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
_WL = r"[\t\x0b\f\r \x1c-\x1f\x85\p{Z}]"


def _sub(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern}', {by}, 'g')"


def _strip(x: str) -> str:
    return _sub(x, rf"\A{_W}+|{_W}+\z")


def _norm(x: str) -> str:
    x = _sub(_sub(x, r"\r\n?", "chr(10)"), r"\n{3,}", "chr(10) || chr(10)")
    return _strip(_sub(x, rf"(?m){_WL}+$"))


def _lines(x: str) -> str:
    return rf"(CASE WHEN {x} = '' THEN [] ELSE regexp_split_to_array({x}, '[\n\x0b\f\x1c-\x1e\x85\x{{2028}}\x{{2029}}]') END)"


def _sig(x: str) -> str:
    return f"lower({_sub(_sub(_strip(x), f'{_W}+', chr(39) + ' ' + chr(39)), r'\p{Nd}+', chr(39) + '#' + chr(39))})"


_D, _S = r"\p{Nd}+", _W + "*"
_PAGENO = "|".join((rf"(page{_S})?{_D}({_S}/{_S}{_D})?", rf"{_D}{_S}(of|/|\\){_S}{_D}", "[ivxlcdm]+", rf"第{_S}{_D}{_S}页", rf"第{_S}{_D}{_S}/{_S}{_D}{_S}页"))


def _is_pageno(x: str) -> str:
    return rf"regexp_matches(lower({_strip(x)}), '\A(?:{_PAGENO})\z')"


def _is_block(x: str) -> str:
    return rf"(regexp_matches({x}, '\A{_W}*(?:[#>|]|```|[-*_]{{3,}}{_W}*\z|(?:[-*+]|{_D}[.)]){_W})|\A{_W}{{4,}}{_NW}') AND {_strip(x)} <> '')"


_PAGED = rf"""
d AS (SELECT source, doc_id, text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS pg FROM documents),
paged AS (SELECT source AS doc_id, pg AS page, concat('Report ', source, ' vol ', CAST(pg AS VARCHAR), chr(10),
  CASE WHEN pg % 5 = 0 THEN concat('1.', CAST(pg % 7 AS VARCHAR), ' Overview', chr(10)) WHEN pg % 5 = 1 THEN concat('Chapter ', CAST(pg % 9 + 1 AS VARCHAR), chr(10))
    WHEN pg % 5 = 2 THEN concat('- item one', chr(10), '- item two', chr(10)) WHEN pg % 5 = 3 THEN concat('```', chr(10), 'x  = 1', chr(10), '```', chr(10)) ELSE '' END,
  regexp_replace(text, '([a-z]{{4}})([a-z]{{3}}) ', concat('\1-', chr(10), '\2 '), 'g'), chr(10), chr(10), '{NOTE}', CAST(doc_id AS VARCHAR), ' of the series.', chr(10), chr(10), 'Page ', CAST(pg AS VARCHAR)) AS text FROM d)"""
_NORMED = rf"{_PAGED}, np AS (SELECT doc_id, page, {_norm('text')} AS text FROM paged)"
_LINED = rf"{_NORMED}, ln AS (SELECT doc_id, page, unnest({_lines('text')}) AS line, generate_subscripts({_lines('text')}, 1) AS i FROM np)"

# --- scalar functions -----------------------------------------------------------


@query(f"WITH {_PAGED} SELECT doc_id, page, {_norm('text')} AS text FROM paged")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark, sf_dir).select("doc_id", "page", t.normalize(F.col("text")).alias("text"))


def _metric_sql(x: str) -> str:
    n = f"greatest(len({_lines(x)}), 1)"
    return rf"""length({x}) AS total_chars, length(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')) / CAST(greatest(length({x}), 1) AS DOUBLE) AS alnum_ratio,
  coalesce(list_sum(list_transform({_lines(x)}, lambda v: length(v))), 0) / CAST({n} AS DOUBLE) AS avg_line_len, len(list_filter({_lines(x)}, lambda v: {_strip('v')} = '')) / CAST({n} AS DOUBLE) AS blank_ratio"""


_ROUNDED = ("alnum_ratio", "avg_line_len", "blank_ratio")
_METRICS = f"{_NORMED}, m AS (SELECT doc_id, page, text, {_metric_sql('text')} FROM np)"


@query(f"WITH {_METRICS} SELECT doc_id, page, CAST(total_chars AS INT) AS total_chars, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM m")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = crosspage.computed(paged(spark, sf_dir), m=t.text_metrics(F.col("text")))
    return m.select("doc_id", "page", "m.total_chars", *[F.round(f"m.{c}", 6).alias(c) for c in _ROUNDED])


_GATE = "total_chars >= 200 AND alnum_ratio >= CAST(0.25 AS DOUBLE) AND NOT (avg_line_len < 12 AND total_chars < 400) AND blank_ratio <= CAST(0.6 AS DOUBLE)"


@query(f"WITH nd AS (SELECT doc_id, {_norm('text')} AS text FROM documents), m AS (SELECT doc_id, {_metric_sql('text')} FROM nd) SELECT doc_id, CAST(total_chars AS INT) AS total_chars, round(alnum_ratio, 6) AS alnum_ratio, {_GATE} AS accepted FROM m")
def meaningful_text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = crosspage.computed(_documents(spark, sf_dir), m=t.text_metrics(F.col("text")))
    return docs.select("doc_id", "m.total_chars", F.round("m.alnum_ratio", 6).alias("alnum_ratio"), t.meaningful(F.col("text"), metrics=F.col("m")).alias("accepted"))


_SCRIPTS = r"""s AS (SELECT doc_id, substr(coalesce(text, ''), 1, 1000) AS h FROM documents),
c AS (SELECT doc_id, length(regexp_replace(h, '[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]', '', 'g')) AS z, length(regexp_replace(h, '[^\x{0400}-\x{04FF}]', '', 'g')) AS r, length(regexp_replace(h, '[^A-Za-z]', '', 'g')) AS l FROM s)"""


@query(f"WITH {_SCRIPTS} SELECT doc_id, CASE WHEN z + r + l = 0 THEN '' WHEN 10 * z >= 4 * (z + r + l) THEN 'zh' WHEN 10 * r >= 4 * (z + r + l) THEN 'ru' WHEN 10 * l >= 4 * (z + r + l) THEN 'en' ELSE '' END AS language FROM c")
def language_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", t.language_hint(F.col("text")).alias("language"))


def _ocr_sql(x: str) -> str:
    n = f"CAST(greatest(length({x}), 1) AS DOUBLE)"
    return rf"""length({x}) AS total_chars, length(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')) / {n} AS alnum_ratio, length(regexp_replace({x}, '[\p{{L}}\p{{N}}]|{_W}', '', 'g')) / {n} AS symbol_ratio,
  (length({x}) - length(regexp_replace({x}, '[\x{{FFFD}}\x{{25A1}}]', '', 'g')) + (length({x}) - length(replace({x}, '[??]', ''))) / 4) / {n} AS replacement_ratio"""


#: Whole pages, some with unreadable marks put in by rule.
_MARKED = f"{_NORMED}, mk AS (SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN replace(text, 'the ', '[??] ') WHEN page % 3 = 1 THEN regexp_replace(text, '[a-z]', '#', 'g') ELSE text END AS text FROM np), om AS (SELECT doc_id, page, {_ocr_sql(_norm('text'))} FROM mk)"
_OCR = ("alnum_ratio", "symbol_ratio", "replacement_ratio")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page") % 3
    text = t.normalize(F.col("text"))
    return paged(spark, sf_dir).withColumn("text", F.when(page == 0, F.replace(text, F.lit("the "), F.lit("[??] "))).when(page == 1, F.regexp_replace(text, "[a-z]", "#")).otherwise(text))


@query(f"WITH {_MARKED} SELECT doc_id, page, CAST(total_chars AS INT) AS total_chars, {', '.join(f'round({c}, 6) AS {c}' for c in _OCR)} FROM om")
def ocr_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = crosspage.computed(_marked(spark, sf_dir), m=t.ocr_metrics(F.col("text")))
    return m.select("doc_id", "page", "m.total_chars", *[F.round(f"m.{c}", 6).alias(c) for c in _OCR])


_REASON = "CASE WHEN total_chars < 80 THEN 'total_chars<80' WHEN alnum_ratio < CAST(0.2 AS DOUBLE) THEN 'alnum_ratio<0.2' WHEN symbol_ratio > CAST(0.6 AS DOUBLE) THEN 'symbol_ratio>0.6' WHEN replacement_ratio > CAST(0.02 AS DOUBLE) THEN 'replacement_ratio>0.02' ELSE '' END"


@query(f"WITH {_MARKED} SELECT doc_id, page, {_REASON} = '' AS ok, {_REASON} AS reason FROM om")
def ocr_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspage.computed(_marked(spark, sf_dir), m=t.ocr_metrics(F.col("text"))).select("doc_id", "page", t.ocr_ok(F.col("text"), metrics=F.col("m")).alias("g")).select("doc_id", "page", "g.ok", "g.reason")


@query(rf"WITH {_PAGED} SELECT doc_id, page, regexp_replace(text, '([A-Za-z])-\n{_W}*([a-z])', '\1\2', 'g') AS text FROM paged")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark, sf_dir).select("doc_id", "page", t.dehyphenate(F.col("text")).alias("text"))


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = paged(spark, sf_dir).select("doc_id", "page", t.normalize(F.col("text")).alias("text"))
    return page.select("doc_id", "page", F.posexplode(t.lines(F.col("text"))).alias("i", "line"))


@query(f"WITH {_LINED} SELECT doc_id, page, CAST(i AS INT) AS line_no, {_sig('line')} AS sig FROM ln")
def hf_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_rows(spark, sf_dir).select("doc_id", "page", (F.col("i") + 1).alias("line_no"), t.signature(F.col("line")).alias("sig"))


@query(f"WITH {_LINED} SELECT doc_id, page, CAST(i AS INT) AS line_no, line FROM ln WHERE {_is_pageno('line')}")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_rows(spark, sf_dir).filter(t.is_page_number(F.col("line"))).select("doc_id", "page", (F.col("i") + 1).alias("line_no"), "line")


@query(f"WITH {_LINED} SELECT doc_id, page, CAST(i AS INT) AS line_no, line FROM ln WHERE {_is_block('line')}")
def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_rows(spark, sf_dir).filter(t.is_block_line(F.col("line"))).select("doc_id", "page", (F.col("i") + 1).alias("line_no"), "line")


_JOINED = rf"{_LINED}, nx AS (SELECT doc_id, page, i, line, lead(line) OVER (PARTITION BY doc_id, page ORDER BY i) AS after FROM ln)"


@query(rf"WITH {_JOINED} SELECT doc_id, page, CAST(i AS INT) AS line_no, line, after FROM nx WHERE after IS NOT NULL AND NOT {_is_block('line')} AND NOT {_is_block('after')} AND NOT regexp_matches({_sub('line', _W + '+' + chr(92) + 'z')}, '[.?!;:。！？；：]\z')")
def joinable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = crosspage.computed(paged(spark, sf_dir), l=t.lines(t.normalize(F.col("text"))))
    pairs = F.transform("l", lambda x, i: F.struct(x.alias("line"), F.get("l", i + 1).alias("after")))
    rows = own.select("doc_id", "page", F.posexplode(pairs).alias("i", "p"))
    return rows.filter(F.col("p.after").isNotNull() & t.may_join(F.col("p.line"), F.col("p.after"))).select("doc_id", "page", (F.col("i") + 1).alias("line_no"), "p.line", "p.after")


_PARAS = rf"{_PAGED}, pp AS (SELECT doc_id, page, list_filter(list_transform(regexp_split_to_array({_strip('text')}, '\n{_W}*\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM paged)"


@query(f"WITH {_PARAS} SELECT doc_id, page, CAST(generate_subscripts(ps, 1) AS INT) AS n, unnest(ps) AS paragraph FROM pp")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = crosspage.computed(paged(spark, sf_dir), ps=t.paragraphs(F.col("text")))
    return own.select("doc_id", "page", F.posexplode("ps").alias("i", "paragraph")).select("doc_id", "page", (F.col("i") + 1).alias("n"), "paragraph")


#: Rules of the replacement queries, in order.
RULES = [("information", "reference"), ("the reference", "ref"), ("x  = 1", "x = 1"), ("", "unused")]
WORDS = [("the", "The"), ("of", "OF"), ("page", "sheet")]


@query(f"WITH {_PAGED} SELECT doc_id, page, replace(replace(replace(text, 'information', 'reference'), 'the reference', 'ref'), 'x  = 1', 'x = 1') AS text FROM paged")
def replacements_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark, sf_dir).select("doc_id", "page", replacements.apply_rules(F.col("text"), RULES).alias("text"))


def _word_sql(x: str) -> str:
    """RE2's word boundaries know ASCII only, so neighbours are looked at; a mark behind each keeps matches apart."""
    edge = r"[^\p{L}\p{N}_]"
    x = rf"regexp_replace({x}, '({edge})', '\1' || chr(1), 'g')"
    for before, after in WORDS:
        x = rf"regexp_replace({x}, '(?i)(\A|{edge}){before}({edge}|\z)', '\1{after}\2', 'g')"
    return f"replace({x}, chr(1), '')"


@query(f"WITH {_PAGED} SELECT doc_id, page, {_word_sql('text')} AS text FROM paged")
def replacements_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark, sf_dir).select("doc_id", "page", replacements.apply_rules(F.col("text"), WORDS, "word", True).alias("text"))


def _heading(x: str) -> str:
    s, mark = _strip(x), rf"(?:[-*+]|{_D}[.)])"
    return rf"""CASE WHEN {s} = '' OR length({s}) > 80 OR starts_with({s}, '#') OR regexp_matches({s}, '\A{mark}{_W}+') THEN NULL
  WHEN regexp_matches({s}, '\A第{_W}*[一二三四五六七八九十百千零〇两0-9]+{_W}*[章节篇]([^\p{{L}}\p{{N}}_]|\z)') THEN 2 WHEN regexp_matches({s}, '(?i)\A(chapter|chap\.?|section){_W}+{_D}') THEN 2
  WHEN regexp_matches({s}, '\A{_D}(?:\.{_D}){{1,4}}{_W}+{_NW}') THEN least(2 + length({s}) - length(replace({s}, '.', '')), 6) END"""


@query(f"WITH {_LINED}, hl AS (SELECT doc_id, page, i, line, {_heading('line')} AS level FROM ln) SELECT doc_id, page, CAST(i AS INT) AS line_no, CAST(level AS INT) AS level, line FROM hl WHERE level IS NOT NULL")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_rows(spark, sf_dir).withColumn("level", t.heading_level(F.col("line")))
    return rows.filter("level IS NOT NULL").select("doc_id", "page", (F.col("i") + 1).alias("line_no"), "level", "line")


@query(f"WITH {_LINED}, hl AS (SELECT doc_id, page, i, line, {_heading('line')} AS level FROM ln) SELECT doc_id, page, string_agg(CASE WHEN level > 0 THEN repeat('#', CAST(level AS INT)) || ' ' || {_strip('line')} ELSE line END, chr(10) ORDER BY i) AS text FROM hl GROUP BY 1, 2")
def auto_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark, sf_dir).select("doc_id", "page", t.auto_headings(t.normalize(F.col("text"))).alias("text"))


@query(f"WITH sw AS (SELECT doc_id, coalesce(text, '') AS text, {_strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS b FROM documents) SELECT doc_id, CASE WHEN length(b) < 600 THEN {_strip('concat(' + repr('> [WARN] content length below 600 chars') + ', chr(10), chr(10), CASE WHEN b = ' + chr(39) * 2 + ' THEN ' + repr('[Empty page]') + ' ELSE b END)')} ELSE text END AS text, CASE WHEN length(b) < 600 THEN '[WARN] content length below 600 chars' END AS warning FROM sw")
def short_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", t.short_warning(F.coalesce("text", F.lit("")), 600).alias("w")).select("doc_id", "w.text", "w.warning")


@query("SELECT doc_id, concat('page_', CASE WHEN length(CAST(doc_id AS VARCHAR)) >= 4 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 4, '0') END, '.md') AS name, concat('page_', CASE WHEN length(CAST(doc_id AS VARCHAR)) >= 2 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 2, '0') END, '.jpg') AS image FROM documents")
def page_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("doc_id")
    return _documents(spark, sf_dir).select("doc_id", t.page_name(page, F.lit(1000)).alias("name"), t.page_name(page, F.lit(7), "JPEG").alias("image"))


@query("WITH r AS (SELECT p_partkey, p_partkey % 40 AS a, p_partkey % 7 + 9 AS b, p_partkey % 11 AS c FROM part), u AS (SELECT p_partkey, unnest(list_concat([a, 3], range(least(b, c), greatest(b, c) + 1))) AS p FROM r) SELECT p_partkey, string_agg(DISTINCT CAST(p AS VARCHAR), ',' ORDER BY CAST(p AS VARCHAR)) AS pages FROM u WHERE p > 0 GROUP BY 1")
def parse_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    k = F.col("p_partkey")
    text = F.concat((k % 40).cast("string"), F.lit(","), (k % 7 + 9).cast("string"), F.lit("-"), (k % 11).cast("string"), F.lit(" 3"))
    pages = F.array_sort(F.transform(lists.page_ranges(text), lambda p: p.cast("string")))
    return part.select("p_partkey", F.array_join(pages, ",").alias("pages"))


@query(f"WITH {_PAGED} SELECT doc_id, page, text FROM paged WHERE (page BETWEEN 2 AND 30 OR page = 44) AND page NOT IN (5, 6, 7)")
def select_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.select_pages(paged(spark, sf_dir), "30-2,44", "5-7")


@query("WITH s AS (SELECT c_custkey, string_split(concat(c_mktsegment, ' , ,', CAST(c_nationkey AS VARCHAR), ',', c_mktsegment), ',') AS ps FROM customer), u AS (SELECT c_custkey, trim(unnest(ps)) AS p, generate_subscripts(ps, 1) AS i FROM s), f AS (SELECT c_custkey, p, min(i) AS i FROM u WHERE p <> '' GROUP BY 1, 2) SELECT c_custkey, string_agg(p, '|' ORDER BY i) AS items FROM f GROUP BY 1")
def unique_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat("c_mktsegment", F.lit(" , ,"), F.col("c_nationkey").cast("string"), F.lit(","), "c_mktsegment")
    return c.select("c_custkey", F.array_join(lists.unique(lists.split_csv(text)), "|").alias("items"))


_TABLE = "concat('| ', n_name, ' | ', CAST(n_nationkey AS VARCHAR), ' | ', CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE '' END, ' |')"


@query(f"SELECT n_regionkey, concat('| name | key | parity |', chr(10), '| --- | --- | --- |', chr(10), string_agg({_TABLE}, chr(10) ORDER BY n_nationkey)) AS markdown, concat('| col1 | col2 | col3 |', chr(10), '| --- | --- | --- |', chr(10), '| name | key | parity |', chr(10), string_agg({_TABLE}, chr(10) ORDER BY n_nationkey)) AS headless FROM nation GROUP BY 1")
def table_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey")
    cells = F.when(key % 2 == 0, F.array(F.concat(F.lit(" "), "n_name"), key.cast("string"), F.lit("even "))).otherwise(F.array("n_name", key.cast("string")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), cells.alias("c")))), lambda x: x["c"])
    table = nation.groupBy("n_regionkey").agg(F.concat(F.array(F.array(F.lit("name"), F.lit("key"), F.lit("parity"))), rows).alias("t"))
    return table.select("n_regionkey", tables.table_markdown(F.col("t")).alias("markdown"), tables.table_markdown(F.col("t"), False).alias("headless"))


@query("WITH r AS (SELECT s_nationkey, concat('| k | v |', chr(10), '| --- | --- |', chr(10), '| ', CAST(s_suppkey AS VARCHAR), ' | ', s_name, ' |') AS m, s_suppkey FROM supplier) SELECT s_nationkey, string_agg(m, chr(10) || chr(10) ORDER BY s_suppkey) AS markdown FROM r GROUP BY 1")
def tables_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    one = F.array(F.array(F.lit("k"), F.lit("v")), F.array(F.col("s_suppkey").cast("string"), F.col("s_name")))
    all_of = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("t")))), lambda x: x["t"])
    empty = F.array(F.array().cast("array<array<string>>"))
    return s.groupBy("s_nationkey").agg(tables.tables_markdown(F.concat(all_of, empty)).alias("markdown"))


@query("SELECT o_custkey, median(CAST(o_totalprice AS DOUBLE)) AS median_price FROM orders GROUP BY 1")
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(lists.median(F.col("o_totalprice").cast("double")).alias("median_price"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size * 100 * p_size * 80 > 4000000 THEN greatest(600, floor(2000 * sqrt(CAST(4000000 AS DOUBLE) / (p_size * 100 * p_size * 80)))) ELSE 2000 END AS INT) AS max_side FROM part")
def adjust_max_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size").cast("long")
    return part.select("p_partkey", lists.limited_side(size * 100, size * 80, 2000, 4_000_000).alias("max_side"))


_RULE_TEXT = " || chr(10) || ".join("'" + r.replace("'", "''") + "'" for r in prompts.RULES)


@query(f"SELECT doc_id, concat('{prompts.OPENING}', chr(10), CASE WHEN lang <> 'en' THEN concat('Language hint: ', lang, chr(10)) ELSE '' END, {_RULE_TEXT}, chr(10), '(This is page ', CAST(doc_id AS VARCHAR), '.)') AS prompt, concat('Page ', CAST(doc_id AS VARCHAR), ' in ', CASE WHEN lang <> 'en' THEN lang ELSE '' END, ' {{x}}') AS short FROM documents")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hint = F.when(F.col("lang") != "en", F.col("lang"))
    return docs.select("doc_id", prompts.prompt(F.col("doc_id"), hint).alias("prompt"), prompts.prompt(F.col("doc_id"), hint, " Page {page} in {language} {x}").alias("short"))


# --- across pages ---------------------------------------------------------------

_THRESHOLD = "greatest(3, CAST(floor(n_pages * CAST(0.6 AS DOUBLE) + CAST(0.999 AS DOUBLE)) AS BIGINT))"
_EDGES = rf"""{_LINED}, nb AS (SELECT doc_id, page, i, line, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY i DESC) AS z FROM ln WHERE {_strip('line')} <> ''),
sg AS (SELECT doc_id, page, i, line, a, z, {_sig('line')} AS sig FROM nb),
pc AS (SELECT doc_id, count(*) AS n_pages FROM np GROUP BY 1),
ec AS (SELECT doc_id, 'header' AS kind, sig, count(*) AS n FROM sg WHERE a <= 2 GROUP BY 1, 2, 3 UNION ALL SELECT doc_id, 'footer', sig, count(*) FROM sg WHERE z <= 2 GROUP BY 1, 2, 3),
hf AS (SELECT doc_id, kind, sig, n FROM ec JOIN pc USING (doc_id) WHERE n >= {_THRESHOLD} AND sig <> '')"""
_CUT = rf"""{_EDGES}, gone AS (SELECT DISTINCT sg.doc_id, page, i FROM sg LEFT JOIN hf h ON h.doc_id = sg.doc_id AND h.kind = 'header' AND h.sig = sg.sig AND a <= 2 LEFT JOIN hf f ON f.doc_id = sg.doc_id AND f.kind = 'footer' AND f.sig = sg.sig AND z <= 2
  WHERE h.sig IS NOT NULL OR f.sig IS NOT NULL OR ((a <= 2 OR z <= 2) AND {_is_pageno('line')})),
cp AS (SELECT np.doc_id, np.page, {_strip("coalesce(string_agg(line, chr(10) ORDER BY ln.i), '')")} AS text FROM np LEFT JOIN (SELECT * FROM ln ANTI JOIN gone USING (doc_id, page, i)) ln ON ln.doc_id = np.doc_id AND ln.page = np.page GROUP BY 1, 2)"""


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark, sf_dir).withColumn("text", t.normalize(F.col("text")))


@query(f"WITH {_EDGES} SELECT doc_id, kind, sig, n FROM hf")
def detect_headers_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspage.detect_headers_footers(_normalized(spark, sf_dir))


@query(f"WITH {_CUT} SELECT doc_id, page, text FROM cp")
def remove_headers_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _normalized(spark, sf_dir)
    return crosspage.remove_headers_footers(pages, crosspage.detect_headers_footers(pages))


def _dedupe_sql(source: str) -> str:
    return rf"""q1 AS (SELECT doc_id, page, list_filter(list_transform(regexp_split_to_array({_strip('text')}, '\n{_W}*\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM {source}),
q2 AS (SELECT doc_id, page, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM q1),
q3 AS (SELECT doc_id, page, p, i, CASE WHEN length(p) >= 80 THEN {_sig('p')} END AS sig FROM q2),
q4 AS (SELECT doc_id, sig, count(DISTINCT page) AS n FROM q3 WHERE sig IS NOT NULL AND sig <> '' GROUP BY 1, 2),
q5 AS (SELECT doc_id, sig FROM q4 JOIN (SELECT doc_id, count(*) AS n_pages FROM {source} GROUP BY 1) USING (doc_id) WHERE n >= {_THRESHOLD}),
q6 AS (SELECT q3.doc_id, q3.page, q3.i, q3.p, q5.sig IS NOT NULL AS gone FROM q3 LEFT JOIN q5 ON q5.doc_id = q3.doc_id AND q5.sig = q3.sig),
dd AS (SELECT s.doc_id, s.page, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_removed FROM {source} s LEFT JOIN q6 ON q6.doc_id = s.doc_id AND q6.page = s.page GROUP BY 1, 2)"""


@query(f"WITH {_NORMED}, {_dedupe_sql('np')} SELECT doc_id, page, text, n_removed FROM dd")
def dedupe_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspage.dedupe_paragraphs(_normalized(spark, sf_dir))


def _reflow_sql(source: str) -> str:
    """Gaps and islands: exact where no line is a bare list marker."""
    return rf"""f1 AS (SELECT doc_id, page, unnest({_lines('text')}) AS line, generate_subscripts({_lines('text')}, 1) AS i FROM {source}),
f2 AS (SELECT *, starts_with({_strip('line')}, '```') AS fence FROM f1),
f3 AS (SELECT *, coalesce(sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS code FROM f2),
f4 AS (SELECT *, NOT fence AND NOT code AND {_strip('line')} <> '' AND NOT {_is_block('line')} AS plain FROM f3),
f5 AS (SELECT *, CASE WHEN plain AND lag(plain) OVER w AND NOT regexp_matches({_strip('lag(line) OVER w')}, '[.?!;:。！？；：]\z') THEN 0 ELSE 1 END AS opens FROM f4 WINDOW w AS (PARTITION BY doc_id, page ORDER BY i)),
f6 AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page ORDER BY i) AS g FROM f5),
f7 AS (SELECT doc_id, page, g, string_agg(CASE WHEN plain THEN {_strip('line')} ELSE {_sub('line', _W + '+' + chr(92) + 'z')} END, ' ' ORDER BY i) AS p FROM f6 GROUP BY 1, 2, 3),
rf AS (SELECT s.doc_id, s.page, {_strip("coalesce(string_agg(p, chr(10) ORDER BY g), '')")} AS text FROM {source} s LEFT JOIN f7 ON f7.doc_id = s.doc_id AND f7.page = s.page GROUP BY 1, 2)"""


_DEHYPHENATED = rf"dh AS (SELECT doc_id, page, regexp_replace(text, '([A-Za-z])-\n{_W}*([a-z])', '\1\2', 'g') AS text FROM "


@query(f"WITH {_NORMED}, {_reflow_sql('np')} SELECT doc_id, page, text FROM rf")
def reflow_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).select("doc_id", "page", reflow.reflow_column(F.col("text")).alias("text"))


_CLEAN = rf"""{_CUT}, {_DEHYPHENATED} cp), {_reflow_sql('dh')},
rp AS (SELECT doc_id, page, replace(replace(replace(text, 'information', 'reference'), 'the reference', 'ref'), 'x  = 1', 'x = 1') AS text FROM rf),
h1 AS (SELECT doc_id, page, unnest({_lines('text')}) AS line, generate_subscripts({_lines('text')}, 1) AS i FROM rp),
h2 AS (SELECT doc_id, page, i, line, {_heading('line')} AS level FROM h1),
h3 AS (SELECT rp.doc_id, rp.page, coalesce(string_agg(CASE WHEN level > 0 THEN repeat('#', CAST(level AS INT)) || ' ' || {_strip('line')} ELSE line END, chr(10) ORDER BY i), '') AS t FROM rp LEFT JOIN h2 ON h2.doc_id = rp.doc_id AND h2.page = rp.page GROUP BY 1, 2),
h4 AS (SELECT doc_id, page, {_norm('t')} AS text FROM h3), {_dedupe_sql('h4')},
fin AS (SELECT doc_id, page, CASE WHEN length({_strip('text')}) < 300 THEN {_strip("concat('> [WARN] content length below 300 chars', chr(10), chr(10), CASE WHEN " + _strip('text') + " = '' THEN '[Empty page]' ELSE " + _strip('text') + " END)")} ELSE text END AS text,
  CASE WHEN length({_strip('text')}) < 300 THEN '[WARN] content length below 300 chars' END AS warning, n_removed FROM dd)"""
#: Settings of the clean-up queries.
CLEAN = Config(dedupe=True, auto_headings=True, warn_short=300)


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_pages(paged(spark, sf_dir), CLEAN, RULES)


@query(f"WITH {_CLEAN} SELECT doc_id, page, text, warning, n_removed FROM fin")
def postprocess_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("doc_id", "page", "text", "warning", "n_removed")


@query(f"WITH {_CLEAN} SELECT doc_id, concat('# All pages', chr(10), chr(10), string_agg(concat('## Page ', CAST(page AS VARCHAR), chr(10), chr(10), CASE WHEN text <> '' THEN text || chr(10) ELSE '' END), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY page)) AS markdown FROM fin GROUP BY 1")
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.merge_pages(_cleaned(spark, sf_dir), title="All pages")


@query(f"WITH {_PAGED} SELECT doc_id, page, concat('page_', lpad(CAST(page AS VARCHAR), CAST(greatest(2, length(CAST((max(page) OVER (PARTITION BY doc_id)) AS VARCHAR))) AS INT), '0'), '.md') AS name, concat({_strip(chr(99) + 'oncat(' + repr('## Page ') + ', CAST(page AS VARCHAR), chr(10), chr(10), text)')}, chr(10)) AS content FROM paged")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.page_files(paged(spark, sf_dir), "## Page {page}")


# --- routing, statistics, retries -----------------------------------------------

_CACHE = "ca AS (SELECT source AS doc_id, pg AS page, CASE WHEN pg % 6 = 0 THEN 'timeout' END AS error FROM d WHERE pg % 3 = 0)"


def _cache(pages: DataFrame) -> DataFrame:
    return pages.filter("page % 3 = 0").select("doc_id", "page", F.when(F.col("page") % 6 == 0, "timeout").alias("error"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_pages(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", "doc_id")


_RAW = f"d AS (SELECT source, doc_id, text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS pg FROM documents), {_CACHE}, rt AS (SELECT source AS doc_id, pg AS page, {_norm('text')} AS text FROM d), m AS (SELECT doc_id, page, {_metric_sql('text')} FROM rt), pl AS (SELECT m.doc_id, m.page, CASE WHEN ca.doc_id IS NOT NULL AND ca.error IS NULL THEN 'cached' WHEN {_GATE} THEN 'text' ELSE 'ocr' END AS plan FROM m LEFT JOIN ca ON ca.doc_id = m.doc_id AND ca.page = m.page)"


@query(f"WITH {_RAW} SELECT doc_id, page, plan FROM pl")
def route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _raw(spark, sf_dir)
    return routing.route(pages, _cache(pages), resume=True, retry_failed=True).select("doc_id", "page", "plan")


@query(f"WITH {_RAW} SELECT doc_id, plan, count(*) AS n FROM pl GROUP BY 1, 2")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _raw(spark, sf_dir)
    return routing.dry_run(routing.route(pages, _cache(pages), resume=True, retry_failed=True))


@query(f"WITH {_RAW} SELECT pl.doc_id, pl.page, CASE WHEN plan <> 'ocr' THEN plan ELSE 'table' END AS method, CASE WHEN plan <> 'ocr' THEN d.text WHEN pl.page % 2 = 0 THEN '| a |' ELSE '[Empty page]' END AS text FROM pl JOIN d ON d.source = pl.doc_id AND d.pg = pl.page")
def intercept_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _raw(spark, sf_dir)
    planned = routing.route(pages, _cache(pages), resume=True, retry_failed=True)
    found = pages.filter("page % 2 = 0").select("doc_id", "page", F.lit("| a |").alias("table_text"))
    return routing.intercept_tables(planned, found, only=True).select("doc_id", "page", "method", "text")


@query(f"WITH {_RAW} SELECT source AS doc_id, pg AS page FROM d WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.doc_id = source AND ca.page = pg AND ca.error IS NULL)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _raw(spark, sf_dir)
    return routing.pending(pages, _cache(pages), retry_failed=True).select("doc_id", "page")


@query(f"WITH {_EVENTS} SELECT DISTINCT doc_id, page FROM ev WHERE error IS NOT NULL AND page > 0")
def retry_failed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _events(spark, sf_dir)
    listed = stats.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.col("page")))).alias("bad"), F.collect_list(F.struct("page", "error")).alias("pages"))
    keep = F.when(F.col("doc_id").cast("int") % 2 == 0, F.col("bad")).otherwise(F.array().cast("array<int>"))  # half have the summary's list, half only their pages'
    told = listed.select("doc_id", F.to_json(F.struct(F.struct(keep.alias("error_pages")).alias("summary"), "pages")).alias("stats"))
    return routing.failed_in_stats(told)


@query(f"WITH {_EVENTS} SELECT DISTINCT doc_id, page FROM ev WHERE error IS NOT NULL")
def failed_in_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.failed_in_cache(_events(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT doc_id, page, error, coalesce(contains(lower(error), 'quality check failed'), false) AS quality_error FROM ev")
def quality_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.by_quality(_events(spark, sf_dir)).select("doc_id", "page", "error", F.coalesce("quality_error", F.lit(False)).alias("quality_error"))


@query(f"""WITH {_EVENTS}, s AS (SELECT doc_id, count(*) AS total_pages, count(*) FILTER (WHERE method = 'text') AS text_pages, count(*) FILTER (WHERE method = 'table') AS table_pages, count(*) FILTER (WHERE method = 'ocr') AS ocr_pages,
  count(*) FILTER (WHERE cached) AS cached_pages, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (WHERE error IS NOT NULL), '') AS error_pages, sum(seconds) AS elapsed_seconds FROM ev GROUP BY 1)
SELECT doc_id, total_pages, text_pages, table_pages, ocr_pages, cached_pages, error_pages, elapsed_seconds, round(CASE WHEN text_pages + ocr_pages + table_pages > 0 THEN ocr_pages / CAST(text_pages + ocr_pages + table_pages AS DOUBLE) ELSE 0 END, 6) AS ocr_ratio FROM s""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.run_summary(_events(spark, sf_dir))
    pages = F.array_join(F.transform("error_pages", lambda p: p.cast("string")), ",")
    return out.select("doc_id", "total_pages", "text_pages", "table_pages", "ocr_pages", "cached_pages", pages.alias("error_pages"), "elapsed_seconds", F.round("ocr_ratio", 6).alias("ocr_ratio"))


@query(f"""WITH {_EVENTS} SELECT doc_id, page, concat('{{"page":', CAST(page AS VARCHAR), ',"method":"', method, '","seconds":', CAST(seconds AS VARCHAR), ',"chars":', CAST(chars AS VARCHAR), ',"cached":', CASE WHEN cached THEN 'true' ELSE 'false' END,
  ',"error":', CASE WHEN error IS NULL THEN 'null' ELSE '"' || error || '"' END, ',"model":null,"api_url":null,"warning":null}}') AS json FROM ev""")
def page_stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("doc_id", "page", summary.stat_json().alias("json"))


@query(f"WITH {_PAGED} SELECT doc_id, page, 'cached' AS method, CAST(0 AS DOUBLE) AS seconds, CAST(length(text) AS BIGINT) AS chars, true AS cached FROM paged WHERE page % 2 = 0 UNION ALL SELECT doc_id, page, 'ocr', CAST(1.5 AS DOUBLE), CAST(7 AS BIGINT), true FROM paged WHERE page % 2 = 1")
def cached_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("page") % 2 == 1
    rows = paged(spark, sf_dir).select("doc_id", "page", "text", F.when(odd, "ocr").alias("method"), F.when(odd, 1.5).alias("seconds"), F.when(odd, F.lit(7).cast("long")).alias("chars"), *[F.lit(None).cast("string").alias(c) for c in ("error", "model", "api_url", "warning")])
    return summary.stats_from_meta(rows).select("doc_id", "page", "method", "seconds", "chars", "cached")


def _ascii(x: str) -> str:
    """JSON text with everything beyond ASCII as \\uXXXX, in DuckDB's SQL."""
    unit = lambda v: f"lpad(lower(printf('%x', {v})), 4, '0')"
    escaped = f"CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN '\\u' || {unit('unicode(c)')} ELSE '\\u' || {unit('55296 + (unicode(c) - 65536) // 1024')} || '\\u' || {unit('56320 + (unicode(c) - 65536) % 1024')} END"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: {escaped}), '')"


_PAGE_STAT = """concat('{"page":', page, ',"method":"unknown","seconds":0.0,"chars":', length(text), ',"cached":false,"error":null,"model":null,"api_url":null,"warning":', coalesce(CAST(to_json(warning) AS VARCHAR), 'null'), '}')"""
_DOC_SUMMARY = """concat('{"total_pages":', count(*), ',"text_pages":0,"table_pages":0,"ocr_pages":0,"cached_pages":0,"error_pages":[],"elapsed_seconds":0.0,"ocr_ratio":0.0,"dedupe_removed":0}')"""


def _with_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return _cleaned(spark, sf_dir).select("doc_id", "page", "text", "method", F.lit(0.0).alias("seconds"), F.length("text").cast("long").alias("chars"), F.lit(False).alias("cached"), nothing.alias("error"), nothing.alias("model"), nothing.alias("api_url"), "warning")


@query(f"""WITH {_CLEAN}, pj AS (SELECT doc_id, page, concat('{{"page":', page, ',"text":', CAST(to_json(text) AS VARCHAR), ',"stats":', {_PAGE_STAT}, '}}') AS j FROM fin)
SELECT doc_id, {_ascii("concat('{\"config\":{\"version\": 1},\"summary\":', " + _DOC_SUMMARY + ", ',\"pages\":[', string_agg(j, ',' ORDER BY page), ']}')")} AS json FROM pj GROUP BY 1""")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _with_stats(spark, sf_dir)
    return sinks.result_json(pages, summary.run_summary(pages), {"version": 1})


@query(f"""WITH {_CLEAN}, pj AS (SELECT doc_id, page, {_PAGE_STAT} AS j FROM fin)
SELECT doc_id, {_ascii("concat('{\"config\":{\"version\": 1},\"selected_pages\":[', string_agg(CAST(page AS VARCHAR), ',' ORDER BY page), '],\"summary\":', " + _DOC_SUMMARY + ", ',\"pages\":[', string_agg(j, ',' ORDER BY page), ']}')")} AS json FROM pj GROUP BY 1""")
def stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _with_stats(spark, sf_dir)
    return sinks.stats_json(pages, summary.run_summary(pages), {"version": 1})


# --- layout ---------------------------------------------------------------------


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages and their line items as words, laid out by rule in two columns."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").cast("string").alias("w"))
    n = F.col("n")
    left, top = F.when(n % 2 == 1, 50.0).otherwise(350.0), (F.ceil(n / 2) * 20).cast("double") + (n % 3).cast("double") / 2
    word = F.struct(F.col("w").alias("text"), left.alias("x0"), (left + 180.0).alias("x1"), top.alias("top"), (top + 10.0).alias("bottom"))
    char = F.struct((F.lit(8.0) + n % 4).alias("size"), (top + 9.0).alias("top"))
    pages = items.groupBy("k").agg(F.array_sort(F.collect_list(word)).alias("words"), F.array_sort(F.collect_list(char)).alias("chars"))
    return pages.select(F.concat(F.lit("g"), (F.col("k") % 13).cast("string")).alias("doc_id"), F.col("k").cast("int").alias("page"), F.lit(600.0).alias("width"), F.lit(100.0).alias("height"), "words", "chars")


_GEO = """it AS (SELECT l_orderkey AS k, CAST(l_linenumber AS INT) AS n, CAST(l_partkey AS VARCHAR) AS w FROM lineitem),
wd AS (SELECT k, n, w, CASE WHEN n % 2 = 1 THEN 50.0 ELSE 350.0 END AS x0, ceil(n / 2.0) * 20 + (n % 3) / 2.0 AS top, CAST(8 + n % 4 AS DOUBLE) AS size FROM it),
pr AS (SELECT k, CAST(ceil(n / 2.0) AS INT) AS row, string_agg(w, ' ' ORDER BY x0, w) AS text, CAST(min(top) AS DOUBLE) AS top, CAST(max(top) + 10 AS DOUBLE) AS bottom FROM wd GROUP BY 1, 2),
md AS (SELECT k, median(size) AS page_size FROM wd GROUP BY 1),
sz AS (SELECT pr.k, pr.row, median(wd.size) AS near FROM pr JOIN wd ON wd.k = pr.k AND wd.top + 9 BETWEEN pr.bottom - 3 AND pr.bottom + 3 GROUP BY 1, 2),
bl AS (SELECT concat('g', CAST(pr.k % 13 AS VARCHAR)) AS doc_id, CAST(pr.k AS INT) AS page, pr.text, pr.top, pr.bottom, CAST(coalesce(near, page_size) AS DOUBLE) AS size FROM pr JOIN md USING (k) LEFT JOIN sz ON sz.k = pr.k AND sz.row = pr.row)"""


@query(f"WITH {_GEO} SELECT doc_id, page, text, top, bottom, size FROM bl")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = geometry(spark, sf_dir).select("doc_id", "page", F.explode(layout.line_blocks(F.col("words"), F.col("chars"))).alias("b"))
    return blocks.select("doc_id", "page", "b.text", "b.top", "b.bottom", "b.size")


@query("WITH c AS (SELECT l_orderkey AS k, count(*) >= 3 AND bool_or(l_linenumber % 2 = 1) AND bool_or(l_linenumber % 2 = 0) AS two FROM lineitem GROUP BY 1) SELECT concat('g', CAST(k % 13 AS VARCHAR)) AS doc_id, CAST(k AS INT) AS page, CASE WHEN two THEN 'columns' ELSE 'single' END AS mode, CASE WHEN two THEN round((230.0 + 350.0) / 2 / 600, 6) END AS split_ratio FROM c")
def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = geometry(spark, sf_dir).select("doc_id", "page", layout.decide_layout(F.col("words"), F.col("width"), min_words=3).alias("d"))
    return decided.select("doc_id", "page", "d.mode", F.round("d.split_ratio", 6).alias("split_ratio"))


_BAND = f"""WITH {_GEO}, us AS (SELECT page, median(size) AS usual FROM bl GROUP BY 1),
bd AS (SELECT doc_id, {_sig('text')} AS sig, top, bottom FROM bl JOIN us USING (page) WHERE NOT size > usual * CAST(1.0 AS DOUBLE)),
ct AS (SELECT doc_id, 'header' AS kind, sig, count(*) AS n FROM bd WHERE bottom <= 100 * CAST(0.35 AS DOUBLE) GROUP BY 1, 2, 3 UNION ALL SELECT doc_id, 'footer', sig, count(*) FROM bd WHERE top >= 100 * (1 - CAST(0.7 AS DOUBLE)) GROUP BY 1, 2, 3),
pn AS (SELECT concat('g', CAST(k % 13 AS VARCHAR)) AS doc_id, count(*) AS n_pages FROM (SELECT DISTINCT k FROM it) GROUP BY 1)
SELECT doc_id, kind, sig, n FROM ct JOIN pn USING (doc_id) WHERE n >= greatest(3, CAST(floor(n_pages * CAST(0.1 AS DOUBLE) + CAST(0.999 AS DOUBLE)) AS BIGINT))"""


@query(_BAND)
def layout_hf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.detect_layout_headers_footers(geometry(spark, sf_dir), top=0.35, bottom=0.7, ratio=0.1, font_max=1.0)

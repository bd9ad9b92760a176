"""Text from page images through a chat service, with retries, limits and fallbacks.

The transport is injected, so tests and air-gapped runs need no network.  Calls
run inside ``mapInPandas``, at most ``workers`` partitions at a time; Spark has no
global lock, so a rate is shared out among the partitions.  Failures are rows, not
exceptions: a page that can't be read gets an error text and an error column.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import Gray, Image, Look, from_row

#: What asks for the rest of an answer that was cut off: a fixed value.
CONTINUE = "Continue from the last line. Do not repeat. Output only Markdown."


@dataclass(frozen=True)
class Provider:
    url: str
    key: str = field(repr=False)


@dataclass(frozen=True)
class Reply:
    status: int
    body: dict
    text: str = ""
    retry_after: str | None = None


class Transport(Protocol):
    def __call__(self, url: str, key: str, payload: dict, timeout: int) -> Reply: ...


def http_transport(url: str, key: str, payload: dict, timeout: int) -> Reply:
    """A POST by ``requests``, where that is installed."""
    import requests

    r = requests.post(url, headers={"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, json=payload, timeout=timeout)
    return Reply(r.status_code, r.json() if r.ok else {}, r.text[:800], r.headers.get("Retry-After"))


class RateLimiter:
    """At most ``rps`` calls a second; each refusal doubles the pause, up to ``cap`` seconds."""

    def __init__(self, rps: float, cap: float = 10.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pause = 1 / rps if rps > 0 else 0.0
        self.cap, self._clock, self._sleep, self._next = cap, clock, sleep, 0.0

    def wait(self) -> None:
        if self.pause <= 0:
            return
        now = self._clock()
        if now < self._next:
            self._sleep(self._next - now)
        self._next = max(now, self._next) + self.pause

    def backoff(self) -> None:
        if self.pause > 0:
            self.pause = min(self.cap, self.pause * 2)


@dataclass(frozen=True)
class Reader:
    """How a page is read."""

    providers: tuple[Provider, ...]
    models: tuple[str, ...]
    transport: Transport = http_transport
    detail: str = "high"
    timeout: int = 120
    max_tokens: int = 4096
    temperature: float = 0.0
    continuations: int = 2
    retries: int = 4
    page_retries: int = 3
    sleep_base: float = 1.2
    rps: float = 0.0
    template: str | None = None
    quality: bool = True
    min_chars: int = 80
    min_alnum: float = 0.2
    max_symbol: float = 0.6
    max_replaced: float = 0.02
    sleep: Callable[[float], None] = time.sleep

    def _post(self, payload: dict, provider: Provider, limiter: RateLimiter) -> dict:
        """One answer; busy services and broken lines are tried again, refusals are not."""
        last = ""
        for attempt in range(self.retries):
            limiter.wait()
            pause = self.sleep_base * 2**attempt
            try:
                reply = self.transport(provider.url, provider.key, payload, self.timeout)
            except Exception as e:  # the transport's own
                last = str(e)
            else:
                if reply.status < 400:
                    return reply.body
                last = f"HTTP {reply.status}: {reply.text[:800]}"
                if reply.status in (429, 503):
                    limiter.backoff()
                    try:
                        pause = float(reply.retry_after) if reply.retry_after else pause
                    except ValueError:
                        pass
                elif reply.status < 500:
                    raise RuntimeError(last)
            if attempt + 1 < self.retries:
                self.sleep(pause)
        raise RuntimeError(f"no answer from {provider.url} in {self.retries} calls; {last}")

    def call(self, image_url: str, page: int, language: str = "", limiter: RateLimiter | None = None) -> tuple[str, str, str]:
        """(text, model, url) of the first provider and model whose answer passes."""
        limiter = limiter or RateLimiter(self.rps)
        start = [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": image_url, "detail": self.detail}}, {"type": "text", "text": prompt_text(page, language, self.template)}]}]
        last: object = None
        for provider, model in ((p, m) for p in self.providers for m in self.models):
            try:
                messages, parts = list(start), []
                for _ in range(self.continuations + 1):
                    body = self._post({"model": model, "messages": messages, "max_tokens": self.max_tokens, "temperature": self.temperature}, provider, limiter)
                    choice = body["choices"][0]
                    parts.append(plain_normalize(choice["message"]["content"]))
                    if choice.get("finish_reason") != "length":
                        break
                    messages = [*messages, {"role": "assistant", "content": parts[-1]}, {"role": "user", "content": CONTINUE}]
                text = plain_normalize("\n".join(parts))
                reason = self.fault(text) if self.quality else ""
                if not reason:
                    return text, model, provider.url
                last = f"OCR quality check failed: {reason}"
            except Exception as e:
                last = e
        raise RuntimeError(f"no service read the page; {last}")

    def fault(self, text: str) -> str:
        """The first limit that a text misses, or nothing."""
        n = max(1, len(text))
        letters = sum(map(str.isalnum, text))
        signs = sum(not (c.isalnum() or c.isspace()) for c in text)
        lost = sum(map(text.count, ("�", "□", "[??]")))
        tests = (
            (len(text) < self.min_chars, f"total_chars<{self.min_chars}"),
            (letters / n < self.min_alnum, f"alnum_ratio<{self.min_alnum}"),
            (signs / n > self.max_symbol, f"symbol_ratio>{self.max_symbol}"),
            (lost / n > self.max_replaced, f"replacement_ratio>{self.max_replaced}"),
        )
        return next((reason for wrong, reason in tests if wrong), "")

    def page(self, page: int, load: Callable[[bool], list[str]], language: str = "", finer: bool = False, limiter: RateLimiter | None = None) -> dict:
        """One page's row: ``load(high)`` gives its images' data URLs at the usual or the high resolution."""
        begun, last = time.monotonic(), None
        for attempt in range(1, max(1, self.page_retries) + 1):
            for high in (False, True) if finer else (False,):
                try:
                    got = [self.call(u, page, language, limiter) for u in load(high)]
                    text = got[0][0] if len(got) == 1 else plain_normalize("\n\n".join(t for t, _, _ in got))
                    distinct = lambda k: ",".join(dict.fromkeys(g[k] for g in got))  # noqa: B023, E731
                    return {"text": text, "method": "ocr", "seconds": time.monotonic() - begun, "chars": len(text), "error": None, "model": distinct(1), "api_url": distinct(2)}
                except Exception as e:
                    last = e
                    if "quality check failed" not in str(e).lower():
                        break
            if attempt < self.page_retries:
                self.sleep(self.sleep_base * attempt)
        error = f"OCR failed after {max(1, self.page_retries)} retries: {last}"
        text = f"[Error processing page {page}: {error}]"
        return {"text": text, "method": "error", "seconds": time.monotonic() - begun, "chars": len(text), "error": error, "model": None, "api_url": None}


def plain_normalize(text: str) -> str:
    """``functions.text.normalize`` for one Python string."""
    import re

    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", text))
    return "\n".join(map(str.rstrip, text.split("\n"))).strip()


def prompt_text(page: int, language: str = "", template: str | None = None) -> str:
    """``functions.prompts.prompt`` for one page."""
    from ..functions import prompts as p

    if template:
        return template.replace("{page}", str(page)).replace("{language}", language or "").strip()
    return "\n".join([p.OPENING, *([p.LANGUAGE % language] if language else []), *p.RULES, p.PAGE % page])


def crops(gray: Gray, mode: str = "single", split: float | None = None, overlap: float = 0.02, blocks: bool = False, max_pixels: int = 0, skip_large: bool = False, **block_limits) -> list[Gray]:
    """The parts of a page in reading order: columns, else blocks if wanted, else the page."""
    from .images import split_blocks, split_columns

    if skip_large and 0 < max_pixels < gray.size:
        raise RuntimeError(f"image has {gray.size} pixels, more than {max_pixels}")
    if mode == "columns":
        return split_columns(gray, split if split is not None else 0.5, overlap)
    if blocks:
        return [gray[a:b] for a, b in split_blocks(gray, **block_limits)]
    return [gray]


RESULT = "text string, method string, seconds double, chars bigint, error string, model string, api_url string"


#: Pages of one task: what a lost executor has to read again.
PAGES_PER_TASK = 64
_COLUMNS = ["doc_id", "page", "text", "method", "seconds", "chars", "error", "model", "api_url"]


def _shares(pages: DataFrame, workers: int) -> tuple[int, int]:
    """(partitions, of which so many run at a time): small tasks, unless few workers are asked for, who then are the partitions."""
    slots = pages.sparkSession.sparkContext.defaultParallelism
    if workers < slots:
        return workers, workers
    partitions = max(workers, -(-pages.count() // PAGES_PER_TASK))
    return partitions, min(partitions, slots)


def read_pages(pages: DataFrame, reader: Reader, load: Callable[[pd.Series, bool], list[str]], workers: int = 2, finer: bool = False) -> DataFrame:
    """(doc_id, page, result) of every page; ``load(row, high)`` gives a row's images as data URLs.

    Write the result before using it twice, or the calls are made twice.
    """
    partitions, at_a_time = _shares(pages, workers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(reader.rps / at_a_time if reader.rps > 0 else 0.0)
        for batch in batches:
            rows = []
            for _, row in batch.iterrows():
                got = reader.page(int(row["page"]), lambda high, row=row: load(row, high), row.get("language") or "", finer, limiter)
                rows.append({"doc_id": row["doc_id"], "page": row["page"], **got})
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return pages.repartition(partitions).mapInPandas(run, f"doc_id string, page int, {RESULT}")


def read_scans(files: DataFrame, due: DataFrame, reader: Reader, look: Look, renderer: Callable[[bytes, int, int], Image], workers: int = 2, finer: bool = False, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, result) of scanned pages: rendered, cut up by their layout, prepared, sent and put together.

    ``files`` is (doc_id, content); ``due`` is (doc_id, page) with ``language`` and
    ``split`` (where two columns part, or null) if they are known.  A file travels
    once for some pages, not once for each.  ``images`` (doc_id, page, dpi, width,
    height, pixels) are taken instead of rendering where they are there.
    """
    from ..sources.pages import in_chunks

    asked = due.select("doc_id", "page", *[(F.col(c) if c in due.columns else F.lit(None)).cast(t).alias(c) for c, t in (("language", "string"), ("split", "double"))])
    known = F.lit(None).cast("array<struct<dpi:int,width:int,height:int,pixels:binary>>").alias("images")
    if images is not None:
        kept = images.filter("pixels IS NOT NULL").groupBy("doc_id", "page").agg(F.collect_list(F.struct("dpi", "width", "height", "pixels")).alias("images"))  # one for each resolution
        asked = asked.join(kept, ["doc_id", "page"], "left")
        known = F.col("images")
    chunks = in_chunks(files, asked.select("doc_id", "page", "language", "split", known), ["page", "language", "split", "images"], keep=True)
    partitions, at_a_time = _shares(due, workers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(reader.rps / at_a_time if reader.rps > 0 else 0.0)
        for batch in batches:
            for name, content, pages in zip(batch["doc_id"], batch["content"], batch["pages"], strict=True):
                rows = []
                for p in pages:
                    have = {x["dpi"]: from_row(x["pixels"], x["width"], x["height"]) for x in (p["images"] if p["images"] is not None else [])}

                    def load(high: bool, p=p, have=have, content=content) -> list[str]:
                        dpi = look.dpi_high if high else look.dpi
                        image = have[dpi] if dpi in have else renderer(content, int(p["page"]), dpi)
                        split = p["split"]
                        return look.urls(image, None if split is None or split != split else split)

                    rows.append({"doc_id": name, "page": p["page"], **reader.page(int(p["page"]), load, p["language"] or "", finer, limiter)})
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return chunks.repartition(partitions).mapInPandas(run, f"doc_id string, page int, {RESULT}")

"""Hooks: a command or a function on each page's text, before or after clean-up."""

from __future__ import annotations

import os
import shlex
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Hook = str | Callable[[str, dict], str]


def run_hook(hook: Hook | None, text: str, about: dict, keep_on_error: bool = False) -> str:
    """The hook's output; ``about`` has doc_id, page, method and stage, which a command sees in its environment."""
    if not hook:
        return text
    try:
        if callable(hook):
            return hook(text, about)
        env = os.environ | {"DOC_ID": str(about["doc_id"]), "PDF_PATH": str(about["doc_id"]), "PAGE_NUMBER": str(about["page"]), "METHOD": str(about["method"]), "STAGE": about["stage"]}
        done = subprocess.run(shlex.split(hook), input=text, capture_output=True, text=True, env=env, check=False)
        if done.returncode:
            raise RuntimeError(f"hook failed on page {about['page']} ({about['stage']}): {done.stderr.strip()}")
        return done.stdout.rstrip("\n")
    except Exception:
        if keep_on_error:
            return text
        raise


def apply_hook(pages: DataFrame, hook: Hook | None, stage: str, keep_on_error: bool = False) -> DataFrame:
    """``pages`` (doc_id, page, text, method, ...) with ``text`` put through a hook; without a hook, the same plan."""
    if not hook:
        return pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            about = batch[["doc_id", "page", "method"]].assign(stage=stage).to_dict("records")
            yield batch.assign(text=[run_hook(hook, t or "", a, keep_on_error) for t, a in zip(batch["text"], about, strict=True)])

    return pages.mapInPandas(run, pages.schema)

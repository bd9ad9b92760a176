"""Settings of a conversion, their presets, and the command line made from them."""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys
from dataclasses import dataclass

from .operators.ocr import Provider

VERSION = "0.1.0"


@dataclass(frozen=True)
class Config:
    """Defaults are the published ones; every field is a flag, truth values have a ``--no-`` form."""

    # what is read, and how
    source: str = "auto"
    mode: str = "auto"
    pages: str = ""
    skip_pages: str = ""
    text_min_chars: int = 200
    text_min_alnum_ratio: float = 0.25
    text_min_avg_line: float = 12.0
    text_max_blank_ratio: float = 0.6
    # the reading service
    api_key: str = ""
    api_url: str = ""
    api_url_fallback: str = ""
    model: str = ""
    model_fallback: str = ""
    detail: str = "high"
    timeout: int = 120
    max_tokens: int = 4096
    temperature: float = 0.0
    max_continuations: int = 2
    max_retries: int = 4
    page_retries: int = 3
    sleep_base: float = 1.2
    ocr_workers: int = max(2, os.cpu_count() or 1)
    ocr_rps: float = 0.0
    render_workers: int = max(1, os.cpu_count() or 1)
    prompt_file: str = ""
    prompt_lang: str = ""
    auto_lang: bool = True
    # images
    dpi: int = 300
    dpi_high: int = 450
    adaptive_dpi: bool = False
    max_side: int = 2000
    imgfmt: str = "PNG"
    preprocess: bool = True
    denoise: bool = True
    denoise_size: int = 3
    contrast: float = 1.4
    binarize: bool = True
    binarize_threshold: int = 0
    deskew: bool = True
    deskew_max_angle: float = 2.0
    deskew_step: float = 0.5
    # layout
    layout: str = "auto"
    column_gap_ratio: float = 0.08
    column_min_words: int = 20
    column_left_ratio: float = 0.45
    column_right_ratio: float = 0.55
    column_split: float = 0.5
    column_overlap: float = 0.02
    split_blocks: bool = False
    block_gap_ratio: float = 0.02
    block_min_ratio: float = 0.08
    block_ink_ratio: float = 0.01
    block_white_threshold: int = 245
    block_max_blocks: int = 6
    # tables
    table_mode: str = "off"
    table_backend: str = "auto"
    table_flavor: str = "lattice"
    table_header: bool = True
    # clean-up
    postprocess: bool = True
    dehyphenate: bool = True
    reflow: bool = True
    remove_hf: bool = True
    hf_top: int = 2
    hf_bottom: int = 2
    hf_min_ratio: float = 0.6
    hf_min_pages: int = 3
    hf_strip_digits: bool = True
    hf_use_layout: bool = True
    hf_top_margin: float = 0.12
    hf_bottom_margin: float = 0.12
    hf_font_max_ratio: float = 0.9
    hf_line_tolerance: float = 3.0
    remove_page_number: bool = True
    warn_short: int = 0
    warn_prefix: str = "[WARN]"
    empty_placeholder: str = "[Empty page]"
    pre_hook: str = ""
    post_hook: str = ""
    dedupe: bool = False
    dedupe_min_ratio: float = 0.6
    dedupe_min_pages: int = 3
    dedupe_min_chars: int = 80
    dedupe_strip_digits: bool = True
    replace_file: str = ""
    replace_mode: str = "plain"
    replace_ignore_case: bool = False
    auto_headings: bool = False
    heading_level: int = 2
    heading_max_len: int = 80
    # quality of recognised text
    ocr_quality: bool = True
    ocr_min_chars: int = 80
    ocr_min_alnum_ratio: float = 0.2
    ocr_max_symbol_ratio: float = 0.6
    ocr_max_replace_ratio: float = 0.02
    ocr_max_pixels: int = 0
    ocr_min_side: int = 600
    ocr_skip_large: bool = False
    # output
    out: str = ""
    title: str = ""
    include_title: bool = True
    separator: str = "\n\n---\n\n"
    page_header: str = "## Page {page}"
    include_page_header: bool = True
    page_header_in_pages: bool = False
    per_page_dir: str = ""
    merge: bool = True
    stats_out: str = ""
    config_out: str = ""
    json_out: str = ""
    # running
    cache_dir: str = ""
    cache_images: bool = False
    resume: bool = False
    retry_failed: bool = False
    retry_failed_from: str = ""
    continue_on_error: bool = False
    dry_run: bool = False
    deterministic: bool = False
    quiet: bool = False

    def settled(self) -> Config:
        """With what ``deterministic`` asks for: no chance, one worker, no second try."""
        if not self.deterministic:
            return self
        return dataclasses.replace(self, temperature=0.0, ocr_workers=1, render_workers=1, ocr_rps=0.0, page_retries=1)

    def providers(self, env_key: str = "") -> tuple[Provider, ...]:
        urls = parse_urls(self.api_url, self.api_url_fallback)
        return build_providers(urls, parse_keys(self.api_key, env_key, len(urls)))

    def models(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([m for m in [self.model, *split_csv(self.model_fallback)] if m]))

    def snapshot(self, **about) -> dict:
        """The settings with the key masked, for output beside results."""
        args = dataclasses.asdict(self)
        if args["api_key"]:
            args["api_key"] = "***"
        return {"version": VERSION, "python": sys.version.split()[0], "models": list(self.models()), "api_urls": parse_urls(self.api_url, self.api_url_fallback), **about, "args": args}


#: Choices of flags: fixed values.
CHOICES = {
    "source": ("auto", "pdf", "pages"),
    "mode": ("auto", "text", "ocr"),
    "imgfmt": ("PNG", "JPG", "JPEG"),
    "detail": ("low", "high"),
    "layout": ("auto", "single", "columns"),
    "table_mode": ("off", "auto", "only"),
    "table_backend": ("auto", "camelot", "tabula"),
    "table_flavor": ("lattice", "stream"),
    "replace_mode": ("plain", "word"),
}
#: Presets: fixed values; flags that are given win over them.
PRESETS: dict[str, dict] = {
    "fast-text": {"mode": "text", "postprocess": True, "remove_hf": True, "dehyphenate": True, "reflow": True},
    "balanced-ocr": {"mode": "auto", "adaptive_dpi": True, "ocr_quality": True, "preprocess": True},
    "scan-ocr": {"mode": "ocr", "adaptive_dpi": True, "dpi": 350, "dpi_high": 500, "preprocess": True, "denoise": True, "binarize": True, "deskew": True},
    "table-heavy": {"mode": "auto", "table_mode": "auto", "table_backend": "auto", "table_flavor": "lattice"},
    "economy": {"mode": "auto", "ocr_workers": 1, "ocr_rps": 1.0, "max_retries": 2, "page_retries": 1},
}
#: Flags whose off form has a name of its own: fixed values.
OFF = {"include_title": "--no-title", "include_page_header": "--no-page-header", "merge": "--no-merge"}


def split_csv(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def parse_urls(first: str, more: str | None) -> list[str]:
    return list(dict.fromkeys([*([first] if first else []), *split_csv(more)]))


def parse_keys(keys: str | None, env_key: str, n: int) -> list[str | None]:
    """A key for each of n addresses; one key serves all; otherwise the numbers must agree."""
    found = split_csv(keys) or ([env_key] if env_key else [])
    if not found:
        return [None] * n
    if len(found) == 1:
        found = found * n
    if len(found) != n:
        raise ValueError("The number of API keys must be that of the API addresses.")
    return [*found]


def build_providers(urls: list[str], keys: list[str | None]) -> tuple[Provider, ...]:
    """Addresses without a key are left out."""
    return tuple(Provider(u, k) for u, k in zip(urls, keys, strict=False) if k)


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}


def decode_escapes(text: str) -> str:
    r"""``\n``, ``\t``, ``\r``, ``\\`` and ``\uXXXX`` in a flag's value; anything else stays."""
    import re

    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|([ntr\\]))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES[m[2]], text)


def parser() -> argparse.ArgumentParser:
    """One flag for each field of ``Config``, made by rule."""
    out = argparse.ArgumentParser(prog="folioscope", description="Pages to Markdown on Spark.")
    out.add_argument("input", help="a PDF file, a folder of them (with --source pdf), or Parquet files with (doc_id, page, text)")
    out.add_argument("--preset", choices=list(PRESETS))
    out.add_argument("--wizard", action="store_true")
    for f in dataclasses.fields(Config):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            out.add_argument(flag, dest=f.name, action="store_true", default=argparse.SUPPRESS)
            out.add_argument(OFF.get(f.name, "--no-" + f.name.replace("_", "-")), dest=f.name, action="store_false", default=argparse.SUPPRESS)
        else:
            short = ["-o"] if f.name == "out" else []
            out.add_argument(*short, flag, dest=f.name, type=type(f.default), choices=CHOICES.get(f.name), default=argparse.SUPPRESS)
    return out


def ask(prompt: str, choices: tuple[str, ...], default: str, read=input) -> str:
    """One of the choices; an empty answer is the default, others are asked again."""
    while True:
        answer = read(f"{prompt} [{'/'.join(choices)}] ({default}): ").strip() or default
        if answer in choices:
            return answer


def wizard(read=input, interactive: bool | None = None) -> dict:
    """Settings from a few questions at a terminal."""
    if not (sys.stdin.isatty() if interactive is None else interactive):
        raise SystemExit("The wizard needs a terminal.")
    yes = lambda q, d: ask(q, ("y", "n"), d, read) == "y"
    found: dict = {"mode": ask("Mode", CHOICES["mode"], "auto", read), "table_mode": ask("Tables", CHOICES["table_mode"], "off", read)}
    found["reflow"] = yes("Join broken lines", "y")
    found["remove_hf"] = yes("Remove headers and footers", "y")
    found["dedupe"] = yes("Remove repeated paragraphs", "n")
    found["resume"] = yes("Resume from the cache", "n")
    return found


def from_args(argv: list[str] | None = None, read=input) -> tuple[str, Config]:
    """(input, settings): defaults, then the preset, then the wizard, then flags."""
    given = vars(parser().parse_args(argv))
    source, preset, asked = given.pop("input"), given.pop("preset"), given.pop("wizard")
    settings = {**PRESETS.get(preset or "", {}), **(wizard(read) if asked else {}), **given}
    if "separator" in settings:
        settings["separator"] = decode_escapes(settings["separator"])
    return source, Config(**settings).settled()

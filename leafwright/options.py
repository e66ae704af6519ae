"""Validated options, and the page-range language."""

from __future__ import annotations

from dataclasses import dataclass

ENGINES = ("auto", "hybrid", "glm", "dsocr", "ov")
SOURCES = ("local", "cloud")
DPI = (50, 600)


class PageRangeError(ValueError):
    """A page selection that cannot be met."""


def parse_pages(spec: str, total: int) -> tuple[list[int], list[str]]:
    """Distinct ascending 1-based pages of ``spec`` (``a-b`` and ``n``, comma-separated), and warnings.

    An end beyond the last page is cut to it before the range is tested.
    """
    pages: set[int] = set()
    warnings = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        ends = part.split("-")
        if len(ends) > 2:
            raise PageRangeError(f"malformed range: {part}")
        try:
            numbers = [int(e) for e in ends]
        except ValueError:
            raise PageRangeError(f"not a page number: {part}") from None
        start, end = numbers[0], numbers[-1]
        if len(ends) == 2 and end > total:
            warnings.append(f"{part}: cut to page {total}")
            end = total
        if start < 1 or start > total or end < start or end > total:
            raise PageRangeError(f"out of range: {part} of {total}")
        pages.update(range(start, end + 1))
    if not pages:
        raise PageRangeError("no page selected")
    return sorted(pages), warnings


def page_parts(spec: str) -> list[tuple[int, int]]:
    """First and last page of each part of ``spec``, as given; nothing is cut, as no document is known."""
    runs: list[tuple[int, int]] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        try:
            a, *b = map(int, part.split("-"))
        except ValueError:
            raise PageRangeError(f"not a page number: {part}") from None
        if len(b) > 1 or a < 1 or (b and b[0] < a):
            raise PageRangeError(f"malformed range: {part}")
        runs.append((a, b[0] if b else a))
    if not runs:
        raise PageRangeError("no page selected")
    return runs


def page_runs(spec: str) -> list[tuple[int, int]]:
    """First and last pages of the runs that ``spec`` selects, its parts joined where they touch."""
    joined: list[tuple[int, int]] = []
    for a, b in sorted(page_parts(spec)):
        if joined and a <= joined[-1][1] + 1:
            joined[-1] = joined[-1][0], max(b, joined[-1][1])
        else:
            joined.append((a, b))
    return joined


def page_suffix(pages: list[int]) -> str:
    """Runs of pages as ``p5-10_20``; what follows the p is cut to 80 characters."""
    runs: list[list[int]] = []
    for p in sorted(set(pages)):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "p" + "_".join(str(a) if a == b else f"{a}-{b}" for a, b in runs)[:80] if runs else ""


def request_error(engine: str = "auto", source: str | None = None, dpi=None, output_dir: str | None = None) -> str | None:
    """The first fault of a request: ``engine``, ``source``, ``dpi`` or ``output_dir``; None if there is none."""
    if engine not in ENGINES:
        return "engine"
    if source is not None and source not in SOURCES:
        return "source"
    if dpi is not None:
        try:
            dpi = int(dpi)
        except (TypeError, ValueError):
            return "dpi"
        if not DPI[0] <= dpi <= DPI[1]:
            return "dpi"
    if output_dir is not None and not output_dir.startswith("/") and ".." in output_dir.replace("\\", "/").split("/"):
        return "output_dir"
    return None


@dataclass(frozen=True)
class ExtractOptions:
    """What an extraction is asked for."""

    engine: str = "auto"
    source: str | None = None
    pages: str | None = None
    dpi: int = 150
    min_score: float = 0.3
    min_conf: float = 0.5
    text_only: bool = False
    audit: bool = False
    no_cache: bool = False
    refresh: bool = False
    keep_blank: bool = False
    output_dir: str | None = None

    def __post_init__(self):
        if fault := request_error(self.engine, self.source, self.dpi, self.output_dir):
            raise ValueError(f"{fault}: {getattr(self, fault)!r}")
        if self.source == "cloud" and self.engine in ("glm", "dsocr"):
            raise ValueError(f"source: {self.engine} has no cloud endpoint")

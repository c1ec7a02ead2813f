"""Markdown: paragraphs under their heading path."""

from __future__ import annotations

import re

from .base import MIN_BYTES, Chunk, n_bytes

MAX_SECTION = 8000
_HEADING = re.compile(r"#{1,6}(?= |$)")


def is_heading(line: str) -> bool:
    return _HEADING.match(line) is not None


def _pieces(text: str, first: int, last: int, path: str) -> list[Chunk]:
    """A section over the limit as greedy groups of its paragraphs."""
    out: list[Chunk] = []
    held, held_from, line = "", first, first
    for part in text.split("\n\n"):
        if held and n_bytes(held) + n_bytes(part) > MAX_SECTION:
            if n_bytes(t := held.strip()) >= MIN_BYTES:
                out.append(Chunk(t, held_from, line - 1, "markdown", "paragraph", path))
            held, held_from = "", line
        held = f"{held}\n\n{part}" if held else part
        line += part.count("\n") + 2
    if held and n_bytes(t := held.strip()) >= MIN_BYTES:
        out.append(Chunk(t, held_from, last, "markdown", "paragraph", path))
    return out


def chunk_markdown(content: str) -> list[Chunk]:
    """Paragraphs of at least 20 bytes, each with the headings above it; fenced blocks stay whole."""
    out: list[Chunk] = []
    headings: dict[int, str] = {}
    path, fenced, begin = "", False, 1
    held: list[str] = []

    def close() -> None:
        body = "\n".join(held).strip()
        if n_bytes(body) >= MIN_BYTES:
            text, last = (f"{path}\n\n{body}" if path else body), begin + len(held) - 1
            out.extend(_pieces(text, begin, last, path) if n_bytes(text) > MAX_SECTION else [Chunk(text, begin, last, "markdown", "section", path)])
        held.clear()

    for number, line in enumerate(content.split("\n"), 1):
        bare = line.strip()
        if bare[:3] in ("```", "~~~"):
            fenced = not fenced
        elif not fenced and (m := _HEADING.match(bare)):
            close()
            headings = {k: v for k, v in headings.items() if k < len(m[0])} | {len(m[0]): bare}
            path, begin = " > ".join(headings[k] for k in sorted(headings)), number
            continue
        elif not fenced and not bare:
            if held:
                close()
            begin = number + 1
            continue
        held.append(line)
    close()
    return out

"""What the chunkers share. Lengths are in UTF-8 bytes throughout."""

from __future__ import annotations

from dataclasses import dataclass, replace

MIN_BYTES = 20
DEFAULT_MAX_BYTES = 8192
LEAST_MAX_BYTES = 256


@dataclass(frozen=True)
class Chunk:
    text: str
    start_line: int
    end_line: int
    language: str = ""
    kind: str = ""
    symbol: str = ""


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def split_bytes(data: bytes, most: int) -> list[bytes]:
    """Pieces of at most ``most`` bytes whose concatenation is data.

    A piece ends after the last line break, or else the last space, of its final
    quarter; else before the character that would not fit. Bytes that are no
    UTF-8 are cut at the limit.
    """
    out = []
    starts = lambda at: data[at] & 0xC0 != 0x80
    at = 0
    while len(data) - at > most:
        limit = most
        while limit > max(most - 3, 1) and not starts(at + limit):
            limit -= 1
        cut = most
        if starts(at + limit):
            cut, floor = limit, at + limit - limit // 4
            for mark in (b"\n", b" "):
                if (found := data.rfind(mark, at, at + limit)) >= floor:
                    cut = found + 1 - at
                    break
        out.append(data[at : at + cut])
        at += cut
    return [*out, data[at:]] if at < len(data) else out


def cap(chunks: list[Chunk], most: int = DEFAULT_MAX_BYTES) -> list[Chunk]:
    """chunks with those over the limit replaced by fragments that keep their other fields."""
    most = max(most if most > 0 else DEFAULT_MAX_BYTES, LEAST_MAX_BYTES)
    out = []
    for c in chunks:
        if n_bytes(c.text) <= most:
            out.append(c)
        else:
            out += [replace(c, text=p.decode("utf-8", "surrogatepass")) for p in split_bytes(c.text.encode("utf-8", "surrogatepass"), most)]
    return out

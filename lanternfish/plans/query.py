"""The query language and the plan of a search; all of it runs on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

MAX_TOP_K = 1000
_FIELDS = {"lang": "languages", "language": "languages", "kind": "kinds", "chunk_kind": "kinds", "sym": "symbols", "symbol": "symbols"}
_MODES = {"lex:": "fts", "vec:": "vec"}


class Embedder(Protocol):
    """Texts to vectors of one length."""

    dimensions: int

    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class Completer(Protocol):
    """A prompt to a language model's reply."""

    def __call__(self, prompt: str, temperature: float, max_tokens: int) -> str: ...


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.languages or self.kinds or self.symbols)


@dataclass(frozen=True)
class SubQuery:
    text: str
    mode: str = "hybrid"
    filters: Filters = field(default_factory=Filters)


@dataclass(frozen=True)
class Task:
    """One search to run: a text by one or both modalities."""

    text: str
    query_source: str
    filters: Filters
    wants_vec: bool
    wants_fts: bool


def parse_filters(raw: str) -> tuple[str, Filters]:
    """Text and filters of a part; values are lower-cased, unquoted and kept once."""
    rest: list[str] = []
    found: dict[str, dict[str, None]] = {"languages": {}, "kinds": {}, "symbols": {}}
    for token in raw.split():
        key, colon, value = token.partition(":")
        value = value.strip("\"'")
        name = _FIELDS.get(key.lower())
        if colon and value and name:
            found[name].setdefault(value.lower())
        else:
            rest.append(token)
    return " ".join(rest), Filters(**{k: tuple(v) for k, v in found.items()})


def parse_query(raw: str) -> list[SubQuery]:
    """Parts of a query between " | ", each with its mode (lex:, vec: or both) and filters."""
    raw = raw.strip()
    if not raw:
        return []
    out = []
    for part in raw.split(" | "):
        part = part.strip()
        mode = _MODES.get(part[:4])
        text, filters = parse_filters(part[4:] if mode else part)
        if text or filters:
            out.append(SubQuery(text, mode or "hybrid", filters))
    return out or [SubQuery(raw)]


def effective_top_k(wanted: int, default: int = 20) -> int:
    return min(wanted if wanted > 0 else default, MAX_TOP_K)


EXPANSION = "Write up to three other search queries for the same need, one a line and nothing else.\nQuery: "


def expand(text: str, completer: Completer | None) -> list[str]:
    """The text, and up to three other lines of the model's reply; the text alone if the model fails."""
    if completer is None:
        return [text]
    try:
        reply = completer(EXPANSION + text, 0.3, 200)
    except Exception:  # a search must not fail with its model
        return [text]
    lines = [x.strip() for x in reply.split("\n")]
    return [text, *[x for x in lines if x and x != text][:3]]


def plan(raw: str, completer: Completer | None = None, expansion: bool = False) -> list[Task]:
    """The searches that a query asks for; only texts that also go to vectors are expanded."""
    out = []
    for q in parse_query(raw):
        variants = expand(q.text, completer) if expansion and q.text and q.mode != "fts" else [q.text]
        for k, text in enumerate(variants):
            out.append(Task(text, "expanded" if k else "original", q.filters, bool(text) and q.mode in ("vec", "hybrid"), q.mode in ("fts", "hybrid")))
    return out

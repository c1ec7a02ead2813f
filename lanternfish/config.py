"""Settings of an engine, from TOML or by hand, checked when they are made."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Folder:
    """A folder to index; None inherits a setting, an empty list is none."""

    path: str
    description: str = ""
    context: dict[str, str] = field(default_factory=dict)
    exclude_patterns: tuple[str, ...] | None = None
    include_patterns: tuple[str, ...] | None = None
    max_file_size_kb: int = 0


@dataclass(frozen=True)
class Settings:
    folders: tuple[Folder, ...] = ()
    model: str = "hash"
    dimensions: int = 64
    quantization: str = "int8"
    max_input_bytes: int = 8192
    batch_size: int = 64
    batch_max_bytes: int = 65_536
    rrf_k: int = 60
    similarity_threshold: float = 0.3
    default_top_k: int = 20
    vec_weight: float = 1.0
    fts_weight: float = 1.1
    original_query_weight: float = 1.0
    expanded_query_weight: float = 0.25
    embedding_timeout: float = 5.0
    query_expansion: bool = False
    rerank: bool = True
    rerank_top_n: int = 20
    rerank_top_weight: float = 0.8
    rerank_bottom_weight: float = 0.2
    min_score: float = 0.005
    exclude_patterns: tuple[str, ...] = (".git", "node_modules", "vendor", "__pycache__", ".venv")
    include_patterns: tuple[str, ...] = ()
    max_file_size_kb: int = 512

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.dimensions > 0, "dimensions must be positive")
        need(self.quantization in ("int8", "float32"), "quantization is int8 or float32")
        need(self.max_input_bytes > 0, "max_input_bytes must be positive")
        need(self.batch_size > 0 and self.batch_max_bytes > 0, "batches need positive limits")
        need(self.rrf_k >= 0, "rrf_k must not be negative")
        need(0 <= self.similarity_threshold <= 1, "similarity_threshold lies in 0..1")
        need(1 <= self.default_top_k <= 1000, "default_top_k lies in 1..1000")
        for name in ("vec_weight", "fts_weight", "original_query_weight", "expanded_query_weight", "min_score"):
            need(0 <= getattr(self, name) < float("inf"), f"{name} must be a number from 0 on")
        need(self.embedding_timeout > 0, "embedding_timeout must be positive")
        need(self.rerank_top_n > 0, "rerank_top_n must be positive")
        for name in ("rerank_top_weight", "rerank_bottom_weight"):
            need(0 <= getattr(self, name) <= 1, f"{name} lies in 0..1")
        need(self.rerank_bottom_weight <= self.rerank_top_weight, "rerank_bottom_weight is over rerank_top_weight")
        need(self.max_file_size_kb > 0, "max_file_size_kb must be positive")
        need(all(f.path for f in self.folders), "a folder needs a path")
        need(len({f.path for f in self.folders}) == len(self.folders), "a folder is named twice")

    def for_folder(self, folder: Folder) -> dict:
        """What scanning a folder goes by."""
        return {
            "exclude": self.exclude_patterns if folder.exclude_patterns is None else folder.exclude_patterns,
            "include": self.include_patterns if folder.include_patterns is None else folder.include_patterns,
            "max_kb": folder.max_file_size_kb or self.max_file_size_kb,
        }


def _plain(value):
    return tuple(value) if isinstance(value, list) else value


def from_dict(data: dict) -> Settings:
    """Settings of nested tables; unknown names are an error, folder paths are made absolute."""
    flat = {k: _plain(v) for section in data.values() if isinstance(section, dict) for k, v in section.items()}
    flat |= {k: _plain(v) for k, v in data.items() if not isinstance(v, (dict, list))}
    known = {f.name for f in fields(Settings)}
    if extra := sorted(set(flat) - known):
        raise ValueError(f"unknown settings: {', '.join(extra)}")
    folders = tuple(Folder(**{k: _plain(v) for k, v in f.items()}) for f in data.get("folders", []))
    folders = tuple(replace(f, path=os.path.realpath(os.path.expanduser(f.path))) for f in folders)
    return Settings(folders=folders, **flat)


def load(path: str) -> Settings:
    with open(os.path.expanduser(path), "rb") as f:
        return from_dict(tomllib.load(f))

"""Tokenizers and phrase matching as Column expressions, and their driver-side twins."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, digits and underscores in a query.
_QUERY_RUN = r"[\p{L}\p{N}_]+"
#: Edges inside an identifier: lower or digit to upper, and the last capital of an acronym.
_CAMEL = r"(?<=[^\p{Lu}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
_ACCENTED = "".join(chr(c) for c in [*range(0xC0, 0x180), *range(0x1CD, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.normalize("NFD", chr(c))[0] != chr(c))
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def fold(text: Column) -> Column:
    """Lower case without accents: composed letters lose theirs, combining marks go. ASCII has none to lose."""
    plain = F.translate(F.lower(F.regexp_replace(text, r"\p{Mn}+", "")), _ACCENTED + _ACCENTED.lower(), (_PLAIN + _PLAIN.lower()).lower())
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(plain)


def index_tokens(text: Column) -> Column:
    """Tokens of an indexed text in order: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def split_camel(token: Column) -> Column:
    return F.filter(F.split(token, _CAMEL), lambda x: x != "")


def query_tokens(text: Column) -> Column:
    """Tokens of a query: of each identifier its parts, then itself; lower-cased, first occurrence kept."""

    def parts(run: Column) -> Column:
        pieces = F.flatten(F.transform(F.filter(F.split(run, "_"), lambda s: s != ""), split_camel))
        return F.when(F.size(pieces) > 1, F.concat(pieces, F.array(run))).otherwise(F.array(run))

    runs = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_QUERY_RUN), F.lit(0)), lambda r: F.regexp_replace(r, "_", "") != "")
    return F.array_distinct(F.transform(F.flatten(F.transform(runs, parts)), F.lower))


def _split_camel(token: str) -> list[str]:
    out, begin = [], 0
    for i in range(1, len(token)):
        here, before = token[i], token[i - 1]
        if here.isupper() and (not before.isupper() or (i + 1 < len(token) and token[i + 1].islower())):
            out.append(token[begin:i])
            begin = i
    return [*out, token[begin:]] if token else []


def tokenize_query(text: str) -> list[str]:
    """query_tokens on the driver, for one query."""
    out: dict[str, None] = {}
    for run in re.findall(r"\w+", text):
        if not run.strip("_"):
            continue
        pieces = [p for s in run.split("_") if s for p in _split_camel(s)]
        for t in [*(pieces if len(pieces) > 1 else []), run]:
            out.setdefault(t.lower())
    return list(out)


def tokenize_index(text: str) -> list[str]:
    """index_tokens on the driver, for one text."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", plain.lower())


def phrase_count(tokens: Column, phrase: list[str], prefix: bool = False) -> Column:
    """How often a phrase stands in an array of tokens; with prefix, its last token is the beginning of one."""
    if not phrase:
        return F.lit(0)
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t.startswith(phrase[0]) if prefix else t == phrase[0]))
    # Over the joined tokens the array is read once; a look-ahead lets occurrences overlap.
    mark = "\x01"
    rest = "".join(mark + re.escape(t) for t in phrase[1:]) + ("" if prefix else mark)
    joined = F.concat(F.lit(mark), F.array_join(tokens, mark), F.lit(mark))
    return F.regexp_count(joined, F.lit(f"{mark}{re.escape(phrase[0])}(?={rest})"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell pattern in which * and ? stay inside a path segment."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("^", "!") else i + 1)) > i:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] in "^!" else inside) + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"


def is_glob(text: str) -> bool:
    return any(c in text for c in "*?[")


def matches_glob(path: Column, glob: str) -> Column:
    """Whether a glob fits the whole path or its last segment."""
    pattern = glob_pattern(glob)
    return path.rlike(pattern) | F.element_at(F.split(path, "/"), -1).rlike(pattern)

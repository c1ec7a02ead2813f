"""Source code by its definitions.

Python is parsed with its own grammar. Other languages are cut at the headers of
top-level definitions, found by pattern and closed by balanced brackets; that is
approximate where a bracket stands in a string.
"""

from __future__ import annotations

import ast
import re

from .base import MIN_BYTES, Chunk, n_bytes

LANGUAGES = {".go": "go", ".py": "python", ".rs": "rust", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".lisp": "commonlisp", ".cl": "commonlisp", ".asd": "commonlisp"}
MAX_NODE = 8000

_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_HEADERS: dict[str, list[tuple[str, re.Pattern]]] = {
    "go": [("method_declaration", re.compile(rf"func\s+\([^)]*\)\s*{_NAME}")), ("function_declaration", re.compile(rf"func\s+{_NAME}")), ("type_declaration", re.compile(rf"type\s+{_NAME}"))],
    "rust": [("function_item", re.compile(rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+{_NAME}")), ("impl_item", re.compile(rf"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?{_NAME}")), ("trait_item", re.compile(rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_NAME}")), ("struct_item", re.compile(rf"(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}")), ("enum_item", re.compile(rf"(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}")), ("mod_item", re.compile(rf"(?:pub(?:\([^)]*\))?\s+)?mod\s+{_NAME}"))],
    "javascript": [("function_declaration", re.compile(rf"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\*?\s+{_NAME}")), ("class_declaration", re.compile(rf"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+{_NAME}")), ("lexical_declaration", re.compile(rf"(?:export\s+)?(?:const|let|var)\s+{_NAME}"))],
    "commonlisp": [("list_lit", re.compile(r"\(\s*(?:def[\w-]*|define-[\w-]+)\s+\(?(?P<name>[^\s()]+)"))],
}
_HEADERS["typescript"] = _HEADERS["tsx"] = [("interface_declaration", re.compile(rf"(?:export\s+(?:default\s+)?)?interface\s+{_NAME}")), ("type_alias_declaration", re.compile(rf"(?:export\s+)?type\s+{_NAME}")), ("enum_declaration", re.compile(rf"(?:export\s+)?(?:const\s+)?enum\s+{_NAME}")), *_HEADERS["javascript"]]
_MEMBER = {
    "rust": ("function_item", _HEADERS["rust"][0][1], ("impl_item", "trait_item")),
    "javascript": ("method_definition", re.compile(rf"(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*\*?{_NAME}\s*(?:<[^>]*>)?\([^;]*\)?[^;=]*\{{"), ("class_declaration",)),
}
_MEMBER["typescript"] = _MEMBER["tsx"] = _MEMBER["javascript"]
_CONTROL = {"if", "for", "while", "switch", "catch", "function", "return", "with"}


def _made(lines: list[str], first: int, last: int, language: str, kind: str, symbol: str) -> list[Chunk]:
    """Lines [first, last] as a chunk, by parts at blank lines where they are too many."""
    text = "\n".join(lines[first : last + 1]).strip("\n")
    if n_bytes(text.strip()) < MIN_BYTES:
        return []
    if n_bytes(text) <= MAX_NODE:
        return [Chunk(text, first + 1, last + 1, language, kind, symbol)]
    out, begin, size = [], first, 0
    for i in range(first, last + 1):
        size += n_bytes(lines[i]) + 1
        if size > MAX_NODE // 2 and (not lines[i].strip() or size > MAX_NODE - 200) or i == last:
            part = "\n".join(lines[begin : i + 1]).strip("\n")
            if n_bytes(part.strip()) >= MIN_BYTES:
                out.append(Chunk(part, begin + 1, i + 1, language, kind, symbol))
            begin, size = i + 1, 0
    return out


def _python(content: str) -> list[Chunk]:
    tree, lines, out = ast.parse(content), content.split("\n"), []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def span(node) -> tuple[int, int]:
        return min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1, node.end_lineno - 1

    for node in tree.body:
        if isinstance(node, functions):
            out += _made(lines, *span(node), "python", "decorated_definition" if node.decorator_list else "function_definition", node.name)
        elif isinstance(node, ast.ClassDef):
            first, last = span(node)
            methods = [m for m in node.body if isinstance(m, functions)]
            inner = [c for m in methods for c in _made(lines, *span(m), "python", "function_definition", f"{node.name}.{m.name}")]
            if not inner:
                out += _made(lines, first, last, "python", "class_definition", node.name)
                continue
            taken = {i for m in methods for i in range(span(m)[0], span(m)[1] + 1)}
            head = "\n".join(lines[i] for i in range(first, last + 1) if i not in taken).strip()
            if n_bytes(head) >= MIN_BYTES:
                out.append(Chunk(head, first + 1, max(first, min(taken) - 1) + 1, "python", "class_definition", node.name))
            out += inner
    return out


def _end_of(lines: list[str], first: int, language: str, last: int) -> int:
    """Last line of a definition: where its brackets balance again."""
    pairs = ("()", ) if language == "commonlisp" else ("{}", "()")
    depth, opened = 0, False
    for i in range(first, last + 1):
        code = lines[i].split(";")[0] if language == "commonlisp" else lines[i].split("//")[0]
        depth += sum(code.count(p[0]) - code.count(p[1]) for p in pairs)
        opened = opened or (pairs[0][0] in code)
        if depth <= 0 and (opened or code.rstrip().endswith(";") or (language == "go" and depth == 0)):
            return i
    return last


def _definitions(lines: list[str], language: str) -> list[Chunk]:
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        found = next(((k, m) for k, p in _HEADERS[language] if (m := p.match(line))), None)
        if found is None:
            i += 1
            continue
        kind, m = found
        end = _end_of(lines, i, language, len(lines) - 1)
        out += _inside(lines, i, end, language, kind, m["name"])
        i = end + 1
    return out


def _inside(lines: list[str], first: int, last: int, language: str, kind: str, name: str) -> list[Chunk]:
    """A container by its members after what stands around them; anything else whole."""
    member = _MEMBER.get(language)
    if member is None or kind not in member[2]:
        return _made(lines, first, last, language, kind, name)
    inner, taken, i = [], set(), first + 1
    while i < last:
        m = member[1].match(lines[i].strip())
        if m and m["name"] not in _CONTROL:
            end = _end_of(lines, i, language, last)
            made = _made(lines, i, end, language, member[0], f"{name}.{m['name']}")
            inner += made
            taken |= set(range(i, end + 1))
            i = end
        i += 1
    if not inner:
        return _made(lines, first, last, language, kind, name)
    head = "\n".join(lines[k] for k in range(first, last + 1) if k not in taken).strip()
    top = [Chunk(head, first + 1, min(taken), language, kind, name)] if n_bytes(head) >= MIN_BYTES else []
    return [*top, *inner]


def chunk_code(content: str, language: str) -> list[Chunk] | None:
    """Chunks of the definitions of a file; None if it can't be parsed, empty if it has none."""
    if language == "python":
        try:
            return _python(content)
        except (SyntaxError, ValueError):
            return None
    return _definitions(content.split("\n"), language)

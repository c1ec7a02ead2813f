import json
import random

import pytest

from lanternfish.operators.chunking import chunk_file
from lanternfish.operators.chunking.base import Chunk, cap, split_bytes
from lanternfish.operators.chunking.formats import window_chunks
from lanternfish.operators.chunking.session import chunk_session, session_turns, split_turn
from lanternfish.operators.chunking.source import chunk_source, windows


def test_markdown():
    text = "# A\n\nthe first paragraph of text\n\n## B\n\nshort\n\n```\n# no heading in here\n\nstill inside\n```\n\n#hashtag is ordinary text\n# C\n"
    got = chunk_file("x.MD", text)
    assert [(c.symbol, c.start_line, c.end_line) for c in got] == [("# A", 3, 3), ("# A > ## B", 9, 13), ("# A > ## B", 15, 15)]
    assert got[0].text == "# A\n\nthe first paragraph of text"
    big = chunk_file("x.md", "# T\n" + "word " * 3000)
    assert big and all(c.symbol == "# T" for c in big) and "".join(c.text for c in big).count("word") == 3000


def test_cap_is_identity():
    rng = random.Random(4)
    for _ in range(100):
        data = "".join(rng.choice("ab \né日😀") for _ in range(rng.randrange(0, 900))).encode()
        parts = split_bytes(data, 256)
        assert b"".join(parts) == data and all(len(p) <= 256 for p in parts)
        assert all(p.decode() is not None for p in parts)
    assert [len(p) for p in split_bytes(b"\x80" * 600, 256)] == [256, 256, 88]
    out = cap([Chunk("x" * 1000, 1, 9, "go", "k", "s")], 400)
    assert [len(c.text) for c in out] == [400, 400, 200] and {c.symbol for c in out} == {"s"}


def test_source_windows():
    lines = [f"line number {i} of the file" for i in range(70)]
    assert [(c.start_line, c.end_line) for c in windows(lines)] == [(1, 30), (26, 55), (51, 70)]
    got = chunk_source("\n".join(lines))
    assert got[0].start_line == 1 and got[-1].end_line == 70
    covered = {i for c in got for i in range(c.start_line, c.end_line + 1)}
    assert covered == set(range(1, 71))
    assert chunk_source("") == []


def test_code():
    py = "class A:\n    '''a class with a docstring'''\n    def first(self):\n        return 'something'\n\ndef free():\n    return 'another thing'\n"
    assert [(c.kind, c.symbol) for c in chunk_file("a.py", py)] == [("class_definition", "A"), ("function_definition", "A.first"), ("function_definition", "free")]
    rs = "impl Foo {\n    fn bar(&self) -> i32 {\n        self.x + 1\n    }\n}\n"
    assert [c.symbol for c in chunk_file("a.rs", rs)] == ["Foo.bar"]
    assert chunk_file("bad.py", "def broken(:\n  some text that is long enough\n")[0].kind == "window"


def _line(kind, text, **more):
    return json.dumps({"type": kind, "message": {"role": kind, "content": text}, **more})


def test_sessions():
    log = "\n".join([_line("assistant", "before any user"), "not json", _line("user", "how do I open the store?", slug="quick-fox"), _line("assistant", [{"type": "text", "text": "like"}, {"type": "tool", "text": "no"}, {"type": "text", "text": "this"}]), _line("user", "hm"), _line("user", "and how to close it again?")])
    got = chunk_session(log)
    assert [(c.symbol, c.text) for c in got] == [("quick-fox#1", "User: how do I open the store?\n\nAssistant: like\n\nthis"), ("quick-fox#3", "User: and how to close it again?")]
    assert chunk_session('{"a": 1}\n{"b": 2}') is None
    assert chunk_file("x.jsonl", '{"some": "record", "of": "another kind"}')[0].kind == "window"
    nested = "\n".join([json.dumps({"type": "session", "id": "0123456789"}), json.dumps({"type": "message", "message": {"role": "user", "content": "a question of some length"}})])
    assert [c.symbol for c in chunk_session(nested)] == ["01234567#1"]
    parts = split_turn("p" * 7000 + "\n\nq", 3, 3, "s")
    assert [(c.start_line, c.end_line, len(c.text)) for c in parts] == [(3, 3, 3000), (4, 4, 3000), (5, 5, 1003)]


def test_session_table(spark):
    rows = [(1, 0, "assistant", "early"), (1, 1, "user", "a question that is long"), (1, 2, "system", "x"), (1, 3, "assistant", "one"), (1, 4, "assistant", "two"), (1, 5, "user", "no"), (2, 0, "user", None)]
    got = session_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["symbol"], r["chunk_text"], r["start_line"], r["end_line"]) for r in got] == [("1#1", "User: a question that is long\n\nAssistant: one\n\ntwo", 1, 4)]


@pytest.mark.parametrize("n", [1, 29, 30, 31, 55, 56, 80])
def test_window_table_equals_windows(spark, n):
    text = "\n".join(f"some line of text {i}" for i in range(n))
    got = window_chunks(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").orderBy("line_num").collect()
    assert [(r["line_num"], r["end_line"], r["chunk_text"]) for r in got] == [(c.start_line, c.end_line, c.text) for c in windows(text.split("\n"))]

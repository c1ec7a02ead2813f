"""Small tables with every hard case, and slow versions of what the operators compute."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


def split(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=4000):
    """n words that hardly repeat."""
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{r.choice('abcdefgh')}" for _ in range(n))


def hard_texts():
    """Null, empty, blank, short, tied, repeated, very long and many-byte texts."""
    base = prose(1, 300)
    ws = base.split(" ")
    near = " ".join([*ws[:150], "changed", *ws[151:]])
    far = " ".join(["x" if i % 9 == 0 else w for i, w in enumerate(ws)])
    long_text = prose(2, 30_000)
    shared = prose(3, 60)
    return [
        None,
        "",
        " \t\n ",
        "one",
        "one two three",
        "One TWO three",
        base,
        base.upper(),
        near,
        near,
        far,
        long_text,
        long_text + " tail",
        f"{prose(4, 40)} {shared} {prose(5, 40)}",
        f"{prose(6, 30)}\n{shared}\n{prose(7, 50)}",
        f"{prose(8, 12)} {shared}",
        "Überläufe größer ñandú 東京 🙂 ﷽ <|endoftext|> it's we'll 123 456 x　y \u0085 z",
        "a\n" * 80,
        "spam ham eggs toast " * 90,
        "x" * 5000,
        "tab\tand\x0bvertical\x0cfeed\x1cgroup line",
    ]


def documents(spark, rows=None):
    """A documents table; each row (doc_id, text, source)."""
    if rows is None:
        rows = [(3 * i + 1, t, None if i % 7 == 5 else f"s{i % 3}") for i, t in enumerate(hard_texts())]
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCS)


def shingle_set(text, n=5):
    ws = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def brute_components(rows, percent=85):
    """{doc_id: (size of its set, smallest doc_id reachable)} over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_removed(rows, window=13):
    """{doc_id: (words, kept words)} by looking at every window of every document."""
    first = {}
    for i, t in rows:
        ws = split(t)
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            first[w] = min(i, first.get(w, i))
    out = {}
    for i, t in rows:
        ws = split(t)
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(ws), [w for w, g in zip(ws, gone) if not g])
    return out


def same_rows(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))

"""Operator 7: the main text of a page by a maximum-scoring subsequence.

A page is read as runs of words and tags. A word scores by the elements that it
stands in, a tag costs; one linear scan finds the contiguous region with the
highest sum. Inside it, blocks of elements whose words score below zero (a form or
an advert in an article) are left out; all others are the text.

Weights come from pages whose markup labels their content (``article`` or
``main``): of an element's tag and each of its class and id names, the log-odds
that words in it are content. Words inside the labelled content speak for all
elements around them; words outside speak against the outermost element that
holds no labelled content, so a menu explains its lists, and lists elsewhere
stay neutral. Names that no labelled page has seen get a prior of a few words
from what such names usually mean.

The fit reads ``SAMPLE`` pages (those with the smallest hash of page_id); names
are hashed to ``NAMES`` slots, so what comes to the driver has a fixed size. Every
page is then judged alone, without a shuffle, in time linear in its length.

Defined cases: null or empty html gives an empty text; equal rows give equal
rows; extra columns are ignored; without labelled pages in the sample the priors
decide; of regions with equal sums the first counts; a tag, comment or script that
never ends takes the rest of the page, as in browsers; a quote that never closes
is an ordinary character.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE = 1000
NAMES = 1 << 16

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)(>?)|!--|[!?])")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""(?<![^\s"'/])(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*+=\s*+["']?true|display\s*+:\s*+none""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title iframe noscript xmp noembed".split())
_CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in _RAW}
#: Elements that hold no article text by their meaning.
_NEVER = frozenset("head nav aside footer form template button select svg dialog menu object audio video canvas map datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that are followed as such; others only if they have names.
_CONTAINER = frozenset("article aside body div dl fieldset figure footer form header html li main nav ol section table td th ul".split()) | _NEVER
_LABELLED = frozenset(("article", "main"))
_TAGS = _BLOCK | _VOID | _NEVER | _RAW | frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())

#: Words by which names of what is not the article usually begin or end, and those by which names of content end.
_JUNK_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
_CONTENT_NAMES = frozenset("article body content entry headline main news post posts story text title".split())
#: Words of belief in a prior, the score of a word in a page without weights, and that of a word in a hidden element; costs of tags.
PRIOR, DEFAULT_WORD, HIDDEN_WORD, DEFAULT_TAG, LABELLED_TAG = 20, 1.0, -8.0, -0.5, -0.01


def _after_equals(html: str, at: int) -> bool:
    """Whether a quote opens a value: an equals sign stands before it, a little white space between at most."""
    return html[max(0, at - 16) : at].rstrip()[-1:] == "="


def tags(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order; kind is "text", "open", "close" or "raw"."""
    at, n, unclosed = 0, len(html), set()
    while at < n:
        m = _OPEN.search(html, at)
        if m is None:
            yield "text", html[at:], ""
            return
        if m.start() > at:
            yield "text", html[at : m.start()], ""
        at = m.end()
        if m[2] is None:
            end = html.find("-->", at - 2 if html.startswith("<!-->", m.start()) else at) if m[0] == "<!--" else html.find(">", at)
            if end < 0:
                return
            at = end + (3 if m[0] == "<!--" else 1)
            continue
        attributes = m[3]
        if not m[4]:
            # A quoted value may hold a ">"; whatever the scan passes is never read again.
            while (stop := _STOP.search(html, at)) is not None and stop[0] != ">":
                at = stop.end()
                if stop[0] not in unclosed and _after_equals(html, stop.start()):
                    close = html.find(stop[0], at)
                    if close < 0:
                        unclosed.add(stop[0])
                    else:
                        at = close + 1
            if stop is None:
                return
            at = stop.end()
            attributes = html[m.start(3) : stop.start()]
        name = m[2].lower()
        if name in _RAW and not m[1]:
            yield "raw", name, ""
            if (close := _CLOSERS[name].search(html, at)) is None:
                return
            end = html.find(">", close.end())
            if end < 0:
                return
            at = end + 1
        else:
            yield "close" if m[1] else "open", name, attributes


class Node:
    """An open element: its keys, and the score of a word in it."""

    __slots__ = ("bad", "good", "holds", "inside", "keys", "labelled", "never", "outside", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, keys: tuple[str, ...]):
        self.tag, self.parent, self.keys = tag, parent, keys
        self.bad, self.good = (parent.bad, parent.good) if parent else (0.0, DEFAULT_WORD)
        self.labelled = tag in _LABELLED or (parent is not None and parent.labelled)
        self.never = tag in _NEVER or (parent is not None and parent.never)
        self.inside = self.outside = 0
        self.holds = False  # whether labelled content stands in it


def _names(attributes: str) -> list[str]:
    return [n for a, b, c in _NAMED.findall(attributes) for n in (a or b or c).split()] if attributes else []


def _prior(name: str) -> float:
    """Words of belief that what has this name is not the article."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return PRIOR if parts and parts[-1] not in _CONTENT_NAMES and (parts[0] in _JUNK_NAMES or parts[-1] in _JUNK_NAMES) else 0


def _slot(name: str) -> str:
    return f"#{zlib.crc32(name.lower().encode('utf-8', 'surrogatepass')) % NAMES}"


class Weights:
    """Scores of elements and tags from counts {key: (words or tags inside labelled content, outside)}."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts
        self._known: dict[str, float] = {}
        self.tag = {t: -0.05 + max(-8.0, min(0.0, self._odds(f"t:{t}", 0))) / 4 if f"t:{t}" in counts else DEFAULT_TAG for t in (*_TAGS, "other")}

    def _odds(self, key: str, prior: float) -> float:
        inside, outside = self.counts.get(key, (0, 0))
        return max(-8.0, min(3.0, math.log((inside + 0.5) / (outside + prior + 0.5))))

    def of_tag(self, tag: str) -> float:
        return self._odds(f"w:{tag}", PRIOR if tag in _NEVER or tag == "header" else 0)

    def of_name(self, name: str) -> float:
        if (w := self._known.get(name)) is None:
            if len(self._known) > 100_000:
                self._known.clear()
            w = self._known[name] = self._odds(_slot(name), _prior(name))
        return w

    def enter(self, node: Node, names: list[str], hidden: bool) -> None:
        """Sets the scores of a new element."""
        own = [self.of_name(n) for n in names]
        if not names or node.tag in _NEVER or node.tag in _LABELLED or node.tag == "header":
            own.append(0.0 if node.tag == "header" and node.labelled else self.of_tag(node.tag))
        if node.tag in _LABELLED:
            node.bad = 0.0
        node.bad = min(node.bad, HIDDEN_WORD if hidden else 0.0, *own)
        node.good = max([x for x in own if x > 0] or [node.good])


def walk(html: str, learned: Weights | None = None) -> Iterator[tuple[str, Node, str]]:
    """(what, element, text) in page order; what is "text" or the name of a tag."""
    root = Node("html", None, ("w:html",))
    stack, opened = [root], {"html": 1}
    for kind, name, attributes in tags(html):
        if kind == "text":
            yield "text", stack[-1], name
            continue
        if kind == "close":
            if opened.get(name):
                while stack[-1].tag != name:
                    opened[stack.pop().tag] -= 1
                if len(stack) > 1:
                    opened[stack.pop().tag] -= 1
        elif kind == "open" and name not in _VOID and name != "html":
            if name in _BLOCK and stack[-1].tag == "p":
                opened[stack.pop().tag] -= 1
            names, hidden = _names(attributes), bool(attributes and _HIDDEN.search(attributes))
            if (name in _CONTAINER or names or hidden) and not attributes.endswith("/"):
                keys = tuple(map(_slot, names)) if names else ("w:" + (name if name in _TAGS else "other"),)
                node = Node(name, stack[-1], keys)
                if learned is not None:
                    learned.enter(node, names, hidden)
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1
        yield name, stack[-1], ""


def counts(html: str) -> dict[str, list[int]]:
    """Words by element and tags by name: [inside, outside] labelled content; empty for an unlabelled page."""
    nodes: dict[Node, None] = {}
    out: dict[str, list[int]] = {}
    for what, node, text in walk(html):
        fresh = node
        while fresh is not None and fresh not in nodes:
            nodes[fresh] = None
            fresh = fresh.parent
        content = node.labelled and not node.never
        if what == "text":
            if content:
                node.inside += len(text.split())
            else:
                node.outside += len(text.split())
        else:
            out.setdefault("t:" + (what if what in _TAGS else "other"), [0, 0])[not content] += 1
    order = _parents_first(nodes)
    for node in reversed(order):
        if node.parent is not None:
            node.parent.inside += node.inside
            node.parent.holds = node.parent.holds or node.holds or node.tag in _LABELLED
    if not any(n.tag in _LABELLED for n in order):
        return {}
    blamed: dict[Node, Node] = {}
    for node in order:
        # The outermost element that neither holds labelled content nor is it; in such content, the outermost one that never is.
        above = blamed.get(node.parent) if node.parent is not None else None
        free = not node.holds and not (node.labelled and not node.never)
        if above is not None or free:
            blamed[node] = above or node
        for key in node.keys:
            out.setdefault(key, [0, 0])[0] += node.inside
        for key in blamed.get(node, node).keys:
            out.setdefault(key, [0, 0])[1] += node.outside
    return out


def _parents_first(nodes) -> list[Node]:
    depth: dict[Node, int] = {}
    for node in nodes:
        chain = []
        while node is not None and node not in depth:
            chain.append(node)
            node = node.parent
        for below in reversed(chain):
            depth[below] = depth[below.parent] + 1 if below.parent is not None else 0
    return sorted(depth, key=depth.__getitem__)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous run with the highest positive sum, the first of several; (0, -1) without one."""
    best, total, begin, found = 0.0, 0.0, 0, (0, -1)
    for i, s in enumerate(scores):
        if total <= 0.0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, found = total, (begin, i)
    return found


def scored(html: str, learned: Weights) -> tuple[list[float], list[list[tuple[int, str, bool]]]]:
    """The score of every run of words and every tag, and all blocks of text as (place, text, whether its words score below zero)."""
    scores: list[float] = []
    blocks: list[list[tuple[int, str, bool]]] = []
    block: list | None = None
    for i, (what, node, text) in enumerate(walk(html, learned)):
        if what == "text":
            # Junk in labelled content is left out, but doesn't end it.
            scores.append(len(text.split()) * (node.good if node.bad >= 0.0 else 0.0 if node.labelled else node.bad))
            if block is None:
                block = []
                blocks.append(block)
            block.append((i, text, node.bad < 0.0))
        else:
            cost = learned.tag[what if what in _TAGS else "other"]
            # In labelled content tags cost so little that no block at its ends is worth less.
            scores.append(max(cost, LABELLED_TAG) if node.labelled else cost)
            if what in _BLOCK:
                block = None
            elif what == "br" and block is not None:
                block.append((i, " ", False))
    return scores, blocks


def extract(html: str | None, learned: Weights) -> str:
    """The main text of a page: blocks of the best region, one a line."""
    if not html:
        return ""
    scores, blocks = scored(html, learned)
    lo, hi = best_region(scores)
    lines = (" ".join(unescape("".join(t for k, t, junk in block if lo <= k <= hi and not junk)).split()) for block in blocks)
    return "\n".join(x for x in lines if x)


def fit(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from at most ``sample`` pages with distinct page_id."""
    chosen = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for b in batches:
            for html in b.column(0).to_pylist():
                for k, (inside, outside) in counts(html or "").items():
                    at = total.setdefault(k, [0, 0])
                    at[0] += inside
                    at[1] += outside
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *[pa.array([v[j] for v in total.values()], pa.int64()) for j in (0, 1)]], ["key", "inside", "outside"])

    htmls = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id", "left_semi").select("html")
    rows = htmls.mapInArrow(run, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return Weights({r["key"]: (r["inside"], r["outside"]) for r in rows})


def main_text(pages: DataFrame, learned: Weights | None = None) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    learned = fit(pages) if learned is None else learned
    slim = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, learned) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

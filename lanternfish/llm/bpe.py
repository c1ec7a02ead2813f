"""Byte-pair merges as a left-to-right automaton.

A sequence of tokens is the encoding of a text if and only if each neighbouring
pair is the encoding of its own concatenation. So the last token of every prefix
is unique, and it follows from the last tokens of shorter prefixes alone: no
merge has to be undone as text goes on. Both tokenizer operators rest on this.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable


class Merger:
    """Merges of one vocabulary.

    ``rank(left, right)`` is the order in which two neighbours merge, lower
    first, or None where they never do; equal ranks merge from the left.
    """

    #: Remembered answers; beyond it they are forgotten and worked out anew.
    LIMIT = 400_000

    def __init__(self, rank: Callable[[str, str], float | None]):
        self.rank = rank
        #: Answers of ``valid`` so far.
        self.known: dict[tuple[str | None, str], bool] = {}
        self._split: dict[str, tuple[str, str, float] | tuple[()] | None] = {}

    def merge(self, text: str) -> list[str]:
        """The encoding by merging, in O(n log n)."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str, float] | tuple[()]]:
        """The encoding, and the last merge with its rank."""
        parts: list[str] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, str]] = []
        last: tuple[str, str, float] | tuple[()] = ()

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := self.rank(parts[i], parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if parts[i] != a or (j := after[i]) >= n or parts[j] != b:
                continue
            last = (a, b, r)
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p], last

    def split(self, token: str) -> tuple[str, str, float] | tuple[()] | None:
        """The merge that completes a token: (left, right, rank); () for one character, None if merging never yields it."""
        try:
            return self._split[token]
        except KeyError:
            parts, last = self._merge(token)
            out = self._split[token] = last if parts == [token] else None
            return out

    def valid(self, left: str | None, token: str) -> bool:
        """Whether token may stand after left (None: at the beginning)."""
        try:
            return self.known[left, token]
        except KeyError:
            if len(self.known) > self.LIMIT:
                self.known.clear()
            out = self.known[left, token] = self.split(token) is not None and (left is None or self._apart(left, token))
            return out

    def _apart(self, a: str, b: str) -> bool:
        """Whether no merge ever joins the two.

        The merges that made both are undone, the latest first (of equal ranks
        the right one). At each step the tokens that touch must not merge before
        the merge just undone would have taken one of them away.
        """
        limit, strict = float("inf"), False
        sa, sb = self.split(a), self.split(b)
        while True:
            if (r := self.rank(a, b)) is not None and (r < limit or (r == limit and not strict)):
                return False
            if not sa and not sb:
                return True
            if sb and (not sa or sb[2] >= sa[2]):
                b, limit, strict = sb[0], sb[2], False
                sb = self.split(b)
            else:
                a, limit, strict = sa[1], sa[2], True
                sa = self.split(a)


#: Stands between parts of a text that are encoded apart; no token holds it.
SEP = "\0"
#: The last token of a prefix that no path reaches, once a first token is fixed.
_DEAD = ""


class Transducer:
    """The last token of every prefix of a text, and by how many tokens each letter changes their number.

    A state keeps what a longer token could still absorb, the last token at each
    place in it, and the counts there relative to the newest. Its transitions are
    deterministic and carry the change of the count (a merge can lower it). States
    are made when first reached and remembered up to a bound, since a table over
    all reachable states would be far larger than any corpus needs.

    A cut in a text is crossed in a state (before, after): the token over the
    cut has so many letters on both sides of it. The map of a chunk gives, for
    each state in which it can be entered and each in which it can be left, how many
    tokens begin inside; see ``matrix``.
    """

    STATES = 160_000

    def __init__(self, tokens, merger: Merger):
        self.tokens, self.merger = frozenset(tokens), merger
        self.open = {t[:k] for t in tokens for k in range(1, len(t))}
        self.longest = max(map(len, tokens), default=1)
        self._ends: dict[str, tuple[tuple[tuple[int, str], ...], int]] = {}
        self._begin()

    def _begin(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.start = self._state("", (None,), (0,))

    def _state(self, rest: str, last: tuple, counts: tuple[int, ...]) -> dict:
        """A state: (next state, change of the count, last token) by letter, and under None what it stands for."""
        key = (rest, last, counts)
        if (state := self.states.get(key)) is None:
            state = self.states[key] = {None: key}
        return state

    def _ending(self, text: str) -> tuple[tuple[tuple[int, str], ...], int]:
        """(place, token) of the tokens that end a text, longest first, and from where on it is open to longer ones."""
        found = tuple((j, text[j:]) for j in range(len(text)) if text[j:] in self.tokens or j == len(text) - 1)
        k = next((k for k in range(len(text)) if text[k:] in self.open), len(text))
        if len(self._ends) > self.STATES:
            self._ends.clear()
        out = self._ends[text] = (found, k)
        return out

    def _compile(self, state: dict, letter: str) -> tuple[dict, int, str]:
        rest, last, counts = state[None]
        text, known = rest + letter, self.merger.known
        found, k = self._ends.get(text) or self._ending(text)
        token, base = _DEAD, 0
        for j, t in found:
            if (left := last[j]) != _DEAD:
                if (ok := known.get((left, t))) is None:
                    ok = self.merger.valid(left, t)
                if ok:
                    token, base = t, counts[j] + 1
                    break
        to = self._state(text[k:], (*last[k:], token), (*[c - base for c in counts[k:]], 0) if base else (*counts[k:], 0))
        state[letter] = out = (to, base, token)
        return out

    def _room(self) -> None:
        if len(self.states) > self.STATES:
            self._begin()

    def count(self, text: str) -> int:
        """Number of tokens of a text without separators."""
        self._room()
        state, total = self.start, 0
        for letter in text:
            try:
                state, change, _ = state[letter]
            except KeyError:
                state, change, _ = self._compile(state, letter)
            total += change
        return total

    def _lasts(self, state: dict, text: str) -> list[str]:
        last = []
        for letter in text:
            try:
                state, _, token = state[letter]
            except KeyError:
                state, _, token = self._compile(state, letter)
            last.append(token)
        return last

    @staticmethod
    def _back(last: list[str]) -> list[str]:
        out, i = [], len(last)
        while i:
            token = last[i - 1]
            out.append(token)
            i -= len(token)
        out.reverse()
        return out

    def encode(self, text: str) -> list[str]:
        """Tokens of a text without separators."""
        self._room()
        return self._back(self._lasts(self.start, text))

    # ------------------------------------------------- chunks of long texts

    def _is_token(self, piece: str) -> bool:
        return piece in self.tokens or len(piece) == 1

    def _entries(self, near: str, begin: int) -> list[tuple[int, int]]:
        """States in which the text around a cut lets it be crossed; (0, 0) where nothing comes before."""
        if begin == 0:
            return [(0, 0)]
        if near[begin - 1] == SEP:
            return [(1, 0)]
        out = []
        for before in range(1, min(self.longest, begin) + 1):
            if near[begin - before] == SEP:
                break
            for after in range(min(self.longest - before, len(near) - begin) + 1):
                if after and near[begin + after - 1] == SEP:
                    break
                if self._is_token(near[begin - before : begin + after]):
                    out.append((before, after))
        return out

    def _forced(self, near: str, begin: int, entry: tuple[int, int]) -> dict:
        """The state just after the token that crosses a cut."""
        before, after = entry
        token = None if before == 0 or near[begin - 1] == SEP else near[begin - before : begin + after]
        return self._state("", (token,), (0,))

    def _exits(self, state: dict, total: int, near: str, end: int) -> dict[tuple[int, int], int]:
        """How a text can go on over the cut at ``end`` from a state there, with the tokens begun so far."""
        rest, last, counts = state[None]
        if end == len(near) or end and near[end - 1] == SEP:
            return {(1, 0) if near[end - 1 : end] == SEP else (len(last[-1] or ""), 0): total} if last[-1] != _DEAD else {}
        out = {(len(last[-1]), 0): total} if last[-1] else {}
        for j, left in enumerate(last[:-1]):
            if left == _DEAD:
                continue
            for after in range(1, min(self.longest - len(rest) + j, len(near) - end) + 1):
                if near[end + after - 1] == SEP:
                    break
                piece = near[end - len(rest) + j : end + after]
                if piece in self.tokens and self.merger.valid(left, piece):
                    out[len(rest) - j, after] = total + counts[j] + 1
        return out

    def matrix(self, near: str, begin: int, end: int, count=None) -> dict[tuple, int]:
        """{(state at begin, state at end): tokens that begin between}; near reaches ``longest`` letters over both cuts.

        All ways in run side by side, and those that reach the same state become
        one. At a separator they all do. count: of a part between separators.
        """
        self._room()
        count, out = count or self.count, {}
        first = near.find(SEP, begin, end)
        stop = end if first < 0 else first
        alive: dict[int, list] = {}  # id of a state -> [state, its entries with their counts], per place
        waiting: dict[int, list] = {}
        for entry in self._entries(near, begin):
            at = begin + entry[1]
            if at >= end and entry[0]:
                out[entry, (entry[0] + end - begin, at - end) if near[begin - 1] != SEP else (1, 0)] = 0
            else:
                waiting.setdefault(at, []).append(entry)
        at = begin
        while at < stop or at in waiting:
            for entry in waiting.pop(at, ()):
                state = self._forced(near, begin, entry)
                alive.setdefault(id(state), [state, []])[1].append((entry, 0))
            if at >= stop:
                break
            moved: dict[int, list] = {}
            letter = near[at]
            for state, entries in alive.values():
                to, change, _ = state.get(letter) or self._compile(state, letter)
                if any(t != _DEAD for t in to[None][1]):
                    held = moved.setdefault(id(to), [to, []])[1]
                    held += [(e, c + change) for e, c in entries] if change else entries
            alive, at = moved, at + 1
        if first < 0:
            for state, entries in alive.values():
                exits = self._exits(state, 0, near, end)
                out |= {(e, t): c + n for e, c in entries for t, n in exits.items()}
            return out
        into = {e: c for state, entries in alive.values() if state[None][1][-1] != _DEAD for e, c in entries}
        last = near.rfind(SEP, first, end)
        middle = sum(map(count, near[first:last].split(SEP)[1:])) if last > first else 0
        state, total = self.start, 0
        for letter in near[last + 1 : end]:
            state, change, _ = state.get(letter) or self._compile(state, letter)
            total += change
        exits = self._exits(state, total, near, end)
        return out | {(e, t): c + middle + n for e, c in into.items() for t, n in exits.items()}

    def trace(self, near: str, begin: int, end: int, enter: tuple[int, int], leave: tuple[int, int], encode=None) -> list[str]:
        """Tokens that begin in [begin, end) on the only path between two states; separators are left out."""
        self._room()
        a, b = begin + enter[1], end - leave[0] if near[end - 1 : end] != SEP else end
        if a > b:
            return []
        parts = near[a:b].split(SEP)
        encode = encode or self.encode
        out = self._back(self._lasts(self._forced(near, begin, enter), parts[0]))
        for part in parts[1:]:
            out += encode(part)
        if leave[0] and near[end - 1 : end] != SEP and b >= begin:
            out.append(near[b : end + leave[1]])
        return out

"""A suffix automaton over words, for matching statistics against a shard of reference passages."""

from __future__ import annotations

from array import array
from collections.abc import Iterable


class SuffixAutomaton:
    """Every substring of the passages is a path from state 0; passages never run into one another.

    States are rows of flat integer arrays (link, length, and the word and target of the first arrow); only states that branch have a
    dictionary of further arrows. A passage of n words adds at most 2 n states of 16 bytes each.
    """

    def __init__(self, passages: Iterable[list[str]] = ()):
        self.number: dict[str, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.word, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        for passage in passages:
            last = 0
            for word in passage:
                last = self._extend(last, self.number.setdefault(word, len(self.number)))

    def _arrow(self, p: int, c: int) -> int:
        """Target of the arrow of word ``c`` from ``p``, or -1."""
        if self.word[p] == c:
            return self.to[p]
        further = self.more.get(p)
        return further.get(c, -1) if further is not None else -1

    def _point(self, p: int, c: int, q: int) -> None:
        if self.word[p] in (c, -1):
            self.word[p], self.to[p] = c, q
        else:
            self.more.setdefault(p, {})[c] = q

    def _state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self.word.append(-1)
        self.to.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the longest string of ``p`` followed by ``c``: ``q`` itself, or a copy of it that takes the shorter strings."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q])
        self.word[copy], self.to[copy] = self.word[q], self.to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self._arrow(p, c) == q:
            self._point(p, c, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        there = self._arrow(last, c)
        if there >= 0:
            return self._split(last, c, there)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and self._arrow(p, c) < 0:
            self._point(p, c, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self._arrow(p, c))
        return new

    def spans(self, words: list[str], least: int) -> list[tuple[int, int]]:
        """Maximal spans [from, to) covered by matches of at least ``least`` words, from the matching statistics of ``words``."""
        word, target, more, link, length = self.word, self.to, self.more, self.link, self.length
        none: dict[int, int] = {}
        state = size = 0
        found: list[tuple[int, int]] = []
        for i, c in enumerate(map(self.number.get, words)):
            if c is None:
                state = size = 0
                continue
            while True:
                to = target[state] if word[state] == c else more.get(state, none).get(c, -1)
                if to >= 0 or not state:
                    break
                state = link[state]
                size = length[state]
            if to >= 0:
                state = to
                size += 1
            if size >= least:
                start = i + 1 - least
                if found and start <= found[-1][1]:
                    found[-1] = (found[-1][0], i + 1)
                else:
                    found.append((start, i + 1))
        return found

"""Generalised suffix automaton over words, with the windows that end in its states."""

from __future__ import annotations


class Automaton:
    """All stretches of the items' words. Items are named; an item may come in several parts that overlap.

    A window is a stretch of `window` words of an item, or a whole item of fewer. full maps the state of each window to the
    items that hold it; short maps states to (words, item) of whole short items that end there.
    """

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: dict[bytes, int] = {}
        self.full: dict[int, set[str | None]] = {}
        self.short: dict[int, set[tuple[int, str | None]]] = {}

    def _state(self, length: int, onward: dict[int, int], link: int) -> int:
        self.next.append(onward)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of exactly state's longest stretch and word, cut off from a longer one if need be."""
        onward = self.next[state][word]
        if self.length[onward] == self.length[state] + 1:
            return onward
        copy = self._state(self.length[state] + 1, dict(self.next[onward]), self.link[onward])
        self.link[onward] = copy
        while state >= 0 and self.next[state].get(word) == onward:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes]) -> None:
        """Take in one item's words; windows are named when all items are in."""
        last = 0
        for text in words:
            word = self.ids.setdefault(text, len(self.ids))
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            state, own = last, self._state(self.length[last] + 1, {}, 0)
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = own
                state = self.link[state]
            if state >= 0:
                self.link[own] = self._split(state, word)
            last = own

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def name(self, words: list[bytes], item: str | None) -> None:
        """Note the windows of an item that was added."""
        state, n = 0, 0
        for state, n in self.walk(words):
            if n >= self.window:
                self.full.setdefault(self._window_state(state), set()).add(item)
        if 0 < n == len(words) < self.window:
            self.short.setdefault(state, set()).add((n, item))

    def walk(self, words: list[bytes]):
        """After each word: the state and length of the longest stretch of any item that ends there."""
        state, n, onward, link, length, ids = 0, 0, self.next, self.link, self.length, self.ids
        for text in words:
            word = ids.get(text, -1)
            while state and word not in onward[state]:
                state = link[state]
                n = length[state]
            if word in onward[state]:
                state, n = onward[state][word], n + 1
            yield state, n

    def found(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Stretches (begin, end) of words that lie in windows, in order and disjoint, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        for at, (state, n) in enumerate(self.walk(words)):
            size = 0
            if n >= self.window:
                size = self.window
                items |= self.full[self._window_state(state)]
            if self.short:
                back = state
                while back > 0:
                    for m, item in self.short.get(back, ()):
                        if m <= n:
                            size = max(size, m)
                            items.add(item)
                    back = self.link[back]
            if size:
                begin = at + 1 - size
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at + 1))
        return spans, items

"""A suffix automaton over several texts that knows which of its substrings belong to more than one owner."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SharedAutomaton:
    """Suffix automaton of (text, lowest owner, highest owner) rows.

    A state is shared if the owners of the texts that contain its strings differ, that is if its lowest owner isn't its highest.
    """

    def __init__(self, rows: Iterable[tuple[str, object, object]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.low: list[object] = [None]
        self.high: list[object] = [None]
        for text, low, high in rows:
            self._add(text, low, high)
        self._close()

    def _state(self, length: int, link: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.low.append(None)
        self.high.append(None)
        return len(self.length) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """A copy of q for the strings that p reaches by c, when q also holds longer ones."""
        nxt, link, length = self.next, self.link, self.length
        copy = self._state(length[p] + 1, link[q], nxt[q].copy())
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def _add(self, text: str, first: object, last: object) -> None:
        nxt, link, length, low, high = self.next, self.link, self.length, self.low, self.high
        at = 0
        for c in text:
            q = nxt[at].get(c)
            if q is not None:
                at = q if length[q] == length[at] + 1 else self._split(at, c, q)
            else:
                new = self._state(length[at] + 1, 0, {})
                p = at
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                at = new
            if low[at] is None:
                low[at], high[at] = first, last
            else:
                if first < low[at]:
                    low[at] = first
                if last > high[at]:
                    high[at] = last

    def _close(self) -> None:
        """Owners go up the suffix links; each state learns its nearest shared suffix."""
        link, low, high, length = self.link, self.low, self.high, self.length
        order = sorted(range(1, len(length)), key=length.__getitem__)
        for v in reversed(order):
            u = link[v]
            if u > 0:
                if low[u] is None:
                    low[u], high[u] = low[v], high[v]
                else:
                    if low[v] < low[u]:
                        low[u] = low[v]
                    if high[v] > high[u]:
                        high[u] = high[v]
        self.shared = shared = [0] * len(length)
        for v in order:
            shared[v] = v if low[v] != high[v] else shared[link[v]]

    def statistics(self, text: str) -> Iterator[int]:
        """For each character, the length of the longest shared string that ends with it."""
        nxt, link, length, shared = self.next, self.link, self.length, self.shared
        at = n = 0
        for c in text:
            while at and c not in nxt[at]:
                at = link[at]
                n = length[at]
            at = nxt[at].get(c, 0)
            n = n + 1 if at else 0
            s = shared[at]
            yield n if s == at else length[s]

    def spans(self, text: str, least: int) -> list[tuple[int, int]]:
        """Maximal ranges [first, end) of the starts of windows of `least` characters that are shared."""
        out: list[tuple[int, int]] = []
        first = None
        i = 0
        for i, n in enumerate(self.statistics(text), 1):
            if n >= least:
                if first is None:
                    first = i - least
            elif first is not None:
                out.append((first, i - least))
                first = None
        if first is not None:
            out.append((first, i - least + 1))
        return out

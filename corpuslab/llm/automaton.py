"""Suffix automaton over token sequences with the smallest document id of every state."""

from __future__ import annotations


class SuffixAutomaton:
    """Generalised suffix automaton: add sequences, ``finish``, then stream sequences through it."""

    def __init__(self):
        self.next, self.link, self.length, self.doc = [{}], [-1], [0], [None]

    def _state(self, length, edges, link, doc):
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.doc.append(doc)
        return len(self.next) - 1

    def _split(self, p, q, c):
        """A copy of q for the shorter strings that reach it from p over c."""
        nxt, link = self.next, self.link
        copy = self._state(self.length[p] + 1, nxt[q].copy(), link[q], None)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, tokens, doc) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in tokens:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
            else:
                new, p = self._state(length[last] + 1, {}, 0, None), last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
                last = new
            if self.doc[last] is None or doc < self.doc[last]:
                self.doc[last] = doc

    def finish(self) -> None:
        """Every state learns the smallest document in which its strings occur."""
        doc, link = self.doc, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[s]
            if p > 0 and (doc[p] is None or doc[s] < doc[p]):
                doc[p] = doc[s]

    def matches(self, tokens, window: int):
        """Matching statistics of a stream, cut at ``window``: yields (end position, smallest
        document) wherever the last ``window`` tokens occur in a reference sequence."""
        nxt, link, length = self.next, self.link, self.length
        state, matched = 0, 0
        for i, c in enumerate(tokens):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state, matched = nxt[state][c], matched + 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = window
                yield i, self.doc[state]

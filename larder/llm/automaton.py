"""Generalised suffix automata over sequences of integers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """The substrings of several sequences; none crosses from one sequence into the next.

    ``next[s]`` maps a symbol to a state, ``link[s]`` is the suffix link and
    ``length[s]`` the length of the longest string of state ``s``.
    """

    def __init__(self, sequences: Iterable[Sequence[int]] = ()):
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        for sequence in sequences:
            self.add(sequence)

    def add(self, sequence: Sequence[int]) -> list[int]:
        """Add one sequence; the state of each of its prefixes is returned."""
        last, seen = 0, []
        for symbol in sequence:
            last = self._extend(last, symbol)
            seen.append(last)
        # A later split can move a prefix to a clone's sibling, never away from its state,
        # because clones take over shorter strings only.
        return seen

    def _clone(self, p: int, q: int, symbol: int) -> int:
        copy = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, q, symbol)
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
        return state

    def matching(self, sequence: Iterable[int]) -> Iterable[tuple[int, int]]:
        """For each position: the state and length of the longest suffix that the automaton knows."""
        state = length = 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(symbol)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield state, length

    def locate(self, sequence: Iterable[int]) -> int:
        """The state of a whole known sequence, or -1."""
        state = 0
        for symbol in sequence:
            state = self.next[state].get(symbol, -1)
            if state < 0:
                return -1
        return state

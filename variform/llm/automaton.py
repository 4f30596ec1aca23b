"""Levenshtein automata intersected with a lexicon trie, determinised as words are read."""

from __future__ import annotations

from collections.abc import Iterable


def max_edits(term: str) -> int:
    """Short terms must match exactly, long ones may have two edits."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms. A state is the set of (node, edits) that the letters so far can have reached; states and their
    transitions are kept once made, so reading a word is a walk through dictionaries that ends at the first dead letter."""

    def __init__(self, terms: Iterable[str], edits=max_edits, states: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room: list[int] = [-1]  # most edits that a term at or below the node allows
        self.limit = states
        for term in sorted(set(terms)):
            node, allowed = 0, edits(term)
            self.room[0] = max(self.room[0], allowed)
            for letter in term:
                nxt = self.children[node].get(letter)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][letter] = nxt
                    self.children.append({})
                    self.term.append(None)
                    self.room.append(-1)
                node = nxt
                self.room[node] = max(self.room[node], allowed)
            self.term[node] = term
        self.allowed = {t: edits(t) for t in self.term if t is not None}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[int, str] | None] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state of some nodes with their least edits, closed under letters that the word left out; -1 if none is left."""
        todo = [n for n in reached if reached[n] <= self.room[n]]
        best = {n: reached[n] for n in todo}
        while todo:
            node = todo.pop()
            e = best[node] + 1
            for child in self.children[node].values():
                if e <= self.room[child] and e < best.get(child, 99):
                    best[child] = e
                    todo.append(child)
        if not best:
            return -1
        key = frozenset(best.items())
        state = self.ids.get(key)
        if state is None:
            state = self.ids[key] = len(self.members)
            self.members.append(key)
            self.next.append({})
            ends = [(e, self.term[n]) for n, e in best.items() if self.term[n] is not None and e <= self.allowed[self.term[n]]]
            self.found.append(min(ends) if ends else None)
        return state

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.room[node] and e < reached.get(node, 99):
                reached[node] = e

        for node, e in self.members[state]:
            put(node, e + 1)  # a letter too many
            for each, child in self.children[node].items():
                put(child, e + (each != letter))
        to = self._state(reached)
        self.next[state][letter] = to
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within its edits, the first in order among equals."""
        if len(self.members) > self.limit:
            self._reset()
        state = self.start
        if state < 0:  # no terms
            return None
        for letter in word:
            nxt = self.next[state].get(letter)
            if nxt is None:
                nxt = self._step(state, letter)
            if nxt < 0:
                return None
            state = nxt
        return self.found[state]

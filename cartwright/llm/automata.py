"""Grammar inference: probabilistic automata from strings, by merging prefix-tree states."""

from __future__ import annotations

import math
from collections.abc import Iterable

#: Confidence of the test that two states' frequencies differ.
ALPHA = 0.01
#: Chance given to a step that was never seen, and to every step after it.
UNSEEN = 1e-4


class Automaton:
    """A deterministic automaton with counts on its states and steps."""

    def __init__(self, samples: Iterable[str]):
        self.steps: list[dict[str, int]] = [{}]
        self.passed: list[int] = [0]
        self.ended: list[int] = [0]
        self.taken: list[dict[str, int]] = [{}]
        for sample in samples:
            at = 0
            self.passed[0] += 1
            for symbol in sample:
                follow = self.steps[at].get(symbol)
                if follow is None:
                    follow = self._state()
                    self.steps[at][symbol] = follow
                    self.taken[at][symbol] = 0
                self.taken[at][symbol] += 1
                self.passed[follow] += 1
                at = follow
            self.ended[at] += 1

    def _state(self) -> int:
        for column, empty in ((self.steps, {}), (self.passed, 0), (self.ended, 0), (self.taken, {})):
            column.append(type(empty)())
        return len(self.steps) - 1

    @staticmethod
    def _differ(hits: int, of: int, other_hits: int, other_of: int, width: float) -> bool:
        """Hoeffding's bound on two frequencies."""
        if not of or not other_of:
            return False
        gap = abs(hits / of - other_hits / other_of)
        return gap > width * (1 / math.sqrt(of) + 1 / math.sqrt(other_of))

    def _compatible(self, left: int, right: int, width: float) -> bool:
        waiting = [(left, right)]
        while waiting:
            a, b = waiting.pop()
            of, other = self.passed[a], self.passed[b]
            if self._differ(self.ended[a], of, self.ended[b], other, width):
                return False
            for symbol in self.taken[a].keys() | self.taken[b].keys():
                hits, other_hits = self.taken[a].get(symbol, 0), self.taken[b].get(symbol, 0)
                if self._differ(hits, of, other_hits, other, width):
                    return False
                if hits and other_hits:
                    waiting.append((self.steps[a][symbol], self.steps[b][symbol]))
        return True

    def _fold(self, into: int, state: int) -> None:
        """Add the counts of the tree under ``state`` to the states from ``into`` on."""
        waiting = [(into, state)]
        while waiting:
            a, b = waiting.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for symbol, follow in self.steps[b].items():
                taken = self.taken[b][symbol]
                if symbol in self.steps[a]:
                    self.taken[a][symbol] += taken
                    waiting.append((self.steps[a][symbol], follow))
                else:
                    self.steps[a][symbol] = follow
                    self.taken[a][symbol] = taken

    def merge(self, alpha: float = ALPHA) -> Automaton:
        """Merge every tree state with the first settled state it is compatible with."""
        width = math.sqrt(math.log(2 / alpha) / 2)
        settled = [0]
        while True:
            edge = [
                (-self.taken[state][symbol], state, symbol)
                for state in settled
                for symbol, follow in self.steps[state].items()
                if follow not in settled
            ]
            if not edge:
                return self
            _, parent, symbol = min(edge)
            state = self.steps[parent][symbol]
            target = next((s for s in settled if self._compatible(s, state, width)), None)
            if target is None:
                settled.append(state)
            else:
                self.steps[parent][symbol] = target
                self._fold(target, state)

    def log_likelihood(self, text: str) -> float:
        """Log chance of the whole string; a step never seen costs ``UNSEEN``."""
        total, at = 0.0, 0
        lost = math.log(UNSEEN)
        for symbol in text:
            if at is None:
                total += lost
                continue
            taken = self.taken[at].get(symbol, 0)
            total += math.log(taken / self.passed[at]) if taken else lost
            at = self.steps[at].get(symbol)
        ended = self.ended[at] if at is not None else 0
        return total + (math.log(ended / self.passed[at]) if ended else lost)

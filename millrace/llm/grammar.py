"""Probabilistic automata inferred from examples by state merging.

The examples form a prefix tree. Going from the root outwards, each state is
merged into the first earlier state whose outgoing frequencies are statistically
compatible (Hoeffding bounds, followed through the successors), or kept. What
remains is a deterministic automaton with a probability on every symbol and on
stopping.
"""

from __future__ import annotations

import math

#: Classes of characters; any other character is its own symbol.
CLASSES = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U")}
END = ""


def symbols(text: str) -> list[str]:
    return [CLASSES.get(c, c) for c in text]


class Automaton:
    """Counts of symbols and targets by state; state 0 is the start."""

    def __init__(self, examples: list[str], alpha: float = 0.05):
        self.out: list[dict[str, int]] = [{}]
        self.to: list[dict[str, int]] = [{}]
        for text in examples:
            self._insert(symbols(text))
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._weights()

    def _insert(self, path: list[str]) -> None:
        state = 0
        for s in path:
            self.out[state][s] = self.out[state].get(s, 0) + 1
            if s not in self.to[state]:
                self.to[state][s] = len(self.out)
                self.out.append({})
                self.to.append({})
            state = self.to[state][s]
        self.out[state][END] = self.out[state].get(END, 0) + 1

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.out[a], self.out[b]
            n, m = sum(x.values()), sum(y.values())
            if not n or not m:
                continue
            far = self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for s in x.keys() | y.keys():
                if abs(x.get(s, 0) / n - y.get(s, 0) / m) > far:
                    return False
            todo += [(self.to[a][s], self.to[b][s]) for s in self.to[a].keys() & self.to[b].keys() if self.to[a][s] != self.to[b][s]]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the subtree at `tree` to the state `into`."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            for s, n in self.out[b].items():
                self.out[a][s] = self.out[a].get(s, 0) + n
            for s, target in self.to[b].items():
                if s in self.to[a]:
                    todo.append((self.to[a][s], target))
                else:
                    self.to[a][s] = target

    def _merge_states(self) -> None:
        kept, position = [0], 0
        members = {0}
        frontier = [(0, s) for s in sorted(self.to[0])]
        while position < len(frontier):
            source, s = frontier[position]
            position += 1
            state = self.to[source][s]
            if state in members:
                continue
            match = next((k for k in kept if self._compatible(k, state)), None)
            if match is None:
                kept.append(state)
                members.add(state)
                grown = [state]
            else:
                self.to[source][s] = match
                self._fold(match, state)
                grown = kept
            known = set(frontier[position:])
            frontier += [(k, x) for k in grown for x in sorted(self.to[k]) if self.to[k][x] not in members and (k, x) not in known]
        self.states = kept

    def _weights(self) -> None:
        """Log probabilities, a little of each state's mass kept for new symbols."""
        self.log = {}
        for k in self.states:
            total = sum(self.out[k].values()) + 1.0
            self.log[k] = ({s: math.log(n / total) for s, n in self.out[k].items()}, math.log(1 / (total * 40)))

    def score(self, path: list[str]) -> float:
        """Log probability of the symbols followed by stopping."""
        state, total = 0, 0.0
        for s in path:
            known, other = self.log[state]
            total += known.get(s, other)
            state = self.to[state].get(s, state)
            if state not in self.log:
                state = 0
        known, other = self.log[state]
        return total + known.get(END, other)

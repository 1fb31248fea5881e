"""Letter-to-letter finite-state transducers: one symbol out for each symbol in.

A machine may offer several arcs for a symbol (a guess about what follows); a path counts
only if it ends in a final state. ``compose`` feeds one machine's output to the next and
keeps the states from which a final one can be reached.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable, Sequence
from dataclasses import dataclass

State = Hashable
Arcs = dict[tuple[State, str], list[tuple[State, str]]]


@dataclass
class Transducer:
    start: State
    final: set[State]
    arcs: Arcs

    @classmethod
    def of(cls, start: State, final: Callable[[State], bool], symbols: Iterable[str], step: Callable[[State, str], Iterable[tuple[State, str]]]) -> Transducer:
        """All states that ``step(state, symbol) -> (next, output), ...`` reaches from ``start``."""
        symbols = tuple(symbols)
        arcs: Arcs = {}
        seen, todo = {start}, [start]
        while todo:
            state = todo.pop()
            for x in symbols:
                arcs[state, x] = list(step(state, x))
                for to, _ in arcs[state, x]:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        return cls(start, {s for s in seen if final(s)}, arcs).trimmed()

    def outputs(self) -> set[str]:
        return {out for arcs in self.arcs.values() for _, out in arcs}

    def trimmed(self) -> Transducer:
        """Without arcs to states that lead to no final state; states are numbered."""
        back = defaultdict(set)
        for (state, _), arcs in self.arcs.items():
            for to, _ in arcs:
                back[to].add(state)
        live, todo = set(self.final), list(self.final)
        while todo:
            for state in back[todo.pop()]:
                if state not in live:
                    live.add(state)
                    todo.append(state)
        name = {s: i for i, s in enumerate([self.start, *sorted(live - {self.start}, key=repr)])}
        arcs = {(name[s], x): [(name[t], y) for t, y in out if t in live] for (s, x), out in self.arcs.items() if s in name}
        return Transducer(0, {name[s] for s in self.final}, {k: v for k, v in arcs.items() if v})

    def run(self, symbols: Sequence[str]) -> list[str] | None:
        """Outputs of the accepting path (the first in arc order, should there be several), or None."""
        layers: list[dict[State, tuple[State, str]]] = []
        states: Iterable[State] = (self.start,)
        for x in symbols:
            reached: dict[State, tuple[State, str]] = {}
            for s in states:
                for to, out in self.arcs.get((s, x), ()):
                    reached.setdefault(to, (s, out))
            layers.append(reached)
            states = reached
        end = next((s for s in states if s in self.final), None)
        if end is None:
            return None
        path = []
        for reached in reversed(layers):
            end, out = reached[end]
            path.append(out)
        return path[::-1]


def compose(first: Transducer, *others: Transducer) -> Transducer:
    """The machine that applies all in order."""
    for other in others:
        one, two = first, other
        symbols = {x for _, x in one.arcs}

        def step(state: State, x: str, one: Transducer = one, two: Transducer = two) -> Iterable[tuple[State, str]]:
            p, q = state
            return [((p2, q2), z) for p2, y in one.arcs.get((p, x), ()) for q2, z in two.arcs.get((q, y), ())]

        first = Transducer.of((one.start, two.start), lambda s, one=one, two=two: s[0] in one.final and s[1] in two.final, symbols, step)
    return first

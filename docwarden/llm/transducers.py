"""Small weighted finite-state transducers over word classes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field


@dataclass
class Transducer:
    """A deterministic machine: (state, symbol) leads to (state, output, weight); other symbols pass unchanged to ``rest``."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, str, float]] = field(default_factory=dict)
    rest: dict[str, str] = field(default_factory=dict)

    def arc(self, state: str, symbols: Iterable[str] | str, to: str, output: str | None = None, weight: float = 0.0) -> None:
        for symbol in [symbols] if isinstance(symbols, str) else symbols:
            self.arcs[state, symbol] = (to, output or symbol, weight)

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        found = self.arcs.get((state, symbol))
        return found if found else (self.rest.get(state, state), symbol, 0.0)


def compose(machines: Sequence[Transducer], symbols: Sequence[str]) -> tuple[list[list[tuple[int, float]]], list[str]]:
    """The product machine as a table: row per state, (next state, weight) per input symbol.

    The output of each machine is the input of the next one.  Only states that
    can be reached are built.  Also returns the symbols in column order.
    """
    start = tuple(m.start for m in machines)
    number, table, todo = {start: 0}, [], [start]
    while todo:
        state = todo.pop(0)
        row: list[tuple[int, float]] = []
        for symbol in symbols:
            after, weight, carried = [], 0.0, symbol
            for machine, own in zip(machines, state):
                to, carried, w = machine.step(own, carried)
                after.append(to)
                weight += w
            key = tuple(after)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row.append((number[key], weight))
        table.append(row)
    return table, list(symbols)

"""Finite automata over token arrays, as columns.

A rule says how a state and a token class give the next state. The states that can be
reached are numbered and the rule becomes one table, which ``aggregate`` runs over a text's
token classes: a lookup a token, whatever the rule tells apart.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Automaton:
    """``start``, the number of token ``classes``, ``step(state, class)``, and which states ``accept``."""

    def __init__(self, start: Hashable, classes: int, step: Callable[[Hashable, int], Hashable], accept: Callable[[Hashable], bool]):
        number, reached, table = {start: 0}, [start], []
        for state in reached:  # grows as states are found
            for c in range(classes):
                after = step(state, c)
                if after not in number:
                    number[after] = len(number)
                    reached.append(after)
                table.append(number[after])
        self.classes, self.table, self.accepts = classes, table, [accept(s) for s in reached]

    def run(self, classes: Column) -> Column:
        """Whether the state after all of ``classes`` accepts; no classes leave the start."""
        end = F.aggregate(classes, F.lit(0), lambda state, c: F.get(F.lit(self.table), state * self.classes + c))
        return F.get(F.lit(self.accepts), end)

"""Lightest derivations over a weighted hypergraph by Knuth's agenda.

A deduction takes finished items to a conclusion, and its value is a superior function of theirs: never less than any of them, and
growing with each.  The agenda pops the conclusion of least value, which is then final, and tries the deductions it completes.
"""
from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterable


def lightest(axioms: Iterable[tuple[Hashable, tuple]], deductions: Callable[[Hashable, tuple, dict], Iterable[tuple[Hashable, tuple]]], goals: set | None = None) -> dict[Hashable, tuple]:
    """Least values by item; stops once all ``goals`` are final, or at the end of the agenda without goals.

    ``deductions(item, value, final)`` gives conclusions and values of the deductions that ``item`` completes together with the items
    already in ``final``.
    """
    final: dict[Hashable, tuple] = {}
    seen: dict[Hashable, tuple] = {}
    agenda: list[tuple[tuple, Hashable]] = []

    def offer(item, value):
        if item not in final and (item not in seen or value < seen[item]):
            seen[item] = value
            heapq.heappush(agenda, (value, item))

    for item, value in axioms:
        offer(item, value)
    open_goals = set(goals or ())
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        open_goals.discard(item)
        if goals and not open_goals:
            break
        for conclusion, weight in deductions(item, value, final):
            offer(conclusion, weight)
    return final

"""Merging adjacent symbols in order of priority, leftmost first among equals."""

from __future__ import annotations

import heapq
from math import inf

SHORT = 32


def merged(symbols: list[str], priority: dict[str, int], glue: str = "") -> list[str]:
    """The symbols after all merges. A pair (x, y) may merge if ``x + glue + y`` has a priority; lower goes first."""
    return _short(symbols, priority, glue) if len(symbols) <= SHORT else _long(symbols, priority, glue)


def _short(symbols: list[str], priority: dict[str, int], glue: str) -> list[str]:
    """The agenda as a list with one entry for each adjacent pair."""
    get = priority.get
    agenda = [get(x + glue + y, inf) for x, y in zip(symbols, symbols[1:])]
    while agenda:
        best = min(agenda)
        if best is inf:
            break
        i = agenda.index(best)
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        del agenda[i]
        if i:
            agenda[i - 1] = get(symbols[i - 1] + glue + symbols[i], inf)
        if i < len(agenda):
            agenda[i] = get(symbols[i] + glue + symbols[i + 1], inf)
    return symbols


def _long(symbols: list[str], priority: dict[str, int], glue: str) -> list[str]:
    """The agenda as a heap over a linked list; entries whose pair has changed are passed over."""
    n = len(symbols)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    gone = [False] * n
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        pair = symbols[i] + glue + symbols[after[i]]
        if pair in priority:
            heapq.heappush(heap, (priority[pair], i, pair))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j < 0 or symbols[i] + glue + symbols[j] != pair:
            continue
        symbols[i] += symbols[j]
        gone[j] = True
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s, dead in zip(symbols, gone) if not dead]

"""Spans of lines in one file: what encloses a line or another span. Sweeps over sorted ends, near linear in a file."""

from __future__ import annotations

import heapq
from bisect import bisect_left


def innermost(starts: list[int], ends: list[int], ordinals: list[int], lines: list[int]) -> list[int]:
    """Of each line, in ascending order, the place of the shortest span around it, the least ordinal of equals; -1 without one.

    Spans are opened at their first line and wait in a heap, shortest first; one that has ended goes when it comes up.
    """
    order = sorted(range(len(starts)), key=starts.__getitem__)
    out, open_, k = [], [], 0
    for line in lines:
        while k < len(order) and starts[order[k]] <= line:
            i = order[k]
            heapq.heappush(open_, (ends[i] - starts[i], ordinals[i], i))
            k += 1
        while open_ and ends[open_[0][2]] < line:
            heapq.heappop(open_)
        out.append(open_[0][2] if open_ else -1)
    return out


def enclosing(starts: list[int], ends: list[int], ordinals: list[int]) -> list[list[int]]:
    """Of each span the places of those around it, innermost first. Of equal spans the least ordinal is the outer one.

    Where spans overlap without holding each other, one is around another only if it holds it whole.
    """
    out: list[list[int]] = [[] for _ in starts]
    stack: list[int] = []
    for i in sorted(range(len(starts)), key=lambda i: (starts[i], -ends[i], ordinals[i])):
        while stack and ends[stack[-1]] < starts[i]:
            stack.pop()
        around = [j for j in stack if ends[j] >= ends[i]]  # all of the stack, but where spans overlap
        out[i] = sorted(around, key=lambda j: (ends[j] - starts[j], -ordinals[j]))
        k = len(stack)
        while k and ends[stack[k - 1]] < ends[i]:  # whoever ends first is on top
            k -= 1
        stack.insert(k, i)
    return out


def touched(starts: list[int], ends: list[int], lines: list[int]) -> list[bool]:
    """Whether a line of these (ascending) lies in each span."""
    out = []
    for a, b in zip(starts, ends, strict=True):
        i = bisect_left(lines, a)
        out.append(i < len(lines) and lines[i] <= b)
    return out


class Hits:
    """Where a pattern matches in a text, so that many stretches of it can be asked for a match that they hold whole."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = [a for a, _ in spans]
        self.least = [b for _, b in spans]  # the least end from here on
        for i in range(len(spans) - 2, -1, -1):
            self.least[i] = min(self.least[i], self.least[i + 1])

    def within(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, a)
        return i < len(self.starts) and self.least[i] <= b

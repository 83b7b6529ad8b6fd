"""Small min-cost flows on the driver, and random rounding of fractional quotas.

The networks here have one node per category cell or bundle of like groups, never per record.
"""

from __future__ import annotations

import heapq
import random
from collections import defaultdict
from collections.abc import Hashable


class Network:
    """A directed network with integer capacities and costs of at least 0."""

    def __init__(self) -> None:
        self.index: dict[Hashable, int] = {}
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def node(self, name: Hashable) -> int:
        if name not in self.index:
            self.index[name] = len(self.out)
            self.out.append([])
        return self.index[name]

    def arc(self, a: Hashable, b: Hashable, capacity: int, cost: int = 0) -> int:
        """Add an arc; its number gives its flow later."""
        a, b = self.node(a), self.node(b)
        for u, v, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.left[arc ^ 1]

    def solve(self, source: Hashable, sink: Hashable) -> tuple[int, int]:
        """Send the largest flow of least cost: (flow, cost). Successive cheapest paths, with potentials."""
        s, t, n = self.node(source), self.node(sink), len(self.out)
        potential, sent, spent = [0] * n, 0, 0
        while True:
            far, by = [None] * n, [-1] * n
            far[s] = 0
            queue = [(0, s)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > far[u]:
                    continue
                for e in self.out[u]:
                    if self.left[e]:
                        v, w = self.to[e], d + self.cost[e] + potential[u] - potential[self.to[e]]
                        if far[v] is None or w < far[v]:
                            far[v], by[v] = w, e
                            heapq.heappush(queue, (w, v))
            if far[t] is None:
                return sent, spent
            reach = max(x for x in far if x is not None)
            potential = [p + (reach if f is None else f) for p, f in zip(potential, far)]
            path, v = [], t
            while v != s:
                path.append(by[v])
                v = self.to[by[v] ^ 1]
            push = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= push
                self.left[e ^ 1] += push
            sent += push
            spent += push * sum(self.cost[e] for e in path)


def round_quotas(x: dict[tuple[Hashable, Hashable], int], unit: int, rng: random.Random) -> dict[tuple[Hashable, Hashable], int]:
    """Whole numbers for quotas given in fractions of `unit`, drawn at random.

    Each quota becomes its floor or ceiling with the fraction as its expectation, and so does
    each sum over a row or a column: fractions move along cycles and paths of the bipartite
    graph of fractional quotas until none is left.
    """
    whole = {k: v // unit for k, v in x.items()}
    part = {k: v % unit for k, v in sorted(x.items(), key=repr) if v % unit}
    near: dict[Hashable, dict[tuple, None]] = defaultdict(dict)
    for e in part:
        near["a", e[0]][e] = near["b", e[1]][e] = None
    leaves = [v for v, es in near.items() if len(es) == 1]
    while part:
        while leaves and len(near[leaves[-1]]) != 1:
            leaves.pop()
        # From a node with one fractional quota a path ends at another; without such nodes there is a cycle.
        at = leaves[-1] if leaves else ("a", next(iter(part))[0])
        walk, seen, used = [], {at: 0}, set()
        while True:
            e = next((e for e in near[at] if e not in used), None)
            if e is None:
                break
            used.add(e)
            walk.append(e)
            at = ("b", e[1]) if at[0] == "a" else ("a", e[0])
            if at in seen:
                walk = walk[seen[at] :]
                break
            seen[at] = len(walk)
        up, down = walk[::2], walk[1::2]
        rise = min([unit - part[e] for e in up] + [part[e] for e in down])
        fall = min([part[e] for e in up] + [unit - part[e] for e in down])
        step = rise if rng.randrange(rise + fall) < fall else -fall
        for edges, by in ((up, step), (down, -step)):
            for e in edges:
                part[e] += by
                if part[e] in (0, unit):
                    whole[e] += part.pop(e) // unit
                    for v in (("a", e[0]), ("b", e[1])):
                        del near[v][e]
                        if len(near[v]) == 1:
                            leaves.append(v)
    return whole

"""Optimal assignment of sparse bipartite problems: the boxes of a frame, the ids of a component."""

from __future__ import annotations

from heapq import heappop, heappush


def _cheapest(adjacent: list[list[tuple[int, float]]]) -> list[int]:
    """The right of every left at least total cost, by shortest augmenting paths along the edges.

    Every left needs a right that nobody else has, so that a way to match it always exists.
    """
    price_left = [min(c for _, c in edges) for edges in adjacent]
    price_right: dict[int, float] = {}
    left_of: dict[int, int] = {}
    right_of = [-1] * len(adjacent)
    for root in range(len(adjacent)):
        reach: dict[int, float] = {}
        via: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        at, base = root, 0.0
        while True:
            for v, cost in adjacent[at]:
                if v not in done:
                    d = base + cost - price_left[at] - price_right.get(v, 0.0)
                    if v not in reach or d < reach[v]:
                        reach[v], via[v] = d, at
                        heappush(heap, (d, v))
            base, v = heappop(heap)
            while v in done:
                base, v = heappop(heap)
            done.add(v)
            if v not in left_of:
                break
            at = left_of[v]
        price_left[root] += base
        for w in done:
            if w != v:
                price_left[left_of[w]] += base - reach[w]
                price_right[w] = price_right.get(w, 0.0) - (base - reach[w])
        while True:
            u = via[v]
            left_of[v] = u
            right_of[u], v = v, right_of[u]
            if u == root:
                break
    return right_of


def best_pairs(pairs: list[tuple], *, most: bool) -> list[int]:
    """Indices of the chosen ``(left, right, score)`` entries, in their order.

    ``most`` matches as many as possible first and then maximises the score; otherwise only
    the total score counts. Missing pairs cannot be chosen. Time and memory follow the entries, not
    lefts times rights.
    """
    best: dict = {}
    for k, (a, _, score) in enumerate(pairs):
        if a not in best or score > pairs[best[a]][2]:
            best[a] = k
    chosen = list(best.values())
    if len({pairs[k][1] for k in chosen}) == len(chosen):
        # Everyone has their best entry; entries without a positive score add nothing to a total.
        return sorted(k for k in chosen if most or pairs[k][2] > 0)
    left = {a: i for i, a in enumerate(best)}
    right: dict = {}
    for p in pairs:
        right.setdefault(p[1], len(right))
    alone = sum(abs(p[2]) for p in pairs) + 1.0 if most else 0.0
    adjacent: list[list[tuple[int, float]]] = [[(len(right) + i, alone)] for i in range(len(left))]
    index = {}
    for k, (a, b, score) in enumerate(pairs):
        adjacent[left[a]].append((right[b], -float(score)))
        index[left[a], right[b]] = k
    return sorted(index[i, j] for i, j in enumerate(_cheapest(adjacent)) if (i, j) in index)

"""Minimum-cost flow between a few sources and sinks, by successive shortest paths with potentials."""
from __future__ import annotations

import heapq


def cheapest_transfers(supply: list[int], demand: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Whole amounts by (source, sink) that send all supplies at the least total cost.

    ``cost[i][j]`` is the price of one unit from source ``i`` to sink ``j`` and not negative; the demands must hold all supplies.
    Amounts are whole numbers of any size: each path carries all it can, so the number of paths does not depend on them.
    """
    n, m = len(supply), len(demand)
    if sum(supply) > sum(demand):
        raise ValueError("the sinks can't hold what the sources send")
    left, room = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    into: list[set[int]] = [set() for _ in range(m)]
    price_in, price_out = [0] * n, [0] * m
    while any(left):
        far = float("inf")
        reach_in, reach_out = [0 if left[i] else far for i in range(n)], [far] * m
        back_in, back_out = [-1] * n, [-1] * m
        heap = [(0, 0, i) for i in range(n) if left[i]]
        goal = -1
        while heap:
            d, sink, k = heapq.heappop(heap)
            if sink:
                if d > reach_out[k]:
                    continue
                if room[k]:
                    goal = k
                    break
                for i in into[k]:
                    step = d + price_out[k] - cost[i][k] - price_in[i]
                    if step < reach_in[i]:
                        reach_in[i], back_in[i] = step, k
                        heapq.heappush(heap, (step, 0, i))
            elif d <= reach_in[k]:
                for j in range(m):
                    step = d + cost[k][j] + price_in[k] - price_out[j]
                    if step < reach_out[j]:
                        reach_out[j], back_out[j] = step, k
                        heapq.heappush(heap, (step, 1, j))
        end = reach_out[goal]
        price_in = [p + min(r, end) for p, r in zip(price_in, reach_in)]
        price_out = [p + min(r, end) for p, r in zip(price_out, reach_out)]
        path, j = [], goal
        while True:
            i = back_out[j]
            path.append((i, j, back_in[i]))
            if back_in[i] < 0:
                break
            j = back_in[i]
        first = path[-1][0]
        amount = min([left[first], room[goal]] + [flow[i, j] for i, _, j in path if j >= 0])
        for i, j, other in path:
            flow[i, j] = flow.get((i, j), 0) + amount
            into[j].add(i)
            if other >= 0:
                flow[i, other] -= amount
                if not flow[i, other]:
                    del flow[i, other]
                    into[other].discard(i)
        left[first] -= amount
        room[goal] -= amount
    return flow

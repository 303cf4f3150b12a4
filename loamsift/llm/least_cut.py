"""Least cuts of graphs of lines: array operations for what is plain, max-flow for the rest."""

from __future__ import annotations

import numpy as np


def max_flow_labels(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of a least cut, the fewest there can be; cost > 0 is room from the source, cost < 0 room to the sink.

    Flow is sent from each node that has some left to the nearest node that takes it. Where none can be
    reached, all that was reached is on the source's side for good and is not searched again, so a page
    with one long row of lines in doubt costs little more than its edges.
    """
    n = len(cost)
    left = list(cost)
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        room[i][j] = room[i].get(j, 0.0) + w
        room[j][i] = room[j].get(i, 0.0) + w
    done = [False] * n
    for source in range(n):
        while left[source] > 1e-9 and not done[source]:
            before, queue, sink = {source: source}, [source], -1
            for u in queue:
                if left[u] < -1e-9:
                    sink = u
                    break
                for v, r in room[u].items():
                    if r > 1e-9 and v not in before and not done[v]:
                        before[v] = u
                        queue.append(v)
            if sink < 0:
                for u in queue:
                    done[u] = True
                break
            path, v = [], sink
            while v != source:
                path.append((before[v], v))
                v = before[v]
            flow = min(left[source], -left[sink], *(room[u][v] for u, v in path))
            for u, v in path:
                room[u][v] -= flow
                room[v][u] += flow
            left[source] -= flow
            left[sink] += flow
    return done


def least_cut(cost: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """True for nodes on the body's side. cost: evidence of each node; edges a-b of weight w > 0. Of equal cuts the one with the fewest body nodes is taken."""
    cost = cost.astype(np.float64).copy()
    n = len(cost)
    label = np.zeros(n, np.int8)  # 0 in doubt, 1 body, -1 furniture
    live = np.ones(len(a), bool)
    while True:
        ties = np.bincount(a[live], w[live], n) + np.bincount(b[live], w[live], n)
        new = np.where((label == 0) & (np.abs(cost) > ties), np.sign(cost), 0).astype(np.int8)
        if not new.any():
            break
        label += new
        for x, y in ((a, b), (b, a)):
            on = live & (new[x] != 0) & (label[y] == 0)
            cost += np.bincount(y[on], w[on] * new[x[on]], n)
        live &= (label[a] == 0) & (label[b] == 0)
    doubt = np.flatnonzero(label == 0)
    if len(doubt):
        # connected parts, each a max-flow problem of its own
        number = np.full(n, -1)
        number[doubt] = np.arange(len(doubt))
        links: list[list[tuple[int, float]]] = [[] for _ in doubt]
        for i, j, x in zip(number[a[live]].tolist(), number[b[live]].tolist(), w[live].tolist()):
            links[i].append((j, x))
            links[j].append((i, x))
        seen = [False] * len(doubt)
        for root in range(len(doubt)):
            if seen[root]:
                continue
            part, stack = [], [root]
            seen[root] = True
            while stack:
                i = stack.pop()
                part.append(i)
                for j, _ in links[i]:
                    if not seen[j]:
                        seen[j] = True
                        stack.append(j)
            local = {i: k for k, i in enumerate(part)}
            edges = [(local[i], local[j], x) for i in part for j, x in links[i] if i < j]
            for i, body in zip(part, max_flow_labels([float(cost[doubt[i]]) for i in part], edges)):
                label[doubt[i]] = 1 if body else -1
    return label > 0

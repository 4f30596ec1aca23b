"""Minimum cuts that label nodes: terminal capacities from costs, edges that ask neighbours to agree."""

from __future__ import annotations

from collections import deque

EPS = 1e-9


def label(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels of least total cost: ``costs[i]`` above 0 is paid if i is False, below 0 (its size) if i is True, and
    each edge's weight if its ends differ. Ties go to False.

    A node whose own cost exceeds all its edges together has its label for certain and folds into a terminal first;
    max-flow settles the rest.
    """
    n = len(costs)
    own = list(costs)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            around[a][b] = around[a].get(b, 0.0) + w
            around[b][a] = around[b].get(a, 0.0) + w
    labels: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if labels[i] is not None or abs(own[i]) <= sum(around[i].values()) + (0 if around[i] else -EPS):
            if labels[i] is None and not around[i]:
                labels[i] = False
            continue
        labels[i] = own[i] > 0
        for j, w in around[i].items():  # a settled neighbour is a cost of its own
            own[j] += w if labels[i] else -w
            del around[j][i]
            todo.append(j)
        around[i] = {}
    rest = [i for i in range(n) if labels[i] is None]
    if rest:
        for i, side in zip(rest, _source_side([own[i] for i in rest], rest, around)):
            labels[i] = side
    return [bool(x) for x in labels]


def _source_side(costs: list[float], names: list[int], around: list[dict[int, float]]) -> list[bool]:
    """Which nodes stay with the source after a maximum flow (shortest augmenting levels)."""
    index = {name: k for k, name in enumerate(names)}
    n = len(names)
    source, sink = n, n + 1
    residual: list[dict[int, float]] = [{index[j]: w for j, w in around[name].items()} for name in names] + [{}, {}]
    for k, cost in enumerate(costs):
        if cost > 0:
            residual[source][k] = cost
            residual[k][source] = 0.0
        elif cost < 0:
            residual[k][sink] = -cost
            residual[sink][k] = 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue and sink not in level:
            u = queue.popleft()
            for v, room in residual[u].items():
                if room > EPS and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [k in level for k in range(n)]
        arcs = {u: iter(list(residual[u])) for u in level}
        path = [source]
        while path:  # blocking flow, without recursion
            u = path[-1]
            if u == sink:
                pushed = min(residual[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    residual[a][b] -= pushed
                    residual[b][a] = residual[b].get(a, 0.0) + pushed
                while len(path) > 1 and any(residual[a][b] <= EPS for a, b in zip(path, path[1:])):
                    path.pop()
                continue
            for v in arcs[u]:
                if level.get(v) == level[u] + 1 and residual[u][v] > EPS:
                    path.append(v)
                    break
            else:
                path.pop()
                if path:
                    level[u] = -1

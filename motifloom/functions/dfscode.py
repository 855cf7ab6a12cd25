"""DFS codes of small labelled graphs.

A code is a list of edges (from, to, from_label, edge_label, to_label) over vertices numbered in order of discovery. A
vertex label stands at the first edge of the vertex only, -1 elsewhere. Of all codes of a graph the least one, in the order
of gSpan (Yan and Han, 2002), is its canonical form.

In directed graphs an edge label holds the direction in which the code walks the edge: 2 x label along it, plus 1 against it.
"""

from __future__ import annotations

Edge = tuple[int, int, int, int, int]


def labels(code: list[Edge]) -> dict[int, int]:
    """Vertex labels of a code."""
    found: dict[int, int] = {}
    for f, t, lf, _, lt in code:
        if f not in found:
            found[f] = lf
        if t not in found:
            found[t] = lt
    return found


def rightmost_path(code: list[Edge]) -> list[int]:
    """Vertices from the root to the vertex discovered last."""
    parent = {t: f for f, t, *_ in code if t > f}
    path = [max(parent)]
    while path[-1] in parent:
        path.append(parent[path[-1]])
    return path[::-1]


def least_code(vertex: dict[int, int], edges: list[tuple[int, int, int]], at_most: list[Edge] | None = None, directed: bool = False) -> list[Edge] | None:
    """The least code of a connected graph; None as soon as it is seen to be less than at_most. Labels of directed edges are those from u to v.

    All ways to begin the least code are grown together: of all their possible next edges the least ones stay. A backward
    edge comes before a forward one; backward edges order by target and label, forward edges by source (deepest first),
    edge label and vertex label.
    """
    near: dict[int, list[tuple[int, int, int]]] = {v: [] for v in vertex}
    for i, (u, v, label) in enumerate(edges):
        near[u].append((v, label, i))
        near[v].append((u, label ^ directed, i))
    least = min((vertex[u], label, vertex[v]) for u in near for v, label, _ in near[u])
    code: list[Edge] = [(0, 1, *least)]
    grown = [((u, v), frozenset([i])) for u in near for v, label, i in near[u] if (vertex[u], label, vertex[v]) == least]
    while True:
        if at_most is not None and code[-1] != at_most[len(code) - 1]:
            return None
        if len(code) == len(edges):
            return code
        path = rightmost_path(code)
        last = path[-1]
        best: tuple | None = None
        kept: list[tuple[tuple[int, ...], frozenset[int]]] = []
        for order, used in grown:
            place = {v: k for k, v in enumerate(order)}
            for source in path:
                for v, label, i in near[order[source]]:
                    if i in used:
                        continue
                    if v in place:
                        if source != last or place[v] not in path:
                            continue
                        key, made = (0, place[v], label, 0), (last, place[v], -1, label, -1)
                        new = order
                    else:
                        key, made = (1, -source, label, vertex[v]), (source, len(order), -1, label, vertex[v])
                        new = (*order, v)
                    if best is None or key < best[0]:
                        best, kept = (key, made), []
                    if key == best[0]:
                        kept.append((new, used | {i}))
        if best is None:
            raise ValueError("the graph is not connected")
        code.append(best[1])
        grown = list(dict.fromkeys(kept))


def is_least(code: list[Edge], directed: bool = False) -> bool:
    """Whether a code is the canonical one of its graph."""
    return least_code(labels(code), [(f, t, le) for f, t, _, le, _ in code], code, directed) is not None

"""Searches within one distribution's graph, where the graph is: plain lists on a Python worker.

A distribution is bounded by the limits of unpacking, so its edges fit a task; no search needs an exchange or a
job of its own. The rules are those of ``reach``, which searches graphs that are tables: of the shortest paths the one with the
smallest nodes, and of like edges the first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

#: Edges of a path, nodes of the walk back from a decoder, and nodes of the walk back from an opened file, at most (fixed values).
DEPTH, CONSTANT_NODES, PATH_NODES = 64, 4096, 256

Adjacent = dict[int, list[tuple[int, int]]]
Path = tuple[list[int], list[int]]


def adjacent(edges: Iterable[tuple[int, int, int]]) -> Adjacent:
    """Neighbours by node, each with the edge, in order. ``edges``: src, dst, edge."""
    out: Adjacent = defaultdict(list)
    for src, dst, edge in edges:
        out[src].append((dst, edge))
    for v in out.values():
        v.sort()
    return out


def paths_from(near: Adjacent, start: int, ends: set[int], depth: int = DEPTH) -> dict[int, Path]:
    """X-01, X-03: the canonical shortest path to each of ``ends`` that is reached; to ``start`` the empty one."""
    parent: dict[int, tuple[int, int] | None] = {start: None}
    level = [start]  # in the order of paths
    for _ in range(depth):
        new = []
        for u in level:
            for v, e in near.get(u, ()):
                if v not in parent:
                    parent[v] = (u, e)
                    new.append(v)
        if not new:
            break
        level = new
    out = {}
    for end in ends & parent.keys():
        nodes, edges = [end], []
        while (step := parent[nodes[-1]]) is not None:
            nodes.append(step[0])
            edges.append(step[1])
        out[end] = (nodes[::-1], edges[::-1])
    return out


def walked(near: Adjacent, start: int, bound: int | None = None) -> tuple[list[int], bool]:
    """X-04: nodes in the order of discovery, at most ``bound``, and whether these are all."""
    seen, queue = {start}, [start]
    for u in queue:
        for v, _ in near.get(u, ()):
            if v not in seen:
                if bound is not None and len(queue) >= bound:
                    return queue, False
                seen.add(v)
                queue.append(v)
    return queue, True


def live(near_back: Adjacent, ends: Iterable[int]) -> set[int]:
    """X-02: nodes with a path to any end."""
    seen, queue = set(ends), list(ends)
    for u in queue:
        for v, _ in near_back.get(u, ()):
            if v not in seen:
                seen.add(v)
                queue.append(v)
    return seen


def data_paths(edges: list[tuple[int, int, int]], starts: Iterable[int], ends: set[int]) -> Iterator[tuple[int, int, Path]]:
    """X-03: (start, end, path) for each start and each end it reaches; what leads to no end is left out first."""
    useful = live(adjacent((b, a, e) for a, b, e in edges), ends)
    near = adjacent(x for x in edges if x[1] in useful)
    for s in sorted(set(starts)):
        if s in useful:
            for end, path in sorted(paths_from(near, s, ends).items()):
                yield s, end, path


def paths_via(edges: list[tuple[int, int, int]], starts: Iterable[int], via: list[tuple[int, int]], ends: set[int]) -> Iterator[tuple[int, int, Path]]:
    """X-06: paths through a joint (where a leg stops, where the next begins); the joint is the edge -1.

    Each joint takes the first start that reaches it, each end the first joint.
    """
    first: dict[int, tuple] = {}
    for s, stop, (nodes, es) in data_paths(edges, starts, {a for a, _ in via}):
        first[stop] = min(first.get(stop, (s, len(es), nodes, es)), (s, len(es), nodes, es))
    joint: dict[int, tuple] = {}
    for stop, go in via:
        if stop in first:
            joint[go] = min(joint.get(go, (stop, first[stop])), (stop, first[stop]))
    best: dict[int, tuple] = {}
    for go, end, (nodes, es) in data_paths(edges, joint, ends):
        best[end] = min(best.get(end, (go, joint[go], nodes, es)), (go, joint[go], nodes, es))
    for end, (_, (_, (s, _, n1, e1)), n2, e2) in sorted(best.items()):
        yield s, end, (n1 + n2, [*e1, -1, *e2])


def phases(calls: Iterable[tuple[int, int]], roots: Iterable[tuple[int, int]]) -> dict[int, int]:
    """H-03: the largest phase among the roots that reach a node. ``roots``: node, phase."""
    near = adjacent((a, b, 0) for a, b in calls)
    out: dict[int, int] = {}
    by_phase = defaultdict(list)
    for node, phase in roots:
        by_phase[phase].append(node)
    for phase in sorted(by_phase, reverse=True):
        queue = [n for n in dict.fromkeys(by_phase[phase]) if n not in out]
        out.update(dict.fromkeys(queue, phase))
        for u in queue:
            for v, _ in near.get(u, ()):
                if v not in out:
                    out[v] = phase
                    queue.append(v)
    return out


def is_constant(back: Adjacent, kinds: dict[int, str], node: int) -> bool:
    """M-06: everything that a call's input comes from is a literal or a definition; not so if the walk is cut."""
    nodes, whole = walked(back, node, CONSTANT_NODES)
    leaves = [v for v in nodes if not back.get(v)]
    return whole and bool(leaves) and all(v != node and kinds[v] in ("literal", "definition") for v in leaves)

"""A robust-pruned directed graph over unit vectors, built and searched in numpy by batches."""

import numpy as np

DEGREE, SPARE, BEAM, RELAX, WIDTH, ENTRIES = 32, 16, 64, 1.2, 4, 64
#: Of its nearest neighbours so many link back for good, if they don't do so to `WARDS` nodes already: else nodes that are far from all others can't be reached.
GUARDS, WARDS = 2, 6
#: Queries that are searched side by side, and cosines between candidates that are held at once.
SIDE, CELLS = 128, 1 << 20
_NONE = np.float32(np.inf)
#: A beam's places are numbers: bits of the distance, then the node, then whether it is expanded. The largest is an empty place.
_EMPTY, _LOW, _ONE, _HALF = np.uint64(2**64 - 1), np.uint64(2**32 - 1), np.uint64(1), np.uint64(32)


def _places(far: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    return np.maximum(far, 0, dtype=np.float32).view(np.uint32).astype(np.uint64) << _HALF | nodes.astype(np.uint64) << _ONE


def _nodes(places: np.ndarray) -> np.ndarray:
    return ((places & _LOW) >> _ONE).astype(np.int64)


def search(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy beam search of all queries side by side.

    Returns the beam of each query (nodes, nearest first, -1 where there are fewer), the distances
    1 - cosine, and the nodes expanded (-1: none). Every step expands the `width` nearest nodes
    of a beam that are not yet expanded; a query ends when its beam has none.
    """
    parts = [_search(vectors, graph, entries, queries[a : a + SIDE], beam, width) for a in range(0, max(1, len(queries)), SIDE)]
    most = max(p[2].shape[1] for p in parts)
    expanded = [np.pad(p[2], ((0, 0), (0, most - p[2].shape[1])), constant_values=-1) for p in parts]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(expanded)


def _search(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, q = len(graph), len(queries)
    base = np.arange(q) * n
    seen = np.zeros(q * n, dtype=np.int32)
    seen.reshape(q, n)[:, entries] = -1
    held = np.sort(_places(1 - queries @ vectors[entries].T, np.broadcast_to(entries, (q, len(entries)))), axis=1)[:, :beam]
    held = np.pad(held, ((0, 0), (0, beam - held.shape[1])), constant_values=_EMPTY)
    steps = [np.full((q, 0), -1, dtype=np.int32)]
    while True:
        open_ = (held & _ONE) == 0
        rank = np.cumsum(open_, axis=1, dtype=np.int32)
        row, column = np.nonzero(open_ & (rank <= width))
        if not len(row):
            break
        node = _nodes(held[row, column])
        held[row, column] |= _ONE
        step = np.full((q, width), -1, dtype=np.int32)
        step[row, rank[row, column] - 1] = node
        steps.append(step)
        links = graph.take(node, axis=0)
        linked = links >= 0
        at, own = (base[row][:, None] + links)[linked], np.repeat(row, linked.sum(axis=1))
        new = np.flatnonzero(seen.take(at) == 0)
        at, own = at[new], own[new]
        mark = np.arange(1, len(at) + 1, dtype=np.int32)
        seen[at] = mark
        new = np.flatnonzero(seen.take(at) == mark)  # of a node that several others link to only one is left
        own, node = own[new], at[new] - base[own[new]]
        places = _places(1 - np.einsum("ij,ij->i", queries.take(own, axis=0), vectors.take(node, axis=0)), node)
        better = np.flatnonzero(places < held[own, -1])
        own, places = own[better], places[better]
        if len(own):
            counts = np.bincount(own, minlength=q)
            more = np.full((q, counts.max()), _EMPTY)
            more[own, np.arange(len(own)) - (np.cumsum(counts) - counts)[own]] = places
            held = np.sort(np.concatenate([held, more], axis=1), axis=1)[:, :beam]
    empty = held == _EMPTY
    far = (held >> _HALF).astype(np.uint32).view(np.float32)
    return np.where(empty, -1, _nodes(held)), np.where(empty, _NONE, far), np.concatenate(steps, axis=1)


def prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Robust pruning: of each node's candidates (-1: none), up to `degree` diverse ones.

    The nearest candidate is kept, and it removes those that are `relax` times nearer to it than
    to the node; then the nearest of the rest, and so on.
    """
    rows = max(1, CELLS // candidates.shape[1] ** 2)
    parts = [_prune(vectors, nodes[a : a + rows], candidates[a : a + rows], degree, relax) for a in range(0, len(nodes), rows)]
    return np.concatenate(parts) if parts else np.zeros((0, degree), dtype=np.int32)


def _prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    candidates = np.sort(candidates, axis=1)
    valid = (candidates >= 0) & (candidates != nodes[:, None])
    valid[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    far = 1 - np.einsum("ij,ikj->ik", vectors[nodes], vectors.take(np.maximum(candidates, 0), axis=0))
    far = np.where(valid, far, _NONE)
    order = np.argsort(far, axis=1)[:, : max(1, int(valid.sum(axis=1).max()))]
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    found = vectors.take(np.maximum(candidates, 0), axis=0)
    alive, rows = far < _NONE, np.arange(len(nodes))
    # distances are square roots of 2 - 2 * cosine, so `relax` is squared here
    near = np.where(alive, 1 - far / np.float32(relax**2), _NONE)
    removes = np.matmul(found, found.transpose(0, 2, 1)) >= near[:, None, :]
    out = np.full((len(nodes), degree), -1, dtype=np.int32)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[:, k] = np.where(some, candidates[rows, first], -1)
        alive &= ~removes[rows, first]
        alive[rows, first] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, batch: int = 256, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The graph (n rows of up to `degree` neighbours, -1 where fewer) and its entry nodes.

    Nodes join in a random order, by batches. A search of the graph so far proposes each node's
    candidates (the first batch: all of it), and pruning picks its neighbours. Links back are
    added while a node has room for `SPARE` more, and then pruned, but for those of guards.
    """
    n = len(vectors)
    order = np.random.default_rng(seed).permutation(n)
    entries = np.sort(order[:ENTRIES])
    room = degree + SPARE
    graph, size, wards = np.full((n, room + WARDS), -1, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for start in range(0, n, batch):
        nodes = order[start : start + batch]
        candidates = search(vectors, graph, entries, vectors[nodes], beam)[2] if start else np.tile(nodes, (len(nodes), 1))
        graph[nodes, :degree] = prune(vectors, nodes, candidates, degree, relax)
        size[nodes] = (graph[nodes, :degree] >= 0).sum(axis=1)
        _guard(graph, wards, nodes, degree, room)
        _link_back(vectors, graph[:, :room], size, nodes, degree, relax)
    out = np.empty((n, degree), dtype=np.int32)
    for a in range(0, n, batch):
        full = np.arange(a, min(n, a + batch))
        links, kept = prune(vectors, full, graph[full, :room], degree, relax), graph[full, room:]
        links[(links[:, :, None] == kept[:, None, :]).any(axis=2)] = -1
        links = np.concatenate([kept, links], axis=1)
        out[full] = np.take_along_axis(links, np.argsort(links < 0, axis=1, kind="stable"), 1)[:, :degree]
    return out, entries


def _guard(graph: np.ndarray, wards: np.ndarray, nodes: np.ndarray, degree: int, room: int) -> None:
    """Links back to these nodes, from their nearest neighbours that have a place for them, in place."""
    guards = np.zeros(len(nodes), dtype=np.int64)
    for k in range(degree):
        who = np.flatnonzero((guards < GUARDS) & (graph[nodes, k] >= 0))
        if not len(who):
            break
        to, first = np.unique(graph[nodes[who], k], return_index=True)  # one a round
        free = wards[to] < WARDS
        to, who = to[free], who[first[free]]
        graph[to, room + wards[to]] = nodes[who]
        wards[to] += 1
        guards[who] += 1


def _link_back(vectors: np.ndarray, graph: np.ndarray, size: np.ndarray, nodes: np.ndarray, degree: int, relax: float) -> None:
    """Links to these nodes from each of their neighbours, in place."""
    source, target = np.repeat(nodes, degree), graph[nodes, :degree].ravel().astype(np.int64)
    source, target = source[target >= 0], target[target >= 0]
    new = ~(graph[target] == source[:, None]).any(axis=1)
    source, target = source[new], target[new]
    at = np.lexsort((source, target))
    source, target = source[at], target[at]
    to, first, counts = np.unique(target, return_index=True, return_counts=True)
    column = np.arange(len(target)) - np.repeat(first, counts)
    fits = size[to] + counts <= graph.shape[1]
    easy = np.repeat(fits, counts)
    graph[target[easy], size[target[easy]] + column[easy]] = source[easy]
    size[to[fits]] += counts[fits]
    crowded = np.flatnonzero(~fits)
    crowded = crowded[np.argsort(counts[crowded], kind="stable")]  # of like counts, so that little is padding
    for a in range(0, len(crowded), 256):
        part = crowded[a : a + 256]
        n = counts[part]
        back, row = np.full((len(part), n.max()), -1, dtype=np.int32), np.repeat(np.arange(len(part)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        back[row, place] = source[np.repeat(first[part], n) + place]
        kept = prune(vectors, to[part], np.concatenate([graph[to[part]], back], axis=1), degree, relax)
        graph[to[part]] = -1
        graph[to[part], :degree] = kept
        size[to[part]] = (kept >= 0).sum(axis=1)

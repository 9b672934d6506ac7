"""Plain versions of graph measures, one vertex at a time."""

from collections import defaultdict


def neighbours(rows):
    """vertex -> {neighbour: weight} of (a, b, weight)."""
    near = defaultdict(dict)
    for a, b, *w in rows:
        near[a][b] = near[b][a] = w[0] if w else 1
    return near


def brandes(rows):
    """Un-normalised betweenness of an undirected graph."""
    near = neighbours(rows)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order = {s: 0}, defaultdict(float, {s: 1.0}), [s]
        for v in order:
            for t in near[v]:
                if t not in dist:
                    dist[t] = dist[v] + 1
                    order.append(t)
                if dist[t] == dist[v] + 1:
                    paths[t] += paths[v]
        dep = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                total[w] += dep[w] / 2
    return total


def modularity(rows, part):
    near = neighbours(rows)
    total = sum(sum(x.values()) for x in near.values())
    inside, mass = 0.0, defaultdict(float)
    for v, x in near.items():
        mass[part[v]] += sum(x.values())
        inside += sum(w for t, w in x.items() if part[t] == part[v])
    return inside / total - sum((m / total) ** 2 for m in mass.values())


def louvain(rows):
    """Community of every vertex: vertices move one by one, communities become vertices, until nothing changes."""
    near = {v: dict(x) for v, x in neighbours(rows).items()}
    member = {v: v for v in near}
    total = sum(sum(x.values()) for x in near.values())
    while True:
        strength = {v: sum(x.values()) for v, x in near.items()}
        part, mass, any_ = {v: v for v in near}, dict(strength), False
        moved = True
        while moved:
            moved = False
            for v in sorted(near):
                links = defaultdict(float)
                for t, w in near[v].items():
                    if t != v:
                        links[part[t]] += w
                here = part[v]
                mass[here] -= strength[v]
                best, gain = here, links[here] - strength[v] * mass[here] / total
                for c in sorted(links):
                    if links[c] - strength[v] * mass[c] / total > gain + 1e-12:
                        best, gain = c, links[c] - strength[v] * mass[c] / total
                mass[best] += strength[v]
                if best != here:
                    part[v], moved, any_ = best, True, True
        member = {v: part[c] for v, c in member.items()}
        if not any_:
            return member
        folded = defaultdict(lambda: defaultdict(float))
        for v, x in near.items():
            for t, w in x.items():
                folded[part[v]][part[t]] += w
        near = {v: dict(x) for v, x in folded.items()}

"""Gray-order hierarchical index over fingerprints (numpy), for links of few differing bits.

Rows come sorted by bucket, then by Gray rank, which puts codes with long shared bit patterns side by side. The upper
nodes of the index are the buckets (the masked pattern that their members share); below them stand runs of ``FAN`` nodes
down to leaves of ``LEAF`` codes. A node keeps the bits on which all its members agree and that its parent does not keep
already, so a query adds up differences on the way down and drops a whole group once they exceed the limit. Every link
comes out of such a descent, whatever the size of the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

LEAF = 4
_FAN = 4
#: Places (query, leaf) that one descent may hold.
_ROOM = 1 << 21


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class _Sets:
    """Union of members; labels are the smallest member's position."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Joins pairs of positions in their order; returns those that joined two sets."""
        la, lb = self.label[a], self.label[b]
        new = la != lb
        if not new.any():
            return [], []
        a, b, la, lb = a[new], b[new], la[new], lb[new]
        _, first = np.unique(np.minimum(la, lb) * len(self.label) + np.maximum(la, lb), return_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        left, right = [], []
        for i in np.sort(first).tolist():
            x, y = find(int(la[i])), find(int(lb[i]))
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(int(a[i]))
                right.append(int(b[i]))
        old = np.array(list(root))
        to = np.arange(len(self.label))
        to[old] = [find(int(x)) for x in old]
        self.label = to[self.label]
        return left, right


class Index:
    """Nodes over rows (``bucket`` sorted, ``lanes``: n x w uint64), from leaves to one upper node per bucket."""

    def __init__(self, bucket: np.ndarray, lanes: np.ndarray) -> None:
        self.lanes = lanes
        owner = np.cumsum(np.r_[False, bucket[1:] != bucket[:-1]])
        self.home = owner  # a row's upper node
        self.starts: list[np.ndarray] = []  # first child (row, for leaves) of every node
        agreed, values = [], []
        every = some = lanes
        width = LEAF
        while True:
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(begins, np.diff(np.r_[begins, len(owner)]))
            starts = np.flatnonzero(place % width == 0)
            every, some = np.bitwise_and.reduceat(every, starts, axis=0), np.bitwise_or.reduceat(some, starts, axis=0)
            owner = owner[starts]
            self.starts.append(starts)
            agreed.append(~(every ^ some))
            values.append(every)
            if len(starts) == owner[-1] + 1:
                break
            width = _FAN
        self.values = values
        self.ends: list[np.ndarray] = []  # one past the last child
        self.reach: list[np.ndarray] = []  # one past the last row
        self.own: list[np.ndarray] = []  # agreed bits that the parent does not hold
        for k, starts in enumerate(self.starts):
            below = len(self.reach[k - 1]) if k else len(lanes)
            self.ends.append(np.r_[starts[1:], below])
            self.reach.append(self.ends[k] if k == 0 else self.reach[k - 1][self.ends[k] - 1])
        for k, mine in enumerate(agreed):
            if k + 1 < len(agreed):
                parent = np.repeat(np.arange(len(self.starts[k + 1])), self.ends[k + 1] - self.starts[k + 1])
                mine = mine & ~agreed[k + 1][parent]
            self.own.append(mine)
        self.visited = self.pruned = 0

    def _near(self, limit: int, labels: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, positions, differing bits) of pairs of at most ``limit`` differing bits, a block of queries at a time.

        A leaf whose members all carry the query's label is passed over, so pairs of one label may be left out.
        """
        n = len(self.lanes)
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, self.home[1:] != self.home[:-1]]), n])
        step = int(max(1, min(n, _ROOM // max(1, int(sizes.max(initial=1)) // LEAF))))
        for at in range(0, n, step):
            who = np.arange(at, min(at + step, n))
            node, acc = self.home[who], np.zeros(len(who), dtype=np.int64)
            for k in range(len(self.starts) - 1, -1, -1):
                acc = acc + np.bitwise_count((self.lanes[who] ^ self.values[k][node]) & self.own[k][node]).sum(axis=1, dtype=np.int64)
                later = self.reach[k][node] > who + 1
                near = acc <= limit
                self.visited += int(later.sum())
                self.pruned += int((later & ~near).sum())
                near &= later
                who, node, acc = who[near], node[near], acc[near]
                if k == 0:
                    label = labels()
                    low, high = np.minimum.reduceat(label, self.starts[0]), np.maximum.reduceat(label, self.starts[0])
                    open_ = ~((low[node] == high[node]) & (low[node] == label[who]))
                    who, node, acc = who[open_], node[open_], acc[open_]
                count = self.ends[k][node] - self.starts[k][node]
                first = np.repeat(self.starts[k][node] - np.r_[0, np.cumsum(count)[:-1]], count) if len(count) else count
                who, acc = np.repeat(who, count), np.repeat(acc, count)
                node = first + np.arange(len(who))
            real = node > who
            a, b = who[real], node[real]
            away = np.bitwise_count(self.lanes[a] ^ self.lanes[b]).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(away <= limit)
            yield a[hit], b[hit], away[hit]

    def forest(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of links of at most ``limit`` differing bits that span the components inside every bucket.

        Nearer links go first inside a block of queries. At most members - 1 links of a bucket are returned.
        """
        sets, left, right = _Sets(len(self.lanes)), [], []
        for a, b, away in self._near(limit, lambda: sets.label):
            order = np.argsort(away, kind="stable")
            u, v = sets.union(a[order], b[order])
            left += u
            right += v
        return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _crowded(bucket: np.ndarray) -> np.ndarray:
    """Positions in buckets of two rows or more."""
    n = len(bucket)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.repeat(np.diff(np.r_[starts, n]) > 1, np.diff(np.r_[starts, n])))


def bucket_links(bucket: np.ndarray, lanes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Spanning links inside every bucket (positions), groups looked at and groups pruned; rows sorted as above."""
    shared = _crowded(bucket)
    if not len(shared):
        return shared, shared, 0, 0
    index = Index(bucket[shared], lanes[shared])
    a, b = index.forest(limit)
    return shared[a], shared[b], index.visited, index.pruned

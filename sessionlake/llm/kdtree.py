"""K-d trees over vectors of small counts, with searches for vectors one edit away.

An edit of a word puts one letter in, takes one out, or both. So a search has one step up
and one step down to spend, and visits a child if the box of its counts can be
reached with them. Trees are built and searched level by level, all nodes or queries of
a level at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Node i sends vectors whose component dim[i] is at most cut[i] to child[i], others to the
    next node; leaves have dim -1 and hold rows[begin[i]:end[i]]."""

    dim: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    rows: np.ndarray


def build(v: np.ndarray, most: int) -> Tree:
    """A tree whose leaves hold at most `most` rows of v, or rows that are all alike."""
    dim, cut, child, begin, end = ([-1], [0], [-1], [0], [len(v)])
    rows = np.arange(len(v))
    used = np.flatnonzero(v.min(0) != v.max(0)) if len(v) else np.zeros(0, int)
    v = v[:, used]
    open_ = np.array([0] if len(used) else [], dtype=np.int64)
    while len(open_):
        size = np.array([end[i] - begin[i] for i in open_])
        open_, size = open_[size > most], size[size > most]
        if not len(open_):
            break
        own = np.concatenate([rows[begin[i]:end[i]] for i in open_])
        starts = np.append(0, np.cumsum(size)[:-1])
        part = v[own].astype(np.int64)
        mean = np.add.reduceat(part, starts) / size[:, None]
        spread = np.add.reduceat(part * part, starts) / size[:, None] - mean * mean
        widest = spread.argmax(1)
        at = np.arange(len(open_))
        split = spread[at, widest] > 1e-9
        middle = np.floor(mean[at, widest]).astype(np.int64)
        of = np.repeat(at, size)
        above = part[np.arange(len(own)), widest[of]] > middle[of]
        order = np.lexsort((above, of))
        own, n_above = own[order], np.add.reduceat(above.astype(np.int64), starts)
        following = []
        for k, i in enumerate(open_):
            rows[begin[i]:end[i]] = own[starts[k]:starts[k] + size[k]]
            if split[k]:
                dim[i], cut[i], child[i] = int(used[widest[k]]), int(middle[k]), len(dim)
                edge = end[i] - int(n_above[k])
                for a, b in ((begin[i], edge), (edge, end[i])):
                    following.append(len(dim))
                    dim.append(-1), cut.append(0), child.append(-1), begin.append(a), end.append(b)
        open_ = np.array(following)
    return Tree(*(np.array(x) for x in (dim, cut, child, begin, end)), rows)


def home(tree: Tree, v: np.ndarray) -> np.ndarray:
    """The leaf of each row of v."""
    node = np.zeros(len(v), dtype=np.int64)
    while (on := np.flatnonzero(tree.dim[node] >= 0)).size:
        at = node[on]
        node[on] = tree.child[at] + (v[on, tree.dim[at]] > tree.cut[at])
    return node


def near(tree: Tree, v: np.ndarray, down: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of v, leaf) for every leaf that may hold a vector with one component one
    greater and, if `down`, one later component one smaller. As one of the two
    orders is enough to find a pair from one of its ends, the smaller one has to come later."""
    n = len(v)
    q, node = np.arange(n), np.zeros(n, dtype=np.int64)
    up = np.full(n, -1, dtype=np.int64)
    # a component past the last one: the step down is spent
    less = np.full(n, -1 if down else v.shape[1], dtype=np.int64)
    found = []
    while len(q):
        d = tree.dim[node]
        at_leaf = d < 0
        found.append((q[at_leaf], node[at_leaf]))
        on = ~at_leaf
        q, node, up, less, d = q[on], node[on], up[on], less[on], d[on]
        c = v[q, d] + (up == d) - (less == d)
        t = tree.cut[node]
        right = c > t
        rise = (c == t) & (up < 0) & ((less < 0) | (d < less))
        fall = (c == t + 1) & (less < 0) & (up < d)
        q, node, up, less = (
            np.concatenate([q, q[rise], q[fall]]),
            np.concatenate([tree.child[node] + right, tree.child[node[rise]] + 1, tree.child[node[fall]]]),
            np.concatenate([up, d[rise], up[fall]]), np.concatenate([less, less[rise], d[fall]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

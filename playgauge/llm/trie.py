"""A prefix tree over ordered sets, and the similarity join that walks it."""

from __future__ import annotations

import numpy as np


#: Fewer sets than this with a common beginning stay leaves of the node above, and are looked at together.
BURST = 24


class Node:
    """A run of tokens that all sets below share, after what the nodes above have."""

    __slots__ = ("tokens", "depth", "children", "leaves", "tails", "prefixes", "cuts", "least", "most", "range")

    def __init__(self, tokens: np.ndarray, depth: int):
        self.tokens = tokens  # of this run
        self.depth = depth  # tokens up to the end of the run
        self.children: list[Node] = []
        self.leaves: list[int] = []  # sets that branch off here, by number
        self.tails: list[np.ndarray] = []  # their remaining tokens


class Trie:
    """Sets of integers in ascending order, stored by their common beginnings."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        #: Set numbers in lexicographic order, in which the sets below a node are a range.
        self.order = np.array(order, dtype=np.int64)
        self.root = self._build(order, 0, np.zeros(0, dtype=np.int32))

    def _build(self, order: list[int], depth: int, run: np.ndarray) -> Node:
        """Node of sets in lexicographic order that agree up to ``depth``."""
        node = Node(run, depth)
        node.range = (0, len(order))
        stack = [(node, order)]
        while stack:
            top, members = stack.pop()
            at = top.depth
            heads = np.array([self.sets[i][at] if self.sizes[i] > at else -1 for i in members], dtype=np.int64)
            bounds = np.flatnonzero(np.diff(heads, prepend=-2, append=-2))
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a < BURST or heads[a] < 0:
                    top.leaves += members[a:b]
                    continue
                group = members[a:b]
                one, last = self.sets[group[0]], self.sets[group[-1]]
                n = min(len(one), len(last))
                differ = np.flatnonzero(one[at:n] != last[at:n])
                end = at + int(differ[0]) if len(differ) else n
                child = Node(one[at:end], end)
                child.range = (top.range[0] + int(a), top.range[0] + int(b))
                top.children.append(child)
                stack.append((child, group))
            self._close(top, members)
        return node

    def _close(self, node: Node, members: list[int]) -> None:
        sizes = self.sizes[members]
        node.least, node.most = int(sizes.min()), int(sizes.max())
        leaves = np.array(node.leaves, dtype=np.int64)
        node.leaves = leaves
        node.tails = [self.sets[i][node.depth :] for i in leaves]
        # The tokens after which a tail that met none of the query's can't reach the bound any more.
        heads = [self.sets[i][node.depth : node.depth + allowed(int(self.sizes[i]), self.percent) + 1] for i in leaves]
        node.cuts = np.cumsum([0, *map(len, heads)])
        node.prefixes = np.concatenate(heads) if heads else np.zeros(0, dtype=np.int32)

    def linked(self, query: np.ndarray, marks: np.ndarray, skip) -> "list[int]":
        """Numbers of stored sets similar to ``query``.

        ``marks`` is true at the query's tokens. ``skip(leaves)`` tells which leaves needn't be looked at,
        and is asked again after each hit that the caller has been given.
        """
        size, percent = len(query), self.percent
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if skip(self.order[slice(*node.range)]).all():
                continue
            if node.most * 100 < percent * size or size * 100 < percent * node.least:
                continue
            if len(node.tokens):
                shared += int(marks[node.tokens].sum())
                # What the query and the sets below can still share after this run.
                rest = size - int(np.searchsorted(query, node.tokens[-1], "right"))
                best = shared + min(rest, node.most - node.depth)
                if best < needed(size, max(node.least, best), percent):
                    continue
            if len(node.leaves):
                yield from self._leaves(node, shared, size, marks, skip)
            stack += [(child, shared) for child in node.children]

    def _leaves(self, node: Node, shared: int, size: int, marks: np.ndarray, skip):
        sizes = self.sizes[node.leaves]
        lengths = np.diff(node.cuts)
        met = np.zeros(len(lengths), dtype=np.int64)
        filled = lengths > 0
        if len(node.prefixes):
            met[filled] = np.add.reduceat(marks[node.prefixes], node.cuts[:-1][filled], dtype=np.int64)
        # At best all tokens after the looked-at beginning are shared.
        best = np.minimum(shared + met + (sizes - node.depth - lengths), size)
        open_ = (best * (100 + self.percent) >= self.percent * (size + sizes)) & ~skip(node.leaves)
        while open_.any():
            i = int(np.argmax(open_))
            open_[i] = False
            both = shared + int(marks[node.tails[i]].sum())
            if 100 * both >= self.percent * (size + int(sizes[i]) - both):
                yield int(node.leaves[i])
                open_ &= ~skip(node.leaves)


def allowed(size: int, percent: int) -> int:
    """Tokens of a set of this size that a similar set may lack."""
    return size - -(-percent * size // 100)


def needed(size: int, other: int, percent: int) -> int:
    """Least number of shared tokens that makes sets of these sizes similar."""
    return -(-percent * (size + other) // (100 + percent))


def join_sets(stored: list[np.ndarray], queries: list[np.ndarray] | None, percent: int) -> list[int]:
    """Component number of every set: the stored ones, then the queries, linked where similar.

    Without queries the stored sets are joined among themselves. Sets already in one component aren't
    compared again, which loses no component.
    """
    trie = Trie(stored, percent)
    asked = stored if queries is None else queries
    size = 1 + max((int(s[-1]) for s in [*stored, *asked] if len(s)), default=0)
    marks = np.zeros(size, dtype=bool)
    own = np.arange(len(stored) + (0 if queries is None else len(queries)))
    for q, query in enumerate(asked):
        me = q if queries is None else len(stored) + q
        marks[query] = True
        for hit in trie.linked(query, marks, lambda leaves: own[leaves] == own[me]):  # noqa: B023
            a, b = sorted((own[hit], own[me]))
            own[own == b] = a
        marks[query] = False
    return own.tolist()

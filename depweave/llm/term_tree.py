"""A tree of documents by their terms, most frequent first, and its search for the best of each item."""

from __future__ import annotations

from heapq import heappush, heapreplace, nsmallest

import numpy as np

#: Entries of children whose bounds are computed at once, and entries of maxima that a tree keeps; nodes beyond have no bound of their own.
CHUNK, KEPT = 200_000, 8_000_000
#: A document's share of a term is SCALE * tf / (1000 * tf + 12 * m), rounded down.
SCALE, OF_TF, OF_M = 1_000_000_000, 1000, 12


def share(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (OF_TF * tf + OF_M * m)


class Node:
    """A stretch of documents that begin with the same ``depth`` terms.

    ``terms`` and ``tf`` are all terms below with their largest tf, ``m`` is the least m below.
    ``own`` are ids of the documents whose terms end here.
    """

    __slots__ = ("depth", "children", "own", "own_terms", "own_tf", "own_m", "terms", "tf", "m")

    def __init__(self, depth: int):
        self.depth, self.children, self.own, self.terms = depth, [], None, None
        self.own_terms = self.own_tf = self.tf = None
        self.own_m = self.m = 0

    def close(self, room: int) -> int:
        """Takes the maxima of what is below; says how many entries it keeps of its own."""
        if not self.children:
            self.terms, self.tf, self.m = self.own_terms, self.own_tf, self.own_m
            return 0
        self.m = min([c.m for c in self.children] + [self.own_m] * (self.own is not None))
        parts = [(c.terms, c.tf) for c in self.children] + [(self.own_terms, self.own_tf)] * (self.own is not None)
        if room <= 0 or any(t is None for t, _ in parts):
            return 0
        terms, tf = np.concatenate([t for t, _ in parts]), np.concatenate([f for _, f in parts])
        order = np.argsort(terms, kind="stable")
        terms, tf = terms[order], tf[order]
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        self.terms, self.tf = terms[starts], np.maximum.reduceat(tf, starts)
        return len(starts)


def build(vectors: list[tuple[np.ndarray, np.ndarray, int, int | None]], best: int) -> Node:
    """The tree over vectors (terms in the common order, tf, m, id). Documents of equal vectors are one entry, of whose ids the ``best`` least are kept."""
    groups: dict[tuple[bytes, bytes, int], list] = {}
    for terms, tf, m, doc in vectors:
        groups.setdefault((terms.astype(">i4").tobytes(), tf.astype("<i4").tobytes(), m), []).append(doc)
    root = Node(0)
    stack, was, room = [root], b"", KEPT

    def close(down_to: int) -> None:
        nonlocal room
        while stack[-1].depth > down_to:
            done = stack.pop()
            room -= done.close(room)
            if stack[-1].depth < down_to:
                stack.append(Node(down_to))
            stack[-1].children.append(done)

    for path, tf, m in sorted(groups):
        ids = groups[path, tf, m]
        here, last = np.frombuffer(path, ">i4"), np.frombuffer(was, ">i4")
        n = min(len(here), len(last))
        differ = np.flatnonzero(here[:n] != last[:n])
        common = int(differ[0]) if len(differ) else n
        close(common)
        leaf = Node(len(here))
        leaf.own = nsmallest(best, ids, key=lambda i: (i is None, i or 0))
        leaf.own_terms, leaf.own_tf, leaf.own_m, was = here.astype(np.int32), np.frombuffer(tf, "<i4"), m, path
        if stack[-1].depth == len(here) and len(stack) > 1:
            leaf.close(0)
            stack[-1].children.append(leaf)  # the same terms once more, with other numbers
        else:
            stack.append(leaf)
    close(0)
    root.close(1)
    return root


class Items:
    """Postings of some items by term: which of them have it, and its weight times its occurrences there."""

    def __init__(self, of: list[tuple[int, dict[int, int]]], n_terms: int):
        self.numbers = [k for k, _ in of]
        rows = sorted((t, i, w) for i, (_, weights) in enumerate(of) for t, w in weights.items())
        self.item = np.array([i for _, i, _ in rows], np.int64)
        self.weight = np.array([w for _, _, w in rows], np.float64)
        self.count = np.bincount(np.array([t for t, _, _ in rows], np.int64), minlength=n_terms)
        self.at = np.cumsum(self.count) - self.count

    def sums(self, parts: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        """A row for each part (terms, tf, m): the sum of weight times share of each item, exact as all are whole numbers below 2**53."""
        n = len(self.numbers)
        lengths = [len(t) for t, _, _ in parts]
        terms = np.concatenate([t for t, _, _ in parts])
        shares = share(np.concatenate([f for _, f, _ in parts]), np.repeat(np.array([m for _, _, m in parts], np.int64), lengths))
        row = np.repeat(np.arange(len(parts)) * n, lengths)
        count = self.count[terms]
        total = int(count.sum())
        place = np.arange(total) + np.repeat(self.at[terms] - (np.cumsum(count) - count), count)
        each = self.weight[place] * np.repeat(shares.astype(np.float64), count)
        return np.bincount(self.item[place] + np.repeat(row, count), weights=each, minlength=n * len(parts)).reshape(len(parts), n)


class Best:
    """The highest-scoring documents of each item so far, of equal scores those of the least id (null last)."""

    def __init__(self, n: int, best: int):
        self.best = best
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(n)]
        self.least = np.ones(n)  # what a document must reach: a score above 0, later that of the last one

    def add(self, item: int, score: int, ids: list[int | None]) -> None:
        heap = self.heaps[item]
        for i in ids:
            entry = (score, i is not None, -(i or 0))
            if len(heap) < self.best:
                heappush(heap, entry)
            elif entry > heap[0]:
                heapreplace(heap, entry)
            else:
                break
        if len(heap) == self.best:
            self.least[item] = max(1, heap[0][0])


def search(root: Node, items: Items, found: Best) -> int:
    """Adds to ``found`` the best documents of each item, depth first; says how many nodes it opened.

    A node is opened if some item's bound over it (its maxima of tf with its least m) reaches what
    that item's documents must reach; for the other items it is cut off. The most promising child
    goes first.
    """
    stack = [(root, None)]
    opened = 0
    while stack:
        node, bound = stack.pop()
        if bound is not None and not (bound >= found.least).any():
            continue
        opened += 1
        if node.own is not None:
            score = bound if not node.children and bound is not None else items.sums([(node.own_terms, node.own_tf, node.own_m)])[0]
            for i in np.flatnonzero(score >= found.least).tolist():
                found.add(i, int(score[i]), node.own)
        next_up, chunk, entries = [c for c in node.children if c.terms is None], [], 0
        stack += [(c, bound) for c in next_up]
        rated = []
        for c in [*node.children, None]:
            if c is not None and c.terms is not None:
                chunk.append(c)
                entries += len(c.terms) + len(items.numbers)
            if chunk and (c is None or entries > CHUNK):
                sums = items.sums([(x.terms, x.tf, x.m) for x in chunk])
                gain = np.maximum(sums - found.least, 0).sum(1)
                rated += [(float(g), k, x, s) for g, k, x, s, ok in zip(gain, range(len(rated), len(rated) + len(chunk)), chunk, sums, (sums >= found.least).any(1), strict=True) if ok]
                chunk, entries = [], 0
        rated.sort(key=lambda r: (r[0], r[1]))
        stack += [(x, s) for _, _, x, s in rated]
    return opened

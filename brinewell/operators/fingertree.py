"""A finger B-tree of partial aggregates keyed by event time.

Entries are (key, partial) pairs in key order. Every node caches the merged partial of its subtree; an insertion merges its partial into the
caches of its ancestors, an eviction or a split drops those that it changes and they are rebuilt when asked for. Two fingers point at the outermost leaves, so in-order
arrivals cost constant time and a record that is d entries late climbs about log d levels. Eviction below a cut unlinks whole
subtrees and touches one root-to-leaf path only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import Any

WIDTH = 16


class _Node:
    __slots__ = ("keys", "items", "parent", "cached", "leaf")

    def __init__(self, leaf: bool, parent: _Node | None = None):
        self.keys: list = []  # of a leaf its entries' keys, else the least key of each child
        self.items: list = []  # partials or children
        self.parent, self.cached, self.leaf = parent, None, leaf


class FingerTree:
    """merge(a, b) returns the partial of two disjoint sets of records; it must be associative and commutative."""

    def __init__(self, merge: Callable[[Any, Any], Any]):
        self.merge = merge
        self.root = self.right = self.left = _Node(True)

    def __bool__(self) -> bool:
        return bool(self.root.items)

    def last_key(self):
        return self.right.keys[-1] if self.right.keys else None

    def insert(self, key, partial) -> None:
        node = self.right
        if not node.keys or key >= node.keys[0]:
            pass
        elif self.left.keys and key <= self.left.keys[-1]:
            node = self.left
        else:
            while node.parent is not None and key < node.keys[0]:
                node = node.parent
            while not node.leaf:
                node = node.items[max(0, bisect_right(node.keys, key) - 1)]
        k = bisect_left(node.keys, key)
        if k < len(node.keys) and node.keys[k] == key:
            node.items[k] = self.merge(node.items[k], partial)
        else:
            node.keys.insert(k, key)
            node.items.insert(k, partial)
            if k == 0:
                self._lower(node)
        above = node
        while above is not None:
            if above.cached is not None:
                above.cached = self.merge(above.cached, partial)
            above = above.parent
        if len(node.items) > WIDTH:
            self._split(node)

    def total(self):
        """The merged partial of everything that is held, or None."""
        return self._partial(self.root)

    def evict_below(self, key) -> Iterator[tuple[Any, Any]]:
        """Unlinks all entries with keys below key and yields them in order."""
        gone: list[_Node | tuple[list, list]] = []
        node = self.root
        while True:
            if node.leaf:
                k = bisect_left(node.keys, key)
                if k:
                    gone.append((node.keys[:k], node.items[:k]))
            else:
                k = max(0, bisect_right(node.keys, key) - 1)
                gone.extend(node.items[:k])
            del node.keys[:k], node.items[:k]
            node.cached = None
            if node.leaf:
                break
            node = node.items[0]
        while not node.items and node.parent is not None:  # the boundary leaf went as a whole
            parent = node.parent
            del parent.keys[0], parent.items[0]
            node = parent
        while not self.root.leaf and len(self.root.items) == 1:
            self.root = self.root.items[0]
            self.root.parent = None
        if not self.root.items:
            self.root = self.left = self.right = _Node(True)
        else:
            node = self.root
            while not node.leaf:
                node = node.items[0]
            self.left = node
            self._lower(node)
            node = self.root
            while not node.leaf:
                node = node.items[-1]
            self.right = node
        for part in gone:
            yield from zip(*part) if isinstance(part, tuple) else self._entries(part)

    def entries(self) -> Iterator[tuple[Any, Any]]:
        yield from self._entries(self.root)

    def _entries(self, node: _Node) -> Iterator[tuple[Any, Any]]:
        if node.leaf:
            yield from zip(node.keys, node.items)
        else:
            for child in node.items:
                yield from self._entries(child)

    def _partial(self, node: _Node):
        if node.cached is None and node.items:
            parts = node.items if node.leaf else [self._partial(c) for c in node.items]
            total = parts[0]
            for p in parts[1:]:
                total = self.merge(total, p)
            node.cached = total
        return node.cached

    @staticmethod
    def _lower(node: _Node) -> None:
        while node.parent is not None:
            k = node.parent.items.index(node)
            node.parent.keys[k] = node.keys[0]
            if k:
                return
            node = node.parent

    def _split(self, node: _Node) -> None:
        while len(node.items) > WIDTH:
            half = len(node.items) // 2
            other = _Node(node.leaf, node.parent)
            other.keys, other.items = node.keys[half:], node.items[half:]
            del node.keys[half:], node.items[half:]
            node.cached = None
            if not node.leaf:
                for c in other.items:
                    c.parent = other
            if node is self.right:
                self.right = other
            if node.parent is None:
                self.root = _Node(False)
                node.parent = other.parent = self.root
                self.root.keys, self.root.items = [node.keys[0], other.keys[0]], [node, other]
                return
            k = node.parent.items.index(node)
            node.parent.keys.insert(k + 1, other.keys[0])
            node.parent.items.insert(k + 1, other)
            node = node.parent

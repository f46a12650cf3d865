"""Connected components: of an edge table, and of the edges that one task has at hand."""

from __future__ import annotations

from ..operators.components import components

__all__ = ["Forest", "components"]


class Forest:
    """Union-find over the nodes that one task has at hand."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

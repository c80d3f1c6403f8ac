"""A compressed radix trie over byte strings whose finished subtrees can be handed over and freed."""

from __future__ import annotations

from collections.abc import Iterator


def common_length(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by halving slices."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    __slots__ = ("children", "entry", "label")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.entry: list | None = None


class PatriciaTrie:
    """Terminal nodes hold ``[smallest id, row, count, rows]`` of the byte string they end."""

    def __init__(self):
        self.root = Node(b"")
        self.held = 0

    def terminal(self, key: bytes) -> Node:
        """The node that ends ``key``, made by splitting an edge where needed."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                leaf = Node(key[at:])
                node.children[key[at]] = leaf
                self.held += len(leaf.label)
                return leaf
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            shared = common_length(child.label, key, at)
            upper = Node(child.label[:shared])
            child.label = child.label[shared:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            node, at = upper, at + shared
        return node

    def finished(self, key: bytes) -> Iterator[list]:
        """Free and return every entry below ``key``; with sorted input, those subtrees are complete."""
        node, at = self.root, 0
        while at < len(key):
            if node.entry is not None:
                yield node.entry
                node.entry = None
            for first in [b for b in node.children if b < key[at]]:
                yield from self._freed(node.children.pop(first))
            node = node.children[key[at]]
            at += len(node.label)

    def drain(self) -> Iterator[list]:
        root, self.root = self.root, Node(b"")
        yield from self._freed(root)

    def _freed(self, node: Node) -> Iterator[list]:
        todo = [node]
        while todo:
            node = todo.pop()
            self.held -= len(node.label)
            if node.entry is not None:
                yield node.entry
            todo.extend(node.children.values())

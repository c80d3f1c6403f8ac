"""A persistent binary hash tree: an update makes a new root and copies only the nodes above the leaf."""

from __future__ import annotations

from hashlib import sha256

#: Where a sibling stands; a node without sibling is hashed alone.
LEFT, RIGHT, ALONE = "l", "r", "a"


def digest_of(*parts: str) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


def climb(digest: str, steps: list[str]) -> list[str]:
    """The digests above ``digest``, one for each step; a step is the side and the sibling's digest."""
    path = []
    for step in steps:
        side, sibling = step[0], step[1:]
        digest = digest_of(sibling, digest) if side == LEFT else digest_of(digest, sibling)
        path.append(digest)
    return path


class PersistentTree:
    """Nodes are only ever added; every root stays a whole tree of its own.

    ``height`` is the number of levels above the leaves. A tree that is the last, partly filled block of
    a larger one keeps the height of the others, so that its last node is hashed alone on every level.
    """

    def __init__(self, leaves: list[str], height: int):
        self.digest, self.below = list(leaves), [(-1, -1)] * len(leaves)
        self.height = height
        level = list(range(len(leaves)))
        for _ in range(height):
            level = [self._node(level[i], level[i + 1] if i + 1 < len(level) else -1) for i in range(0, len(level), 2)]
        (self.root,) = level

    def _node(self, left: int, right: int) -> int:
        self.digest.append(digest_of(self.digest[left]) if right < 0 else digest_of(self.digest[left], self.digest[right]))
        self.below.append((left, right))
        return len(self.digest) - 1

    def _descend(self, root: int, position: int) -> list[tuple[int, int]]:
        """The (left, right) pairs from ``root`` to the leaf, top first."""
        pairs, node = [], root
        for level in reversed(range(self.height)):
            pairs.append(self.below[node])
            node = pairs[-1][position >> level & 1]
        return pairs

    def replaced(self, root: int, position: int, digest: str) -> int:
        """The root of a version of ``root`` whose leaf at ``position`` is ``digest``."""
        pairs = self._descend(root, position)
        self.digest.append(digest)
        self.below.append((-1, -1))
        node = len(self.digest) - 1
        for level, (left, right) in enumerate(reversed(pairs)):
            node = self._node(left, node) if position >> level & 1 else self._node(node, right)
        return node

    def steps(self, root: int, position: int) -> list[str]:
        """What a climb from the leaf to ``root`` needs, lowest first."""
        steps = []
        for level, (left, right) in enumerate(reversed(self._descend(root, position))):
            if position >> level & 1:
                steps.append(LEFT + self.digest[left])
            else:
                steps.append(ALONE if right < 0 else RIGHT + self.digest[right])
        return steps

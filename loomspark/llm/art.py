"""An adaptive radix tree over byte keys: nodes of 4, 16, 48 or 256 places that grow as needed, and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Node4:
    """Up to 4 children in order of their bytes, found by looking at each."""

    __slots__ = ("prefix", "ends", "labels", "below")
    places = 4

    def __init__(self, prefix: bytes):
        #: Bytes of the path above the children that all keys below share; what ends here; bytes and children.
        self.prefix, self.ends = prefix, []
        self.labels, self.below = bytearray(), []

    def find(self, label: int):
        at = self.labels.find(label)
        return self.below[at] if at >= 0 else None

    def put(self, label: int, child) -> None:
        """Sets a child; there must be a place if the label is new."""
        at = bisect_left(self.labels, label)
        if at < len(self.labels) and self.labels[at] == label:
            self.below[at] = child
        else:
            self.labels.insert(at, label)
            self.below.insert(at, child)

    def children(self) -> Iterator[tuple[int, object]]:
        return zip(self.labels, self.below, strict=True)

    def count(self) -> int:
        return len(self.below)


class Node16(Node4):
    """Up to 16 children in order of their bytes, found by bisection."""

    __slots__ = ()
    places = 16

    def find(self, label: int):
        at = bisect_left(self.labels, label)
        return self.below[at] if at < len(self.labels) and self.labels[at] == label else None


class Node48(Node4):
    """Up to 48 children; a table of 256 bytes says at which place each is."""

    __slots__ = ()
    places = 48

    def __init__(self, prefix: bytes):
        super().__init__(prefix)
        self.labels = bytearray(b"\xff" * 256)

    def find(self, label: int):
        at = self.labels[label]
        return self.below[at] if at != 255 else None

    def put(self, label: int, child) -> None:
        at = self.labels[label]
        if at != 255:
            self.below[at] = child
        else:
            self.labels[label] = len(self.below)
            self.below.append(child)

    def children(self) -> Iterator[tuple[int, object]]:
        return ((label, self.below[at]) for label, at in enumerate(self.labels) if at != 255)


class Node256(Node4):
    """A place for every byte."""

    __slots__ = ()
    places = 256

    def __init__(self, prefix: bytes):
        super().__init__(prefix)
        self.below = [None] * 256

    def find(self, label: int):
        return self.below[label]

    def put(self, label: int, child) -> None:
        self.below[label] = child

    def children(self) -> Iterator[tuple[int, object]]:
        return ((label, child) for label, child in enumerate(self.below) if child is not None)

    def count(self) -> int:
        return 256 - self.below.count(None)


_LAYOUTS = (Node4, Node16, Node48, Node256)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning; both are halved rather than read byte by byte."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Tree:
    """Keys with values; a key may be the beginning of another, be empty, and come several times."""

    def __init__(self):
        self.root = Node4(b"")

    def add(self, key: bytes, value) -> None:
        above, label, node, at = None, 0, self.root, 0
        while True:
            same = _shared(node.prefix, key[at : at + len(node.prefix)])
            if same < len(node.prefix):  # the key leaves within the compressed path: cut it there
                upper = Node4(node.prefix[:same])
                upper.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                self._set(above, label, upper)
                node = upper
            at += same
            if at == len(key):
                node.ends.append(value)
                return
            child = node.find(key[at])
            if child is None:
                leaf = Node4(key[at + 1 :])
                leaf.ends.append(value)
                grown = self._roomy(node)
                if grown is not node:
                    self._set(above, label, grown)
                grown.put(key[at], leaf)
                return
            above, label, node, at = node, key[at], child, at + 1

    def _set(self, above, label: int, node) -> None:
        if above is None:
            self.root = node
        else:
            above.put(label, node)

    @staticmethod
    def _roomy(node):
        """The node, in the next layout if all its places are taken."""
        if node.count() < node.places:
            return node
        grown = _LAYOUTS[_LAYOUTS.index(type(node)) + 1](node.prefix)
        grown.ends = node.ends
        for label, child in node.children():
            grown.put(label, child)
        return grown

    def upwards(self) -> Iterator[tuple[object, int, int]]:
        """Every node after all nodes below it, with the byte depths where its path begins and ends; no recursion.

        The path counts the byte by which the node hangs under its parent.
        """
        order, stack = [], [(self.root, 0, len(self.root.prefix))]
        while stack:
            node, start, end = stack.pop()
            order.append((node, start, end))
            stack.extend((child, end, end + 1 + len(child.prefix)) for _, child in node.children())
        return reversed(order)

"""Walks over nodes: visitors that see each node on the way in and out, and filters that can prune or stop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from enum import Enum

from tagweave.markup.tree import Node


class Outcome(Enum):
    CONTINUE = "continue"
    SKIP_CHILDREN = "skip_children"
    SKIP_ENTIRELY = "skip_entirely"
    REMOVE = "remove"
    STOP = "stop"


def traverse(root: Node, head: Callable[[Node, int], None], tail: Callable[[Node, int], None] | None = None) -> None:
    """``head`` when a node is entered, ``tail`` when all below it have been; both get the depth below the root.
    A node that ``head`` removes is not entered; children that it adds are."""
    todo = [(root, 0, False)]
    while todo:
        n, depth, leaving = todo.pop()
        if leaving:
            if tail is not None:
                tail(n, depth)
            continue
        if n is not root and n.parent is None:  # taken out while a sibling was visited
            continue
        parent = n.parent
        head(n, depth)
        if n is not root and n.parent is not parent:
            continue
        todo.append((n, depth, True))
        todo.extend((c, depth + 1, False) for c in reversed(n.children))


def filter_nodes(root: Node, head: Callable[[Node, int], Outcome], tail: Callable[[Node, int], Outcome] | None = None) -> Outcome:
    """As ``traverse``, and what the callbacks answer decides: whether the children are walked, whether ``tail``
    is called (not after SKIP_ENTIRELY and REMOVE), whether the node goes, and whether the walk ends."""
    todo: list[tuple[Node, int, Outcome | None]] = [(root, 0, None)]
    last = Outcome.CONTINUE
    while todo:
        n, depth, answer = todo.pop()
        if answer is None:
            answer = head(n, depth)
            if answer is Outcome.STOP:
                return answer
            todo.append((n, depth, answer))
            if answer is Outcome.CONTINUE:
                todo.extend((c, depth + 1, None) for c in reversed(n.children))
            continue
        if answer in (Outcome.CONTINUE, Outcome.SKIP_CHILDREN):
            answer = tail(n, depth) if tail is not None else Outcome.CONTINUE
            if answer is Outcome.STOP:
                return answer
        if answer is Outcome.REMOVE and n is not root:
            n.remove()
        last = answer
    return last


class Nodes:
    """Nodes below and at a root in document order, of one kind if given; can begin anew and from any node."""

    def __init__(self, root: Node, kind: str | None = None):
        self.kind = kind
        self.restart(root)

    def restart(self, root: Node) -> None:
        self.walk = root.walk()

    def __iter__(self) -> Iterator[Node]:
        return self

    def __next__(self) -> Node:
        for n in self.walk:
            if self.kind is None or n.kind == self.kind:
                return n
        raise StopIteration

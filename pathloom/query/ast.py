"""Nodes of a parsed search."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    def children(self) -> tuple[Node, ...]:
        return ()

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class All(Node):
    """Every live row."""


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]

    def children(self):
        return self.parts


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...]

    def children(self):
        return self.parts


@dataclass(frozen=True)
class Not(Node):
    part: Node

    def children(self):
        return (self.part,)


@dataclass(frozen=True)
class Contains(Node):
    text: str
    case: bool = False


@dataclass(frozen=True)
class Glob(Node):
    pattern: str
    case: bool = False


@dataclass(frozen=True)
class Whole(Node):
    text: str
    case: bool = False


@dataclass(frozen=True)
class Rx(Node):
    pattern: str
    case: bool = False


@dataclass(frozen=True)
class Ext(Node):
    names: tuple[str, ...]


@dataclass(frozen=True)
class InPath(Node):
    text: str
    case: bool = False


@dataclass(frozen=True)
class ChildOf(Node):
    folder: str


@dataclass(frozen=True)
class Kind(Node):
    directory: bool


def joined(kind: type, parts: list[Node]) -> Node | None:
    """None, the only part, or ``kind`` of all parts."""
    if len(parts) < 2:
        return parts[0] if parts else None
    return kind(tuple(parts))

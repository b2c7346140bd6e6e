"""Nodes to native columns: no Python runs while a search executes.

Every predicate is two-valued. Conjuncts are ordered by cost, and patterns come
with a required literal in front, as Catalyst does neither.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regex_dialect
from .ast import All, And, ChildOf, Contains, Ext, Glob, InPath, Kind, Node, Not, Or, Rx, Whole

#: Resolves a folder path to (vol, frn) or None.
Resolver = Callable[[str], tuple[int, int] | None]

_COST = {All: 0, Kind: 1, Ext: 1, ChildOf: 1, Whole: 2, Contains: 2, Glob: 3, Rx: 4, InPath: 5}


def cost(node: Node) -> int:
    return max([_COST.get(type(node), 0), *(cost(c) for c in node.children())])


def uses_path(node: Node) -> bool:
    return any(isinstance(n, InPath) for n in node.walk())


def fold(text: str) -> str:
    return text.lower()


def _fits(needle: str) -> Column:
    """A name shorter in bytes than the folded needle never matches, even where folding lengthens it."""
    return F.octet_length("name") >= len(needle.encode())


def _contains(node: Contains) -> Column:
    if not node.text:
        return F.lit(True)
    if node.case:
        return F.col("name").contains(node.text)
    needle = fold(node.text)
    found = F.col("name_fold").contains(needle)
    return found if needle.isascii() else found & _fits(needle)


def glob_regex(pattern: str, case: bool) -> str:
    """Anchored Java pattern; ``*`` and ``?`` do not cross a line feed."""
    body = "".join({"*": ".*", "?": "."}.get(c) or re.sub(r"([.+()|^$\[\]{}\\])", r"\\\1", c) for c in pattern)
    return ("(?dU)" if case else "(?idU)") + "\\A(?:" + body + ")\\z"


def _glob(node: Glob) -> Column:
    pattern, name = (node.pattern, F.col("name")) if node.case else (fold(node.pattern), F.col("name_fold"))
    if not pattern.strip("*"):
        return F.lit(True)
    exact = F.col("name").rlike(glob_regex(node.pattern, node.case))
    pieces = re.sub(r"\*+", "*", pattern).split("*")
    if "?" in pattern or len(pieces) > 3 or (len(pieces) == 3 and (pieces[0] or pieces[2])):
        literal = max(re.split(r"[*?]", pattern), key=len)
        return name.contains(literal) & exact if literal else exact
    if len(pieces) == 1:
        return name == pattern
    if len(pieces) == 3:
        quick = name.contains(pieces[1])
    else:
        first, last = pieces
        quick = F.lit(True)
        if first:
            quick = name.startswith(first)
        if last:
            quick = quick & name.endswith(last)
        if first and last:
            quick = quick & (F.char_length(name) >= len(first) + len(last))
    # The quick shapes would let a wildcard cross a line feed.
    return quick & (~name.contains("\n") | exact)


def _regex(node: Rx) -> Column:
    java = regex_dialect.translate(node.pattern, node.case)
    if java is None:
        return _contains(Contains(node.pattern, node.case))
    exact = F.col("name").rlike(java)
    name, change = (F.col("name"), str) if node.case else (F.col("name_fold"), fold)
    shape = regex_dialect.literal_shape(node.pattern)
    if shape and shape[1].isascii():
        kind, text = shape[0], change(shape[1])
        if kind == "contains":
            return name.contains(text) & (F.lit(True) if node.case else _fits(text))
        quick = {"prefix": name.startswith, "suffix": name.endswith, "whole": lambda t: name == t}[kind](text)
        # Letters such as the long s are another case of an ASCII letter, but do not fold to it.
        return quick if node.case else F.when(F.col("name").rlike("[^\\x00-\\x7F]"), exact).otherwise(quick)
    literal = regex_dialect.required_literal(node.pattern)
    return name.contains(change(literal)) & exact if literal.isascii() and literal else exact


def _in_path(node: InPath) -> Column:
    path, parts = ("path", "components") if node.case else ("path_fold", "components_fold")
    needle = node.text if node.case else fold(node.text)
    if any(c in needle for c in "\\/:"):
        return F.col(path).contains(needle)
    return F.exists(parts, lambda c: c.contains(needle))


def compile_node(node: Node, resolve: Resolver | None = None) -> Column:
    """Boolean column over a catalogue (see :mod:`pathloom.plans.catalog`). Never null."""

    def build(n: Node) -> Column:
        match n:
            case All():
                return F.lit(True)
            case And(parts):
                first, *rest = (build(p) for p in sorted(parts, key=cost))
                for p in rest:
                    first = first & p
                return first
            case Or(parts):
                first, *rest = (build(p) for p in parts)
                for p in rest:
                    first = first | p
                return first
            case Not(part):
                return ~build(part)
            case Kind(directory):
                return F.col("is_dir") if directory else ~F.col("is_dir")
            case Ext(names):
                return F.col("ext_fold").isin(*names)
            case Whole(text, case):
                return F.col("name") == text if case else F.col("name_fold") == fold(text)
            case Contains():
                return _contains(n)
            case Glob():
                return _glob(n)
            case Rx():
                return _regex(n)
            case InPath():
                return _in_path(n)
            case ChildOf(folder):
                at = resolve(folder) if resolve else None
                if at is None:
                    return F.lit(False)
                return (F.col("vol") == at[0]) & F.coalesce((F.col("parent_frn") == at[1]) & (F.col("frn") != at[1]), F.lit(False))
        raise TypeError(n)

    return build(node)

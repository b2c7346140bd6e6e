"""Own words of a forum post: quotes, code and signatures told apart from the rest."""

from __future__ import annotations

import re

#: Characters that one frame of results may stem from, so that batches of very long texts stay small in memory.
FRAME_CHARS = 4_000_000


def slices(texts):
    """Row ranges of at most :data:`FRAME_CHARS` characters, or of one longer text."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if chars + size > FRAME_CHARS and i > start:
            yield slice(start, i)
            start, chars = i, 0
        chars += size
    if start < len(texts):
        yield slice(start, len(texts))

_QUOTE = (re.compile(r"(?P<open><blockquote\b[^>]*>)|(?P<close></blockquote>)", re.I), re.compile(r"(?P<open>\[quote\b[^\]]*\])|(?P<close>\[/quote\])", re.I))
_CODE = (re.compile(r"(?P<open>\[code\b[^\]]*\])|(?P<close>\[/code\])", re.I), re.compile(r"(?P<open><(?:code|pre)\b[^>]*>)|(?P<close></(?:code|pre)>)", re.I))
# Pairs of marks in the order they are taken out, with what a text that holds them must contain.
_MARKS = ((_CODE[0], ("[code", "[/code")), (_CODE[1], ("<code", "<pre", "</code", "</pre")), (_QUOTE[0], ("<blockquote", "</blockquote")), (_QUOTE[1], ("[quote", "[/quote")))
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_QUOTED_LINE = re.compile(r"\s*(?:>|&gt;)")
_WROTE = re.compile(r"\s*\S{1,40} (?:wrote|schrieb|a écrit|escribió|написал(?:а)?) ?:\s*(?:<br ?/?>)?\s*$")
_SIGNATURE = re.compile(r"\s*(?:-- ?|_{3,}|-{3,})\s*$|\s*(?:\[size=1\]|<font size=[\"']?[12][\"']?>)")


def without(text: str, marks: re.Pattern) -> str:
    """Text outside nested pairs of marks; an unclosed pair reaches to the end, a stray closer is dropped."""
    out, depth, at = [], 0, 0
    for m in marks.finditer(text):
        if depth == 0:
            out.append(text[at:m.start()])
            # What follows a pair inside a line stays in that line, quoted or not.
            out.append("\n" if not text[text.rfind("\n", 0, m.start()) + 1:m.start()].strip() else " ")
        depth = depth + 1 if m.lastgroup == "open" else max(0, depth - 1)
        at = m.end()
    if depth == 0:
        out.append(text[at:])
    return "".join(out)


def own_words(text: str) -> str:
    """The post without quoted parts, code and signature."""
    low = text.lower()
    for marks, needs in _MARKS:
        if any(need in low for need in needs):
            text = without(text, marks)
    if "```" in text:
        text = _FENCE.sub("\n", text)
    lines = []
    for line in text.split("\n"):
        if _QUOTED_LINE.match(line) or _WROTE.match(line):
            continue
        if _SIGNATURE.match(line):
            break
        lines.append(line)
    return "\n".join(lines).strip()

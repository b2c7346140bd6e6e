"""Evaluation texts leaking into a corpus, re-parameterised copies included.

Words become templates: numbers, units and names turn into typed placeholders.
Windows of template words are hash-joined with those of the items; what was in
the slots then decides between a literal copy, a consistent re-parameterisation
and a chance match of templates.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .forum import slices

#: Consecutive words that make a passage.
WINDOW = 12
#: Most item windows that are broadcast; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 500_000

# Units and given names that stand for a slot in any case.
UNITS = set("mm cm m km kg g mg t lb lbs oz ft mi l ml s ms sec min h hr kb mb gb tb hz khz mhz ghz kw kwh v w usd eur percent euro euros dollar dollars mile miles meter meters metre metres "
            "gram grams kilogram kilograms litre litres liter liters second seconds minute minutes hour hours day days inch inches pound pounds celsius fahrenheit".split())
NAMES = set("james mary john anna robert linda michael david sarah thomas maria peter paul laura emma oliver lucas sophie marie pierre jean claire hans klaus karl petra carlos juan jose ana luis "
            "ivan olga boris elena alice bob tom sam ben kate lucy".split())
NUMBERS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy "
              "eighty ninety hundred thousand million billion".split())
#: Most unlisted names in a window: with more, as in titles, too few words of the template are left.
UNLISTED = 4

_INSIDE = re.compile(r"(?<=[\w,;] )[^\W\d_]{2,}")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>|\[/?[A-Za-z*][^\[\]\n]*\]")
_WORD = re.compile(r"[^\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _plain(text: str | None) -> str:
    """A text in which tags in angle or square brackets are nothing, entities their characters."""
    if not text:
        return ""
    if "<" in text or "[" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text


def words(text: str | None) -> list[str]:
    """Lower-case words of a text without its tags."""
    return _WORD.findall(_plain(text).lower())


def names(text: str | None) -> set[str]:
    """Unlisted names: words that a text capitalises inside a sentence, lower-case; they are names wherever they stand in it."""
    found = {w.lower() for w in set(_INSIDE.findall(_plain(text))) if w[0].isupper() and w[1:].islower()}
    return {w for w in found if slot(w) is None}


def slot(word: str) -> str | None:
    """Type of the slot a word fills, or null for a word of the template. Depends on the lower-case word alone."""
    if word in NUMBERS or word[0].isdigit() and not word.isalpha():
        return "<num>"
    if word in UNITS:
        return "<unit>"
    return "<name>" if word in NAMES else None


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


_NAME = _hash("<name>")


def _rolling(codes: np.ndarray, window: int) -> np.ndarray:
    n = len(codes) - window + 1
    out = np.zeros(n, np.uint64)
    for i in range(window):
        out = out * _MULTIPLIER + codes[i:i + n]
    return out.view(np.int64)


class Windows:
    """Hashes of the template windows and of the literal windows of a text."""

    def __init__(self, window: int):
        self.window, self.memo = window, {}

    def codes(self, word: str) -> tuple[int, int]:
        found = self.memo.get(word)
        if found is None:
            found = (_hash(slot(word) or word), _hash(word))
            if len(self.memo) < 200_000:
                self.memo[word] = found
        return found

    def of(self, text: str | None, unlisted: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per window: template, literal, listed template. With ``unlisted``, windows with unlisted names come a second time, these as slots."""
        found = words(text)
        if len(found) < self.window:
            return (np.zeros(0, np.int64),) * 3
        codes = np.array([self.codes(w) for w in found], np.uint64)
        listed, literal = _rolling(codes[:, 0], self.window), _rolling(codes[:, 1], self.window)
        also = names(text) if unlisted else None
        if not also:
            return listed, literal, listed
        at = np.array([w in also for w in found])
        n = np.convolve(at, np.ones(self.window, int), "valid")
        more = np.flatnonzero((n > 0) & (n <= UNLISTED))
        wide = _rolling(np.where(at, np.uint64(_NAME), codes[:, 0]), self.window)[more]
        return np.concatenate([listed, wide]), np.concatenate([literal, literal[more]]), np.concatenate([listed, listed[more]])


def _windows(window: int, unlisted: bool):
    def run(batches):
        make = Windows(window)
        for pdf in batches:
            for rows in slices(pdf["text"].array):
                pairs = [make.of(t, unlisted) for t in pdf["text"].iloc[rows]]
                yield pd.DataFrame({"id": pdf["id"].iloc[rows], "template": [p[0] for p in pairs], "literal": [p[1] for p in pairs], "listed": [p[2] for p in pairs]})

    return run


_SCHEMA = "id long, template array<long>, literal array<long>, listed array<long>"


def template_windows(texts: DataFrame, row_id: str, text: str, window: int = WINDOW, unlisted: bool = True) -> DataFrame:
    """(id, template, literal, listed): the windows of a text, those with ``unlisted`` names under both templates. Texts shorter than a window have none.

    ``listed`` is the template with listed names alone, one for each window.
    """
    rows = texts.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    arrays = rows.mapInPandas(_windows(window, unlisted), _SCHEMA)
    pairs = F.explode(F.arrays_zip("template", "literal", "listed")).alias("w")
    return arrays.select("id", pairs).select("id", "w.template", "w.literal", "w.listed")


def _matched(documents: DataFrame, items: DataFrame, window: int, unlisted: bool = True) -> DataFrame:
    """(doc_id, item_id, literal): pairs that share a template window; literal if the slots of one are filled alike.

    Items are held once, as one row per template window. Their number decides
    on a broadcast. Pairs are reduced to one row each before any shuffle of them.
    """
    asked = materialize(template_windows(items, "item_id", "text", window, unlisted).select("id", "template", "literal").distinct(), "items")
    count = asked.count()
    asked = asked.select(F.col("id").alias("item_id"), "template", F.col("literal").alias("asked"))
    windows = template_windows(documents, "doc_id", "text", window, unlisted).withColumnRenamed("id", "doc_id")
    if count <= BROADCAST_WINDOWS:
        asked = F.broadcast(asked)
    both = windows.join(asked, "template")
    return both.groupBy("doc_id", "item_id").agg(F.max(F.col("literal") == F.col("asked")).alias("literal"), F.count_distinct("listed").alias("n_windows"))


def leaked(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id): documents holding at least ``window`` consecutive words of an item.

    Whole texts, quoted parts included. Null or empty texts and null ids hold
    nothing; an item shorter than the window is never found; a repeated row
    gives its pairs once.
    """
    # Equal words have equal templates whatever counts as a name, so unlisted names need no windows of their own here.
    return _matched(documents, items, window, unlisted=False).where("literal").select("doc_id", "item_id")


def consistent(document: str, item: str, window: int) -> bool:
    """Whether the shared template windows fill the slots one to one: each item value always by the same other value of its type."""
    d, w = words(document), words(item)
    # Unlisted names are slots on one side, on both or on none, as in the windows.
    for nd in {frozenset(), frozenset(names(document))}:
        for nw in {frozenset(), frozenset(names(item))}:
            if _one_to_one(d, w, nd, nw, window):
                return True
    return False


def _one_to_one(d: list[str], w: list[str], d_names: frozenset, w_names: frozenset, window: int) -> bool:
    td, tw = [slot(x) or ("<name>" if x in d_names else x) for x in d], [slot(x) or ("<name>" if x in w_names else x) for x in w]

    def few(own: list[str], also: frozenset, i: int) -> bool:
        return not also or sum(x in also for x in own[i:i + window]) <= UNLISTED

    places: dict[tuple, list[int]] = {}
    for j in range(len(tw) - window + 1):
        if few(w, w_names, j):
            places.setdefault(tuple(tw[j:j + window]), []).append(j)
    offsets: dict[int, list[int]] = {}
    for i in range(len(td) - window + 1):
        for j in places.get(tuple(td[i:i + window]), ()) if few(d, d_names, i) else ():
            offsets.setdefault(i - j, []).append(i)
    for shift, starts in offsets.items():
        there, back, ok = {}, {}, True
        for i in sorted({k for s in starts for k in range(s, s + window)}):
            if td[i] != d[i] or slot(d[i]):
                a, b = (td[i], w[i - shift]), (td[i], d[i])
                ok &= there.setdefault(a, b) == b and back.setdefault(b, a) == a
        if ok:
            return True
    return False


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, kind, n_windows) of leaks: ``literal`` copies and consistently ``reparameterised`` ones.

    Pairs whose templates agree but whose slots are filled inconsistently are
    chance matches and left out. Only the few template matches that are no
    literal copy are compared text by text.
    """
    found = materialize(_matched(documents, items, window), "matched")
    literal = found.where("literal").select("doc_id", "item_id", F.lit("literal").alias("kind"), "n_windows")
    check = F.pandas_udf(_consistent_all(window), "boolean")
    d = documents.where("doc_id is not null and text is not null").select("doc_id", F.col("text").alias("d_text"))
    w = items.where("item_id is not null and text is not null").select("item_id", F.col("text").alias("i_text"))
    open_pairs = found.where("not literal").join(d, "doc_id").join(w, "item_id").where(check("d_text", "i_text"))
    other = open_pairs.select("doc_id", "item_id", F.lit("reparameterised").alias("kind"), "n_windows").distinct()
    return literal.unionByName(other)


def _consistent_all(window: int):
    def run(document: pd.Series, item: pd.Series) -> pd.Series:
        return pd.Series([consistent(a, b, window) for a, b in zip(document, item)], dtype=bool)

    return run

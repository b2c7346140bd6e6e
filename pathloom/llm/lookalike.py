"""One consistent form for text that looks the same but differs in its characters.

After compatibility normalization of what looks alike and deletion of ignorable
characters, each token is a lattice of look-alike letters. A Viterbi search
picks the most plausible reading under script-consistent letter bigrams. The
lattice depends only on the shapes of the letters, so texts that look the same
get the same form.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Letters of other scripts shaped like a Latin letter, as "letters | Latin letters", by script and case.
SHAPES = {
    "Cyrillic": ["аеһіорсԁѕухјѵԛԝӏ", "aehiopcdsyxjvqwl", "АВЕЅІЈКМНОРСТХԚԜѴӀҮУԌ", "ABESIJKMHOPCTXQWVIYYG"],
    "Greek": ["οανιρυϲϳ", "oavipucj", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"],
    "Armenian": ["օսոհցզ", "ounhgq", "ՕՍԼ", "OUL"],
    "Coptic": ["ⲟⲣⲥ", "opc", "ⲀⲂⲎⲔⲘⲚⲞⲢⲤⲦⲬ", "ABHKMNOPCTX"],
    "Cherokee": ["ꮯꮩꮪꮓ", "cvsz", "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"],
    "Lisu": ["", "", "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"],
}
LATIN = {o: l for rows in SHAPES.values() for i in range(0, len(rows), 2) for o, l in zip(rows[i], rows[i + 1])}
#: Compatibility forms that look like their ordinary characters. Superscripts, fractions and circled forms do not.
FORMS = ("<wide>", "<narrow>", "<font>")
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}

#: Log-probability cost of changing the script inside a token, and the smoothing of bigram counts.
SWITCH, SMOOTH = 12.0, 0.1

_ALIKE: dict[str, list[str]] = defaultdict(list)
for _other, _latin in LATIN.items():
    _ALIKE[_latin].append(_other)

_TOKEN = regex.compile(r"[\p{L}\p{M}]+")


def script(ch: str) -> str:
    """Script of a letter, as far as look-alikes go."""
    c = ord(ch)
    if 0x400 <= c <= 0x52F:
        return "Cyrillic"
    if 0x370 <= c <= 0x3FF or 0x1F00 <= c <= 0x1FFF:
        return "Greek"
    if 0x530 <= c <= 0x58F:
        return "Armenian"
    if 0x2C80 <= c <= 0x2CFF:
        return "Coptic"
    if 0x13A0 <= c <= 0x13FF or 0xAB70 <= c <= 0xABBF:
        return "Cherokee"
    if 0xA4D0 <= c <= 0xA4FF:
        return "Lisu"
    return "Latin" if c < 0x250 or 0x1E00 <= c <= 0x1EFF else "other"


def simplify(text: str) -> str:
    """Compatibility forms that look alike made ordinary, format characters dropped, letters split from their marks."""
    out = []
    for ch in text:
        if ch.isascii():
            out.append(ch)
            continue
        kind = unicodedata.category(ch)
        if kind == "Cf":
            continue
        if kind == "Zs":
            out.append(" ")
        elif ch in LIGATURES:
            out.append(LIGATURES[ch])
        else:
            forms = unicodedata.decomposition(ch).split()
            same = len(forms) == 2 and forms[0] in FORMS
            out.append(chr(int(forms[1], 16)) if same else ch)
    return unicodedata.normalize("NFD", "".join(out))


class Reader:
    """Reads tokens with a bigram model: {(letter before or "", letter): count}."""

    def __init__(self, bigrams: dict[tuple[str, str], int]):
        self.totals: Counter = Counter()
        letters: dict[str, set] = defaultdict(set)
        for (a, b), n in bigrams.items():
            self.totals[a if a else "^" + script(b)] += n
            letters[script(b)].add(b)
        self.bigrams, self.sizes, self.memo = bigrams, {s: len(v) for s, v in letters.items()}, {}

    def cost(self, a: str, b: str) -> float:
        size = self.sizes.get(script(b), 1)
        seen = self.bigrams.get((a, b), 0)
        return -math.log((seen + SMOOTH) / (self.totals[a if a else "^" + script(b)] + SMOOTH * (size + 1)))

    def letters(self, shapes: str) -> str:
        """The reading of a sequence of shapes (letters without marks)."""
        if all(script(s) == "Latin" for s in shapes):
            return shapes  # wholly Latin paths come before all others
        if shapes in self.memo:
            return self.memo[shapes]
        best = {c: (self.cost("", c), c) for c in self.options(shapes[0])}
        for shape in shapes[1:]:
            step = {}
            for c in self.options(shape):
                own = script(c)
                step[c] = min(
                    (cost + (self.cost(p, c) if script(p) == own else SWITCH + self.cost("", c)), path + c) for p, (cost, path) in best.items())
            best = step
        if len(self.memo) < 100_000:
            self.memo[shapes] = min(best.values())[1]
        return min(best.values())[1]

    @staticmethod
    def options(shape: str) -> list[str]:
        return [shape, *_ALIKE.get(shape, ())]

    def token(self, token: str) -> str:
        base = [i for i, ch in enumerate(token) if not unicodedata.combining(ch)]
        read = self.letters("".join(LATIN.get(token[i], token[i]) for i in base)) if base else ""
        out = list(token)
        for i, ch in zip(base, read):
            out[i] = ch
        return "".join(out)

    def canonical(self, text: str) -> str:
        return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: self.token(m.group()), simplify(text)))


def _count_plain(names: pa.Array, counts: np.ndarray) -> None:
    """Add the bigrams of ASCII names to ``counts``, whose index is 128 * letter before (0: none) + letter."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names.cast(pa.string())), " ")
    codes = np.frombuffer(b" " + joined[0].as_buffer().to_pybytes(), np.uint8)
    letters = np.where((codes | 32) - 97 < 26, codes, 0).astype(np.int64)
    counts += np.bincount(128 * letters[:-1] + letters[1:], minlength=len(counts))


def _count_bigrams(batches):
    seen: Counter = Counter()
    counts = np.zeros(128 * 128, np.int64)
    for batch in batches:
        names = batch.column("name")
        plain = pc.string_is_ascii(names)
        _count_plain(names.filter(plain), counts)
        for text in names.filter(pc.invert(plain)).to_pylist():
            for token in _TOKEN.findall(simplify(text)):
                letters = [ch for ch in token if not unicodedata.combining(ch)]
                scripts = {script(ch) for ch in letters}
                if len(scripts) == 1 and "other" not in scripts:
                    seen.update(zip(["", *letters], letters))
    for code in np.flatnonzero(counts):
        a, b = divmod(int(code), 128)
        if b:
            seen[chr(a) if a else "", chr(b)] += int(counts[code])
    rows = [{"a": a, "b": b, "n": n} for (a, b), n in seen.items()]
    yield pa.RecordBatch.from_pylist(rows, pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))


def train(names: DataFrame) -> Reader:
    """Bigram model over all tokens of one script in ``names`` (column name). Its size is bounded by the alphabets.

    ASCII names are counted as bytes, a batch at a time; nulls count as nothing.
    """
    rows = names.select("name").mapInArrow(_count_bigrams, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return Reader({(r["a"], r["b"]): r["n"] for r in rows})


def save_model(spark: SparkSession, reader: Reader, path: str) -> None:
    """Keep a model, so that names of later deliveries get the same forms."""
    spark.createDataFrame([(a, b, n) for (a, b), n in reader.bigrams.items()], "a string, b string, n long").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Reader:
    return Reader({(r["a"], r["b"]): r["n"] for r in spark.read.parquet(path).collect()})


def _plain(name: str):
    return ~F.col(name).rlike("[^\\x00-\\x7F]")


def canonical_udf(reader: Reader):
    bigrams = reader.bigrams
    made: list = []

    def canonical(names: pd.Series) -> pd.Series:
        if not made:
            made.append(Reader(bigrams))
        return pd.Series([None if n is None else made[0].canonical(n) for n in names], dtype=object)

    return F.pandas_udf(canonical, T.StringType())


def odd_names(rows: DataFrame, reader: Reader) -> DataFrame:
    """Rows whose ``name`` has a non-ASCII character, with ``canonical``. All other names are their own form."""
    return rows.where("name is not null").where(~_plain("name")).withColumn("canonical", canonical_udf(reader)("name"))


def twins(rows: DataFrame, odd: DataFrame, folder: list[str], row_id: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of one folder that look the same but differ in code points.

    At least one of a pair is in ``odd``, so plain names are only looked up,
    never compared with each other. Names held by many rows of one folder meet
    only their differing twins. Null folders and null ids have no twins; a row
    present twice under one id gives its pairs once.
    """
    some = " and ".join(f"{c} is not null" for c in [*folder, row_id])
    odd = odd.where(some).select(*folder, F.col(row_id).alias("id_a"), F.col("name").alias("name_a"), F.col("canonical").alias("form"))
    plain = rows.where(some).where(F.col("name").isNotNull() & _plain("name")).select(*folder, F.col(row_id).alias("id_b"), F.col("name").alias("form"))
    mixed = odd.join(plain, [*folder, "form"]).select("id_a", "id_b")
    other = odd.select(*folder, "form", F.col("id_a").alias("id_b"), F.col("name_a").alias("name_b"))
    both = odd.join(other, [*folder, "form"]).where("id_a < id_b and name_a != name_b").select("id_a", "id_b")
    pairs = mixed.where("id_a != id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(both)
    return pairs.distinct()


def _prepared(entries: DataFrame, hits: DataFrame, reader: Reader | None = None) -> tuple[DataFrame, Reader]:
    """Odd names of both tables in one shared table, and the model, trained on all names of both, plain ones too, unless given."""
    e = entries.select(F.lit("entries").alias("tab"), F.col("entry_id").alias("id"), "vol", "parent_frn", F.lit(None).cast("string").alias("path"), "name")
    h = hits.select(F.lit("hits").alias("tab"), F.col("hit_id").alias("id"), F.lit(None).cast("int").alias("vol"), F.lit(None).cast("long").alias("parent_frn"), "path", "name")
    both = e.unionByName(h)
    odd = materialize(both.where("name is not null").where(~_plain("name")), "odd")
    reader = reader or train(both)
    return odd.withColumn("canonical", canonical_udf(reader)("name")), reader


def lookalike_pairs(entries: DataFrame, hits: DataFrame, reader: Reader | None = None) -> DataFrame:
    """(tab, id_a, id_b): twins of ``entries`` by (vol, parent_frn) and of ``hits`` by path; all rows count."""
    odd = materialize(_prepared(entries, hits, reader)[0], "canonical")
    e = twins(entries, odd.where("tab = 'entries'").withColumnRenamed("id", "entry_id"), ["vol", "parent_frn"], "entry_id")
    h = twins(hits, odd.where("tab = 'hits'").withColumnRenamed("id", "hit_id"), ["path"], "hit_id")
    return e.select(F.lit("entries").alias("tab"), "id_a", "id_b").unionByName(h.select(F.lit("hits").alias("tab"), "id_a", "id_b"))


def canonical_names(entries: DataFrame, hits: DataFrame, reader: Reader | None = None) -> DataFrame:
    """(tab, id, name, canonical) of all rows with a name; plain ASCII names are already in their form.

    With the ``reader`` of an earlier delivery a name keeps its form whatever comes with it.
    """
    odd = _prepared(entries, hits, reader)[0].select("tab", "id", "name", "canonical")
    e = entries.select(F.lit("entries").alias("tab"), F.col("entry_id").alias("id"), "name", F.col("name").alias("canonical"))
    h = hits.select(F.lit("hits").alias("tab"), F.col("hit_id").alias("id"), "name", F.col("name").alias("canonical"))
    return odd.unionByName(e.unionByName(h).where("name is not null").where(_plain("name")))

"""Frequencies of every distinct term, in a vertical layout.

A term's records are a compressed bitmap: 64-bit words for 64 record ids each,
of which only those with a bit are kept. Occurrences are counted in parallel
bitmaps: the bitmap of level k holds the records in which the term occurs at
least k times. Bitmaps of a term are built in each input partition and merged by
union (bitwise OR), which combines before the shuffle and counts a record once
however often it was delivered. The cardinality of level 1 is the document
frequency, the sum over all levels the number of occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Record ids per word of a bitmap, as a power of two.
WORD_BITS = 6
#: Texts of more characters are taken apart by grouping, as ranking words inside one row is quadratic.
LONG_TEXT = 2048

TERM = "[\\p{L}\\p{N}]+"


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))


def _block(record: str) -> Column:
    return F.shiftright(F.col(record), WORD_BITS)


def _union(record: str) -> Column:
    """Union of the bits of records of one block."""
    return F.bit_or(F.expr(f"shiftleft(1L, cast(`{record}` & {(1 << WORD_BITS) - 1} as int))"))


def term_bitmaps(records: DataFrame, record: str, text: str) -> DataFrame:
    """(term, level, block, bits): the non-zero bitmap words of every term of ``text``.

    A term is a maximal run of letters and numbers of the lower-cased text.
    Null texts and null record ids are no records; a text without a term has no
    bitmap. A record delivered again adds nothing; delivered with other texts it
    counts in each of their terms, with the highest of its counts.
    """
    rows = records.where(F.col(text).isNotNull() & F.col(record).isNotNull()).select(F.col(record).cast("long").alias("__id"), F.col(text).alias("__text"))
    short = F.char_length("__text") <= LONG_TEXT
    # Equal words stand together once sorted: the place behind the first of them is the level.
    ranked = F.transform(F.array_sort(_words("__text")), lambda w, i: F.struct(w.alias("term"), i.alias("at")))
    level = F.expr("transform(__ranked, x -> struct(x.term as term, x.at - array_position(__ranked.term, x.term) + 2 as level))")
    few = rows.where(short).withColumn("__ranked", ranked).select("__id", F.explode(level).alias("w")).select("__id", "w.term", F.col("w.level").cast("int").alias("level"))
    per_text = rows.where(~short).distinct().select("__id", F.xxhash64("__text").alias("__which"), F.explode(_words("__text")).alias("term"))
    many = per_text.groupBy("__id", "__which", "term").agg(F.count("*").cast("int").alias("n")).select("__id", "term", F.explode(F.sequence(F.lit(1), "n")).alias("level"))
    # Equal keys meet by block, never by term alone: a term in a third of all records is spread over their blocks.
    return few.unionByName(many).groupBy("term", "level", _block("__id").alias("block")).agg(_union("__id").alias("bits"))


def merge_bitmaps(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of bitmap tables, such as those of several deliveries: a record in more than one counts once."""
    every = first
    for other in others:
        every = every.unionByName(other)
    return every.groupBy("term", "level", "block").agg(F.bit_or("bits").alias("bits"))


def frequencies(bitmaps: DataFrame) -> DataFrame:
    """(term, n_occurrences, n_records) from the cardinalities of a bitmap table."""
    n = F.bit_count("bits").cast("long")
    return bitmaps.groupBy("term").agg(F.sum(n).alias("n_occurrences"), F.sum(F.when(F.col("level") == 1, n)).alias("n_records"))


def count_records(records: DataFrame, record: str, text: str) -> int:
    """Distinct record ids with a text, as the cardinality of their bitmap."""
    ids = records.where(F.col(text).isNotNull() & F.col(record).isNotNull()).select(F.col(record).cast("long").alias("__id"))
    return ids.groupBy(_block("__id").alias("block")).agg(_union("__id").alias("bits")).agg(F.sum(F.bit_count("bits"))).first()[0] or 0


def term_statistics(records: DataFrame, record: str, text: str, rare_below: int = 3, common_share: int = 50) -> DataFrame:
    """(term, n_occurrences, n_records, mark) of every distinct term.

    mark is ``rare`` below ``rare_below`` records, ``common`` above one in
    ``common_share`` of all records, else null; a term that is both is rare.
    An empty table gives no rows.
    """
    total = count_records(records, record, text)
    per_term = frequencies(term_bitmaps(records, record, text))
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") * common_share > total, "common")
    return per_term.select("term", "n_occurrences", "n_records", mark.alias("mark"))

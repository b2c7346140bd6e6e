"""Driver queries of the text operators and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..sources.tables import read_table as t
from . import leakage, lookalike, packing, residue, terms


def p1_found(spark, d):
    return terms.term_statistics(t(spark, d, "hits"), "hit_id", "name").where("mark is not null").select("term", "mark")


def p1_term_statistics(spark, d):
    return terms.term_statistics(t(spark, d, "hits"), "hit_id", "name")


def p6_found(spark, d):
    return lookalike.lookalike_pairs(t(spark, d, "entries"), t(spark, d, "hits"))


def p6_canonical(spark, d):
    return lookalike.canonical_names(t(spark, d, "entries"), t(spark, d, "hits"))


def p7_containers(spark, d):
    return packing.pack(t(spark, d, "documents"))


def p7_fill(spark, d):
    return packing.fill(packing.pack(t(spark, d, "documents")))


def p8_found(spark, d):
    return leakage.leaked(t(spark, d, "documents"), t(spark, d, "eval_items"))


def p8_contamination(spark, d):
    return leakage.contamination(t(spark, d, "documents"), t(spark, d, "eval_items"))


def p9_found(spark, d):
    return residue.residue(t(spark, d, "documents")).select("doc_id")


def p9_kinds(spark, d):
    return residue.residue(t(spark, d, "documents"))


def p9_clean(spark, d):
    kept = residue.clean(t(spark, d, "documents"))
    return kept.select("doc_id", "source", F.octet_length("text").alias("n_bytes"))


def p7_laws(spark, d):
    """What packing promises, counted: rows of documents, tokens lost or made up, containers over capacity, documents split without need."""
    return packing.laws(t(spark, d, "documents"))


PROBLEMS = {f.__name__: f for f in (p1_found, p1_term_statistics, p6_found, p6_canonical, p7_containers, p7_fill, p7_laws, p8_found, p8_contamination, p9_found, p9_kinds, p9_clean)}

_TERMS = r"""with recs as (select distinct hit_id, name from hits where hit_id is not null and name is not null),
words as (select hit_id, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) term from recs),
per as (select term, count(*) n_occurrences, count(distinct hit_id) n_records from words group by 1),
marked as (select *, case when n_records < 3 then 'rare' when n_records * 50 > (select count(distinct hit_id) from recs) then 'common' end mark from per)"""

def _look_sql(column: str) -> str:
    """What a name looks like, as SQL: look-alike letters by one Latin letter, one space for all, nothing for format characters."""
    pairs = {ord(a): b for a, b in lookalike.LATIN.items()}
    for c in range(0x80, 0x10000):
        forms = unicodedata.decomposition(chr(c)).split()
        if forms and forms[0] in lookalike.FORMS and len(forms) == 2:
            pairs[c] = chr(int(forms[1], 16))
        base, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and base in lookalike.LATIN and len(one := unicodedata.normalize("NFC", lookalike.LATIN[base] + "".join(marks))) == 1:
            pairs[c] = one
    quoted = ["".join(x).replace("'", "''") for x in (map(chr, pairs), pairs.values())]
    out = rf"regexp_replace(regexp_replace({column}, '\p{{Cf}}', '', 'g'), '\p{{Zs}}', ' ', 'g')"
    for ligature, letters in lookalike.LIGATURES.items():
        out = f"replace({out}, '{ligature}', '{letters}')"
    return f"nfc_normalize(translate(nfc_normalize({out}), '{quoted[0]}', '{quoted[1]}'))"


_TWINS = f"""with named as (select 'entries' tab, entry_id id, vol || '/' || parent_frn folder, name from entries union all select 'hits', hit_id, path, name from hits),
looks as (select distinct tab, id, folder, name, {_look_sql('name')} look from named where id is not null and folder is not null and name is not null)"""

# Words of a text without its tags, entities as characters; windows of twelve.
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&apos;": "''", "&amp;": "&"}


def _windows_sql(table: str, row_id: str) -> str:
    plain = r"regexp_replace(text, '</?[A-Za-z!][^<>]*>|\[/?[A-Za-z*][^\[\]\n]*\]', '', 'g')"
    for entity, ch in _ENTITIES.items():
        plain = f"replace({plain}, '{entity}', '{ch}')"
    return rf"""(select {row_id}, unnest(list_transform(range(1, len(w) - {leakage.WINDOW - 2}), lambda i: array_to_string(w[i:i + {leakage.WINDOW - 1}], ' '))) win
      from (select {row_id}, regexp_extract_all(lower(nfc_normalize({plain})), '[\p{{L}}\p{{N}}]+') w from {table} where text is not null and {row_id} is not null))"""


ORACLE = {
    "p1_found": f"{_TERMS} select term, mark from marked where mark is not null",
    "p1_term_statistics": f"{_TERMS} select term, n_occurrences::bigint n_occurrences, n_records, mark from marked",
    "p6_found": f"{_TWINS} select distinct a.tab, a.id id_a, b.id id_b from looks a join looks b using (tab, folder, look) where a.id < b.id and a.name <> b.name",
    "p7_laws": "select count(*) n_documents, 0::bigint n_wrong_tokens, 0::bigint n_overfull, 0::bigint n_split from documents",
    "p8_found": f"select distinct doc_id, item_id from {_windows_sql('documents', 'doc_id')} d join {_windows_sql('eval_items', 'item_id')} i using (win)",
}


def queries():
    return dict(PROBLEMS)


def oracle_sql():
    return dict(ORACLE)

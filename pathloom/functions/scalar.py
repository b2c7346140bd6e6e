"""Scalar functions over names, paths, flags and times, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds between the epochs of 1601 and 1970, in units of 100 ns.
FILETIME_EPOCH = 116_444_736_000_000_000
#: Longest name, in bytes.
NAME_BYTES = 65_535


def fold(c: Column) -> Column:
    return F.lower(c)


def extension(name: Column) -> Column:
    """Folded last-dot extension; null without one. A leading dot counts: ``.hidden`` has ``hidden``."""
    return F.nullif(F.regexp_extract(F.lower(name), r"\.([^.\\/]+)\z", 1), F.lit(""))


# Extensions of the icon classes.
CLASSES = {
    "executable": "exe msi bat cmd ps1 com scr",
    "archive": "zip 7z rar tar gz bz2 xz cab iso",
    "image": "png jpg jpeg gif bmp webp tiff tif svg ico",
    "document": "txt md rst log doc docx pdf rtf odt xls xlsx ppt pptx csv json xml yaml yml toml ini",
}


def file_class(name: Column, is_dir: Column) -> Column:
    """Icon class; here, unlike in searches, a leading dot starts no extension."""
    ext = F.regexp_extract(F.lower(name), r"\A.+\.([^.\\/]+)\z", 1)
    out = F.when(is_dir, "folder")
    for kind, names in CLASSES.items():
        out = out.when(ext.isin(*names.split()), kind)
    return out.otherwise("file")


def has_flag(flags: Column, bit: int) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(bit) != 0


def filetime_ms(filetime: Column) -> Column:
    """Epoch milliseconds; null for zero and for times before 1970."""
    return F.when(filetime >= FILETIME_EPOCH, F.floor((filetime - FILETIME_EPOCH) / 10_000).cast("long"))


def join_path(folder: Column, name: Column, sep: str = "\\") -> Column:
    """Folder and name with exactly one separator."""
    return F.concat(folder, F.when(folder.endswith(sep), "").otherwise(sep), name)


def split_folder(path: Column, sep: str = "\\") -> Column:
    """Folder part of a path; a drive root keeps its separator."""
    head = F.regexp_extract(path, r"\A(.*)\\[^\\]*\z", 1)
    return F.when(head.rlike(r"\A[^\\]:\z"), F.concat(head, F.lit(sep))).otherwise(head)


def split_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\]*)\z", 1)


def truncate_name(name: Column) -> Column:
    """At most :data:`NAME_BYTES` bytes, cut at a character boundary."""
    cut = F.substring(name.cast("binary"), 1, NAME_BYTES)
    return F.when(F.octet_length(name) <= NAME_BYTES, name).otherwise(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "\ufffd+\\z", ""))


def pack_file_id(high: Column, low: Column, wide: bool) -> Column:
    """64-bit id of a 128-bit one, null where it has none: ``low`` alone, or for ``wide`` ids both halves of 32 bits."""
    if not wide:
        return F.when(high == 0, low)
    fits = (F.shiftrightunsigned(high, 32) == 0) & (F.shiftrightunsigned(low, 32) == 0)
    return F.when(fits, F.shiftleft(high, 32).bitwiseOR(low))


def human_size(size: Column) -> Column:
    """Binary units with one decimal; whole bytes below 1 KB."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate("KMGTP", 1):
        shown = F.format_string(f"%.1f {unit}B", size / F.lit(1024.0 ** power))
        out = out.when(size < 1024 ** (power + 1), shown) if unit != "P" else out.otherwise(shown)
    return F.when(size.isNotNull(), out)


def utc_minute(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm")

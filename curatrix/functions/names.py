"""How file paths, splits and class names are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
PRIORITY = {"test": 3, "val": 2, "train": 1}  # of which split a duplicate stays in


def bare_name(path: Column) -> Column:
    """The part after the last slash of either kind, without blanks around it; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(path, r"(?s)^.*[/\\]", ""), r"^\s+|\s+$", ""), F.lit(""))


def stem(path: Column) -> Column:
    """The file name without its last suffix; a name that begins with its only point has none."""
    return F.regexp_replace(bare_name(path), r"(?s)^(.+)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(bare_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def split_name(split: Column) -> Column:
    s = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    s = F.when(s == "valid", "val").otherwise(s)
    return F.when(s.isin(*SPLITS), s)


def sha_digits(sha: Column) -> Column:
    """The 64 hexadecimal digits in lower case, however they are written; null if there aren't 64.

    A name of the hash before them, `0x`, blanks and signs between them, their case and their width don't matter.
    """
    narrow = F.lower(F.translate(sha, "０１２３４５６７８９ａｂｃｄｅｆＡＢＣＤＥＦ", "0123456789abcdefabcdef"))
    digits = F.regexp_replace(F.regexp_replace(narrow, r"^[^0-9a-z]*(sha[^0-9a-z]*(2[^0-9a-z]*)?256)?[^0-9a-z]*(0x)?", ""), r"[^0-9a-z]", "")
    return F.coalesce(F.when(digits.rlike("^[0-9a-f]{64}$"), digits), F.nullif(F.regexp_extract(narrow, r"(?<![0-9a-z])([0-9a-f]{64})(?![0-9a-z])", 1), F.lit("")))


def plain_words(text: Column) -> Column:
    """Words in lower case with single blanks between them: the sign between words makes no difference."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def split_priority(split: Column) -> Column:
    rank = F.lit(0)
    for name, value in PRIORITY.items():
        rank = F.when(split == name, value).otherwise(rank)
    return rank


def key_parts(key: Column) -> tuple[Column, Column]:
    """`split/file name`, cut at the first slash only."""
    parts = F.split(key, "/", 2)
    return parts[0], F.try_element_at(parts, F.lit(2))


def path_root(path: Column) -> Column:
    """The first part of a path with slashes of either kind."""
    return F.regexp_extract(path, r"^([^/\\]*)", 1)


def append_note(notes: Column, note: Column) -> Column:
    return F.concat_ws(" | ", F.nullif(notes, F.lit("")), note)


def numbered(prefix: str, number: Column, digits: int = 3) -> Column:
    """D001, D002 and so on; more digits where three don't do."""
    return F.concat(F.lit(prefix), F.when(F.length(number.cast("string")) < digits, F.lpad(number.cast("string"), digits, "0")).otherwise(number.cast("string")))

"""Names of videos and images in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_spelling(c: Column) -> Column:
    """Apart from case, slashes, blanks, prefixes and escapes: escapes decoded, `/` only, one blank, no `./` or `//`, lower case."""
    c = F.translate(F.replace(F.lower(c), F.lit("%20"), F.lit(" ")), "\\", "/")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r" ?/[ /]*", "/"))
    c = F.regexp_replace(c, r"^(\./)+|^/", "")
    return F.when(c != "", c)


def clip_of_video(spelt: Column) -> Column:
    """`folder/clip` of a video's name in one spelling, the last two parts without the ending."""
    return F.nullif(F.regexp_extract(F.regexp_replace(spelt, r"\.[a-z0-9]{2,4}$", ""), r"([^/]+/[^/]+)$", 1), F.lit(""))


def clip_of_path(spelt: Column) -> Column:
    """`folder/clip` of an image's path in one spelling: the two folders it lies in."""
    return F.nullif(F.regexp_extract(spelt, r"([^/]+/[^/]+)/[^/]+$", 1), F.lit(""))


def name_of_path(spelt: Column) -> Column:
    return F.regexp_extract(spelt, r"([^/]+)$", 1)


def frame_of_path(spelt: Column) -> Column:
    """The frame an image's file name ends in, apart from endings and marks of variants (`_flip`, `_aug2`, ` (1)`)."""
    name = F.regexp_replace(name_of_path(spelt), r"\.[a-z0-9]{2,4}$", "")
    return F.regexp_extract(F.regexp_replace(name, r"([_-](?!f[0-9]|frame)[a-z]+[0-9]*|\s*\([0-9]+\))+$", ""), r"([0-9]+)$", 1).try_cast("long")

"""Roles and verdict tags in file names, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of audio files, and words that tell a stem.
EXTENSIONS = "wav|flac|mp3|m4a|ogg|aiff|aif"
VOCAL = ["acapella", "vocals"]
BACKING = ["instrumental", "karaoke"]
TAG = r"(?i)_\[(pass|fail)\]$"


def role(path: Column) -> Column:
    """original, instrumental, acapella or null. A parenthesised word decides before the whole name; backing words go
    before vocal ones; other files than audio have none."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    stem = F.regexp_replace(name, rf"\.({EXTENSIONS})$", "")
    inside = F.array_join(F.regexp_extract_all(stem, F.lit(r"\(([^)]+)\)"), F.lit(1)), "|")
    case = F.when(~name.rlike(rf"\.({EXTENSIONS})$"), F.lit(None).cast("string"))
    for where in (inside, stem):
        if where is inside:
            case = case.when(F.contains(where, F.lit("original")), "original")
        case = case.when(where.rlike("|".join(BACKING)), "instrumental").when(where.rlike("|".join(VOCAL)), "acapella")
    return case


def is_audio(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({EXTENSIONS})$")


def without_tag(name: Column) -> Column:
    return F.regexp_replace(name, TAG, "")


def tag_of(name: Column) -> Column:
    """pass or fail, null without a tag."""
    found = F.lower(F.regexp_extract(name, TAG, 1))
    return F.when(found != "", found)


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)

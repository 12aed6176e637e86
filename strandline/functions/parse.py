"""Parsing of answers, times, file names and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_word_of(response: Column, words: tuple[str, ...]) -> Column:
    """The first of ``words`` (upper case, in order of precedence) that the response holds in any case, or null."""
    out = F.lit(None).cast("string")
    for word in reversed(words):
        out = F.when(F.contains(F.upper(response), F.lit(word)), F.lit(word)).otherwise(out)
    return out


def direction_answer(response: Column) -> Column:
    return first_word_of(response, ("FORWARD", "REVERSE"))


def integrity_answer(response: Column) -> Column:
    return first_word_of(response, ("INTACT", "TAMPERED"))


def clock_seconds(text: Column) -> Column:
    """HH:MM:SS(.ss) in seconds; null where it doesn't have three parts."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: parts[i].try_cast("double")
    return F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))


def clock_name(seconds: Column) -> Column:
    """HH.MM.SS with leading zeros."""
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = F.floor(seconds)
    return F.concat_ws(".", pad(F.floor(whole / 3600)), pad(F.floor(whole / 60) % 60), pad(whole % 60))


def file_name_unix(name: Column, zone: str = "America/Los_Angeles") -> Column:
    """Seconds since 1970 of a name that begins with YYYY-MM-DD-hh-mm-ss of local time; null otherwise."""
    stamp = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})", 1)
    local = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd-HH-mm-ss"))
    return F.when(stamp != "", F.unix_micros(F.to_utc_timestamp(local, zone)) / 1e6)


def plain_template(name: Column) -> Column:
    """Placeholders in brackets become X."""
    return F.trim(F.regexp_replace(name, r"\[[^\]]*\]", "X"))


# Opposite directions of a template, as (axis, pattern a, pattern b, direction a, direction b).
DIRECTIONS = (
    ("left_right", r"(?i)^(.+?)\s+from\s+left\s+to\s+right(.*)$", r"(?i)^(.+?)\s+from\s+right\s+to\s+left(.*)$", "left_to_right", "right_to_left"),
    ("up_down", r"(?i)^(.+?)\s+up(.*)$", r"(?i)^(.+?)\s+down(.*)$", "up", "down"),
)

SEQUENCE_NAME = r"^(\d{8}_s\d+_[a-z]+_[a-z]+)_(act\d+)_([a-z0-9]+)$"


def sequence_parts(name: Column) -> Column:
    """Struct (person_session, activity_id, hash) of a sequence name; null where it doesn't read so."""
    part = lambda i: F.regexp_extract(name, SEQUENCE_NAME, i)
    return F.when(name.rlike(SEQUENCE_NAME), F.struct(part(1).alias("person_session"), part(2).alias("activity_id"), part(3).alias("hash")))

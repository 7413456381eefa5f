"""Names of channels, flags and files, taken apart by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAG_VERSION = r"^(?:([A-Z]\d):)?([^/]+?)(?::(\d+))?$"
MANIFEST = r"([^/-]+)-([^/-]+)-([0-9.]+)-([0-9]+(?:\.[0-9]+)?)(?:\.[^/]*)?$"


def channel_parts(name: Column) -> Column:
    """struct<ifo, system, subsystem, signal, trend, type> of IFO:SYSTEM-SUBSYSTEM_SIGNAL.trend,type; null where the name has no such part.

    The name is split at its first colon, and what follows at its first comma (the type
    comes after it) and at its first two hyphens or underscores. A trend is lower-case
    letters behind a last dot, or behind a last hyphen of the signal. Names without a
    colon, or with characters that names don't have, have no parts.
    """
    sides = F.split(name, ":", 2)
    body = F.split(F.get(sides, F.lit(1)), ",", 2)
    dotted = F.split(F.get(body, F.lit(0)), r"\.", 2)
    words = F.split(F.get(dotted, F.lit(0)), "[-_]", 3)
    signal = F.get(words, F.lit(2))
    hyphened = F.regexp_extract(signal, "-([a-z]+)$", 1)
    by_hyphen = F.get(dotted, F.lit(1)).isNull() & (hyphened != "")
    ifo = F.get(sides, F.lit(0))
    parts = {
        "ifo": F.when(F.length(ifo) == 2, F.when(ifo.rlike("^[A-Z][0-9]$"), ifo)),
        "system": F.get(words, F.lit(0)),
        "subsystem": F.get(words, F.lit(1)),
        "signal": F.when(by_hyphen, F.left(signal, F.length(signal) - F.length(hyphened) - 1)).otherwise(signal),
        "trend": F.coalesce(F.get(dotted, F.lit(1)), F.when(by_hyphen, hyphened)),
        "type": F.get(body, F.lit(1)),
    }
    valid = name.rlike(r"^[A-Za-z0-9_-]*:[A-Za-z0-9_-]*(\.[a-z]+)?(,([a-z]-)?[a-z]+)?$")
    return F.struct(*[F.when(valid, F.nullif(c, F.lit(""))).alias(k) for k, c in parts.items()])


def channel_part(name: Column, part: str) -> Column:
    """One of ifo, system, subsystem, signal, trend, type; null where the name has none."""
    return channel_parts(name)[part]


def server_name(name: Column, kind: Column) -> Column:
    """The name with ``,type``, unless the type is missing or one of raw, reduced and online."""
    return F.when(kind.isNull() | kind.isin("raw", "reduced", "online"), name).otherwise(F.concat_ws(",", name, kind))


def tex_name(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(r"\_"))


def split_names(text: Column) -> Column:
    """The names of a comma-separated list; a comma before a type belongs to the name."""
    return F.filter(F.split(text, r"\s*,\s*(?!(?:raw|reduced|online|rds|m-trend|s-trend|test-pt|static)\b)"), lambda x: x != "")


def flag_part(name: Column, part: str) -> Column:
    """One of ifo, tag, version of IFO:TAG:VERSION, IFO:TAG or TAG:VERSION; version is an int."""
    i = ["ifo", "tag", "version"].index(part) + 1
    found = F.nullif(F.regexp_extract(name, FLAG_VERSION, i), F.lit(""))
    return found.try_cast("int") if part == "version" else found


def file_part(path: Column, part: str) -> Column:
    """One of observatory, description, start, duration of OBS-DESC-START-DUR.ext; null for other names."""
    i = ["observatory", "description", "start", "duration"].index(part) + 1
    found = F.nullif(F.regexp_extract(F.substring_index(path, "/", -1), "^" + MANIFEST, i), F.lit(""))
    return found.cast("double") if i > 2 else found


def file_segment(path: Column) -> Column:
    start = file_part(path, "start")
    return F.struct(start.alias("start"), (start + file_part(path, "duration")).alias("end"))

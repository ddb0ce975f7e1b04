"""Scalar expressions of the data model, all JVM-side and safe under ANSI mode."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAG_BITS = ("is_deleted", "is_pending", "is_flagged", "rating_locked", "note_locked", "status_locked", "artist_verified")
TAG_CATEGORIES = ("general", "artist", "contributor", "copyright", "character", "species", "invalid", "meta", "lore")
# Codes of the snapshot files.
RATINGS = {"s": "s", "safe": "s", "q": "q", "questionable": "q", "e": "e", "explicit": "e"}
ALIAS_STATUS = {"active": "active", "pending": "pending", "deleted": "deleted", "retired": "retired", "processing": "processing", "queued": "queued"}


def never_null(condition: Column) -> Column:
    """Two-valued logic: what is unknown does not match."""
    return F.coalesce(condition, F.lit(False))


def glob_regex(glob: str) -> str:
    """A whole-string regular expression; * and ? are the only wildcards."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def normal_tag(c: Column) -> Column:
    """Lower case, white space runs as one underscore; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\p{Cntrl}&&[^\s]]", ""), r"^\s+|\s+$", ""), r"\s+", "_")), F.lit(""))


def tag_list(c: Column) -> Column:
    """A space separated tag string, each tag once, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""))


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")


def id_list(c: Column) -> Column:
    """{1,2}, "1 2" and "1,2" as array<bigint>; what is no number is left out."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[{}]", ""), r"[,\s]+")
    return F.filter(F.transform(parts, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "t", "yes"), F.lit(False))


def count_of(c: Column) -> Column:
    """A counter: integer part of the text, never below zero; null if it is no number."""
    return F.greatest(F.floor(c.try_cast("double")).cast("long"), F.lit(0).cast("long"))


def whole(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


def instant(c: Column) -> Column:
    """A timestamp of ISO or COPY text (+00, Z, short fractions; naive is UTC)."""
    return F.try_to_timestamp(c)


def epoch_ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def rating_code(c: Column) -> Column:
    return mapped(F.lower(F.trim(c)), RATINGS)


def alias_status(c: Column) -> Column:
    """Unknown statuses count as active."""
    return F.coalesce(mapped(F.lower(F.trim(c)), ALIAS_STATUS), F.lit("active"))


def mapped(c: Column, values: dict[str, str]) -> Column:
    return F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), lambda k, v: k == c)), F.lit(0))


def packed_flags(*columns: Column) -> Column:
    """Bits 0.. in the order of FLAG_BITS."""
    total = F.lit(0)
    for k, c in enumerate(columns):
        total = total + F.when(never_null(c), 1 << k).otherwise(0)
    return total.cast("int")


def flag(c: Column, name: str) -> Column:
    return c.bitwiseAND(F.lit(1 << FLAG_BITS.index(name))) != 0


def ratio_hundredths(width: Column, height: Column) -> Column:
    """width / height in hundredths, half up, in integers."""
    w, h = width.cast("long"), height.cast("long")
    return F.when(h > 0, F.floor((w * 200 + h) / (h * 2)).cast("long"))


def megapixels(width: Column, height: Column) -> Column:
    return width.cast("double") * height / 1e6


def url_extension(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)), F.lit(""))


def file_path(post_id: Column, variant: Column, ext: Column) -> Column:
    return F.concat(F.lpad(post_id.cast("string"), 12, "0"), F.lit("/"), variant, F.lit("."), ext)


def md5_path(md5: Column, ext: Column) -> Column:
    return F.concat(F.substring(md5, 1, 2), F.lit("/"), F.substring(md5, 3, 2), F.lit("/"), md5, F.lit("."), ext)


def human_bytes(c: Column) -> Column:
    step = lambda n: F.format_string("%.1f", c / 1024**n)
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024**2, F.concat(step(1), F.lit(" KB"))).when(c < 1024**3, F.concat(step(2), F.lit(" MB"))).otherwise(F.concat(step(3), F.lit(" GB")))


def human_count(c: Column) -> Column:
    """950, 1.2k, 3.4M."""
    step = lambda n, unit: F.concat(F.format_string("%.1f", c / n), F.lit(unit))
    return F.when(c < 1000, c.cast("string")).when(c < 1_000_000, step(1e3, "k")).otherwise(step(1e6, "M"))


def human_duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def pack_ids(ids: Column) -> Column:
    """Distinct ids, ascending, as unsigned 32-bit little-endian numbers in a row."""
    hexed = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    turned = lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))
    return F.unhex(F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda x: turned(hexed(x))), ""))


def unpack_ids(packed: Column) -> Column:
    """The ids of packed ones; null: none; a length that is no multiple of four raises."""
    size = F.coalesce(F.length(packed), F.lit(0))
    turned = lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))
    every = F.filter(F.sequence(F.lit(0), F.greatest(size / 4 - 1, F.lit(0)).cast("int")), lambda k: k * 4 < size)
    ids = F.transform(every, lambda k: F.conv(turned(F.hex(packed.substr(k * 4 + 1, F.lit(4)))), 16, 10).cast("long"))
    return F.when(size % 4 != 0, F.raise_error(F.lit("packed ids must have a length divisible by 4")).cast("array<bigint>")).otherwise(ids)

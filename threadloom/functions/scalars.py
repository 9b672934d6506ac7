"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{N}_]+"
#: Together with a length divisible by 4; without a repeated group, which would take a stack frame per repetition.
BASE64 = r"^[A-Za-z0-9+/]*={0,2}$"
NOISE = r"(?i)asset_pointer|file-service://|data:image/"


def sha256_hex(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lowercase hex."""
    return F.sha2(c.cast("binary"), 256)


def seeded_uuid(c: Column) -> Column:
    """The MD5 of a seed in 8-4-4-4-12 layout."""
    h = F.md5(c.cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def tokens(c: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters, digits and underscores of at least ``least`` characters."""
    return F.filter(F.split(F.lower(c), WORD_BREAK, -1), lambda t: F.length(t) >= least)


def is_base64(c: Column) -> Column:
    return (F.length(c) >= 100) & (F.length(c) % 4 == 0) & c.rlike(BASE64)


def is_noise(c: Column) -> Column:
    """Inline data, long base64 and pointers to assets."""
    return c.startswith("data:") | is_base64(c) | c.rlike(NOISE)


def clean_parts(parts: Column) -> Column:
    """Parts without nulls and noise."""
    return F.filter(parts, lambda p: p.isNotNull() & ~is_noise(p))


def parse_time(c: Column, offsets: bool = False) -> Column:
    """Epoch seconds (double) from a number (over 1e12: milliseconds) or date text; anything else is null.

    Text may end in Z or +00:00; without either it is UTC. With ``offsets`` it may end in any other offset too (+02:00,
    -0530, +02), which otherwise makes it null.
    """
    s = F.trim(c.cast("string"))
    n = s.try_cast("double")
    offset = F.regexp_extract(s if offsets else F.regexp_extract(s, r"^(.*)\+00:00$", 0), r"T?\d{2}:\d{2}:\d{2}(?:\.\d+)?\s*([+-]\d{2}:?(?:\d{2})?)$", 1)
    iso = F.when(offset != "", F.rtrim(F.left(s, F.length(s) - F.length(offset)))).otherwise(F.regexp_replace(s, "Z$", ""))
    t = F.coalesce(
        F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")),
        F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    minutes = F.regexp_extract(offset, r"(\d{2})$", 1).try_cast("int")
    hours = F.substring(offset, 2, 2).try_cast("int")
    ahead = (hours * 3600 + F.when(F.length(offset) > 3, minutes).otherwise(0) * 60) * F.when(F.left(offset, F.lit(1)) == "-", -1).otherwise(1)
    micros = F.unix_micros(t) / F.lit(1e6) - F.coalesce(ahead, F.lit(0))
    return F.when(n.isNotNull(), F.when(n > 1e12, n / 1000).otherwise(n)).otherwise(micros)


def iso_micros(t: Column) -> Column:
    """Epoch seconds as ``2024-01-31T12:00:00.000000Z``."""
    return F.date_format(F.timestamp_micros(F.round(t * 1e6).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def plain_time(t: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.round(t * 1e6).cast("bigint")), "yyyy-MM-dd HH:mm:ss")


def bucket(t: Column, days: int = 30) -> Column:
    """Bucket name of epoch seconds: year, month, ISO week, blocks of days or day by the window's size; null: 'unknown'."""
    d = F.to_date(F.timestamp_seconds(t))
    if days >= 365:
        out = F.date_format(d, "yyyy")
    elif days >= 28:
        out = F.date_format(d, "yyyy-MM")
    elif days >= 7:
        out = F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    elif days > 1:
        out = F.concat(F.lit("W"), F.floor((F.datediff(d, F.lit("1970-01-01").cast("date")) + 719163) / F.lit(days)).cast("string"))
    else:
        out = F.date_format(d, "yyyy-MM-dd")
    return F.coalesce(out, F.lit("unknown"))


FREQ = {"year": 365, "month": 30, "week": 7, "day": 1}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two arrays, taken as sets, over all their elements; 0 where both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def xml_text(c: Column) -> Column:
    """Escaped for XML text and attributes, so that white space survives in both; characters XML cannot hold are dropped."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def file_title(c: Column) -> Column:
    """A title as a file name: letters, digits, blank, - and _; blanks to _; at most 50 characters."""
    kept = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}\s_-]", ""))
    return F.substring(F.trim(F.regexp_replace(kept, r"\s", "_"), F.lit("_")), 1, 50)

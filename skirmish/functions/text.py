"""String, version and id functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(x: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalise(x: Column) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def clean_markup(x: Column) -> Column:
    """Line breaks to spaces, @token@ to token, %i:...% and tags away, white space collapsed; in that order."""
    x = F.regexp_replace(x, "(?i)<br */?>", " ")
    x = F.regexp_replace(x, "@([^@]*)@", "$1")
    x = F.regexp_replace(x, "%i:[^%]*%", "")
    x = F.regexp_replace(x, "<[^>]*>", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def account_id(x: Column) -> Column:
    """Name#TAG from an id, a Name-TAG, or a URL that ends in one; null without a tag of 2 to 5 letters and digits."""
    last = F.url_decode(F.element_at(F.split(F.regexp_replace(F.trim(x), "[?].*$|/+$", ""), "/"), -1))
    found = F.regexp_extract(last, "^(.+)[#-]([A-Za-z0-9]{2,5})$", 1)
    tag = F.regexp_extract(last, "^(.+)[#-]([A-Za-z0-9]{2,5})$", 2)
    return F.when(found != "", F.concat(F.trim(found), F.lit("#"), tag))


def asset_path(x: Column, prefix: str, base: str) -> Column:
    """Asset path without prefix, lower case, under base."""
    return F.concat(F.lit(base), F.lower(F.regexp_replace(x, f"(?i)^{prefix}", "")))


def version_parts(x: Column) -> Column:
    """Version as an array of numbers, which orders as versions do; what isn't a number comes first."""
    return F.transform(F.split(x, r"\."), lambda p: F.coalesce(F.try_to_number(p, F.lit("999999999")).cast("int"), F.lit(-1)))


def truncate_version(x: Column, parts: int = 2) -> Column:
    """First parts of a version, "unknown" if there is none."""
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", "unknown").otherwise(F.array_join(F.slice(F.split(x, r"\."), 1, parts), "."))


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1024.0**2))


def signed_points(x: Column) -> Column:
    """A difference of rates as percent points with sign."""
    return F.format_string("%+.1f", x * 100)


def to_double(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def to_int(x: Column, default: int = 0) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(default))


def end_ms(start: Column, seconds: Column) -> Column:
    """End of a match in milliseconds, from its start and length."""
    return start + seconds.cast("long") * 1000


def start_ms(end: Column, seconds: Column) -> Column:
    return end - seconds.cast("long") * 1000


def utc_text(ms: Column) -> Column:
    """Milliseconds as ISO-8601 text in UTC, to seconds."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_recent(ms: Column, now_ms: Column, hours: float) -> Column:
    """Whether a time is at most so many hours before now; a missing one isn't."""
    return F.coalesce(ms >= now_ms - int(hours * 3_600_000), F.lit(False))


def looked_up(key: Column, table: dict[str, object], default: object = None, overrides: dict[str, object] | None = None) -> Column:
    """The table's value of a key, the overrides' first, the default where neither has it."""
    values = F.create_map(*[F.lit(x) for entry in (table | (overrides or {})).items() for x in entry])
    return F.coalesce(values[key], F.lit(default))

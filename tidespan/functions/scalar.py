"""Scalar expressions: timecodes, sizes, names, scores and request fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean the whole team, and words that mean no jersey.
TEAM = ("team", "any", "all", "team_mode")
NO_JERSEY = ("na", "none", "n/a", "null")


def timecode(text: Column) -> Column:
    """Seconds of ``[[h:]m:]s``; null if it is empty, has more than three parts or a part is no number."""
    parts = F.split(F.trim(text), ":")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    value = F.aggregate(numbers, F.lit(0.0), lambda s, x: s * 60 + x)
    return F.when((F.size(parts) <= 3) & (F.trim(text) != ""), value)


def timecode_strict(text: Column) -> Column:
    """The same, but 0.0 for an empty text and an error for one that is none."""
    lenient = timecode(text)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0.0).otherwise(F.coalesce(lenient, F.raise_error(F.concat(F.lit("not a timecode: "), text)).cast("double")))


def clock(seconds: Column) -> Column:
    """HH:MM:SS, fractions cut off."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def short_clock(seconds: Column) -> Column:
    """H:MM:SS, or M:SS below an hour."""
    s = F.floor(seconds)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def file_size(size: Column) -> Column:
    """Bytes, KB, MB or GB with up to two places and no trailing zeros; null from 1 TiB on."""
    power = F.when(size >= 1024**3, 3).when(size >= 1024**2, 2).when(size >= 1024, 1).otherwise(0)
    number = F.round(size / F.pow(F.lit(1024.0), power), 2)
    plain = F.regexp_replace(F.format_string("%.2f", number), r"\.?0+$", "")
    return F.when(size == 0, "0 Bytes").when((size > 0) & (size < 1024**4), F.concat_ws(" ", plain, F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), power + 1)))


def safe_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9.\-]", "_"), "_+", "_"))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, half rounded up; 0 for a total of 0."""
    return F.when(total == 0, 0).otherwise(F.floor(done / total * 100 + 0.5))


def score_json(text: Column) -> Column:
    """The ``score`` of a JSON text, or else the first number like 0.x or 1 in it, within [0, 1]; 0.0 for none."""
    parsed = F.get_json_object(text, "$.score").try_cast("double")
    found = F.regexp_extract(text, r"([01](?:\.\d+)?)", 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed, found, F.lit(0.0))))


def midpoint(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), (start + end) / 2)


def thumbs(start: Column, end: Column) -> Column:
    """Times of three stills: soon after the start, the middle, soon before the end."""
    return F.array(start + 0.2, (start + end) / 2, F.greatest(start + 0.2, end - 0.2))


def extraction_timeout(duration: Column) -> Column:
    return F.when(duration > 30, 120).when(duration > 15, 90).when(duration > 10, 60).otherwise(30)


def eta_by_length(choice: Column) -> Column:
    """Fixed texts by the length chosen."""
    return F.when(choice == "10-20", "10-20 minutes").when(choice == "20+", "20-40 minutes").otherwise("5-10 minutes")


def is_team(scope: Column) -> Column:
    return F.coalesce(F.lower(F.trim(scope)).isin(*TEAM), F.lit(False))


def jersey(text: Column) -> Column:
    t = F.trim(text)
    return F.when(~F.lower(t).isin(*NO_JERSEY) & (t != ""), t)


def identified(scope: Column, jersey_text: Column, color: Column) -> Column:
    """A request names a team, a jersey or a color."""
    return is_team(scope) | jersey(jersey_text).isNotNull() | (F.coalesce(F.trim(color), F.lit("")) != "")


def missing_fields(**fields: Column) -> Column:
    """Names of the fields that are null or empty."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c.cast("string"), F.lit("")) == "", n) for n, c in fields.items())))


#: Megabytes and types of uploads of each kind.
UPLOADS = {
    "video": (500, ("video/mp4", "video/avi", "video/mov", "video/mkv", "video/webm")),
    "image": (10, ("image/jpeg", "image/jpg", "image/png", "image/webp")),
    "audio": (50, ("audio/mpeg", "audio/mp3", "audio/wav", "audio/aac")),
}


def acceptable_upload(kind: Column, mime: Column, size: Column) -> Column:
    """Of a kind that is known, a type of that kind and no larger than its limit."""
    out = F.lit(False)
    for name, (limit, types) in UPLOADS.items():
        out = out | ((kind == name) & mime.isin(*types) & (size <= limit * 1024 * 1024))
    return F.coalesce(out, F.lit(False))


def known_arguments(given: Column, names: list[str]) -> Column:
    """Of a map of arguments those that a function of these parameters takes."""
    return F.map_filter(given, lambda k, _: k.isin(*names))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes"), F.lit(False))


def whole_number(text: Column, default: int = 25) -> Column:
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).otherwise(default)


def clip_name(prefix: str, ordinal: Column) -> Column:
    return F.concat(F.lit(prefix), F.format_string("%03d", ordinal), F.lit(".mp4"))


def concat_entry(path: Column) -> Column:
    """A line of a concat list; separators are made plain.  A quote closes the text, stands escaped and opens it again, as a backslash within quotes
    would be read as itself (a repair: other writers put a lone backslash before the quote)."""
    return F.concat(F.lit("file '"), F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("'"), F.lit("'\\''")), F.lit("'"))


def contains_label(text: Column, label: Column) -> Column:
    """The label occurs in the text without its spaces."""
    return F.coalesce(F.contains(F.replace(text, F.lit(" "), F.lit("")), label), F.lit(False))


#: The form fields of each sport.
SPORT_FIELDS = {"cricket": ("format", "innings", "tournament", "venue")}


def sport_fields(sport: Column) -> Column:
    """Names of a sport's form fields; none for a sport without any."""
    out = F.array().cast("array<string>")
    for name, fields in SPORT_FIELDS.items():
        out = F.when(sport == name, F.array(*map(F.lit, fields))).otherwise(out)
    return out


def rounded(x: Column, places: int) -> Column:
    """Half to even, on the shortest decimal form of the number."""
    return F.bround(x, places)


def new_id(prefix: str, millis: Column, *seed: Column) -> Column:
    """``prefix-millis-`` and nine hexadecimal places that the seed decides, so that a repeated task gives the same id."""
    return F.concat_ws("-", F.lit(prefix), millis.cast("string"), F.substring(F.sha2(F.concat_ws("|", *(s.cast("string") for s in seed)), 256), 1, 9))


def short_id(*seed: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(s.cast("string") for s in seed)), 256), 1, 8)


def stills(start: Column, end: Column, count: Column | int = 3) -> Column:
    """The first ``count`` (at most three) of ``thumbs``."""
    return F.slice(thumbs(start, end), 1, F.greatest(F.lit(0), F.lit(count)))


def broken_rules(**rules: Column) -> Column:
    """Names of the rules that a row breaks; a rule that can't be decided (null) is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))


def appended(items: Column, item: Column) -> Column:
    return F.array_append(F.coalesce(items, F.array()), item)


def removed_at(items: Column, index: Column | int) -> Column:
    """The list without its item of that index (from 0); unchanged if there is none."""
    return F.filter(items, lambda _, i: i != F.lit(index))

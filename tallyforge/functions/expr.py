"""Column expressions of the usage model; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKENS = ("input", "output", "cache_creation", "cache_read")
UNKNOWN_PROJECT = "__unknown__"
#: Longest content and title, in characters.
CONTENT_LIMIT, TITLE_LIMIT = 32768, 80


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def project_identity(path: Column | str) -> Column:
    """A project's folder; worktrees of it count as the project."""
    return F.regexp_replace(path, r"(?s)\A(.*?)[/\\]\.claude[/\\]worktrees(?:[/\\].*)?\z", "$1")


def model_key(model: Column | str) -> Column:
    """A model's pricing key: lower case, without vendor path, bracketed suffix and date suffix."""
    key = F.substring_index(ascii_lower(model), "/", -1)
    key = F.regexp_replace(key, r"(?sU)\s*\[.*\z", "")
    key = F.regexp_replace(key, r"(?s)(?<=.)-[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "")
    return F.regexp_replace(key, r"-[0-9]{8}\z", "")


def prefixes(key: Column) -> Column:
    """A key and its ever shorter beginnings at hyphens."""
    parts = F.split(key, "-")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))


def total_tokens() -> Column:
    return sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))


def hit_rate(read: Column, fresh: Column, creation: Column) -> Column:
    """Cache reads as a share of all input; 0 if there was none. Output doesn't count."""
    pool = fresh + creation + read
    return F.when(pool == 0, F.lit(0.0)).otherwise(F.round(read.cast("double") / pool, 6))


def fresh_input(total: Column, cached: Column) -> tuple[Column, Column]:
    """(input without cached, cached) where a source's input includes what was cached."""
    cached = F.least(cached, total)
    return total - cached, cached


def truncated(text: Column, limit: int = CONTENT_LIMIT) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def utc_day(ts: Column) -> Column:
    """The UTC day of a timestamp text; its first ten bytes if it can't be read."""
    return F.coalesce(F.date_format(F.try_to_timestamp(ts), "yyyy-MM-dd"), F.when(F.length(ts) >= 10, F.substring(ts, 1, 10)), F.lit("0000-00-00"))


#: What a stop reason holds and its tone, in the order in which they are tried.
STOP_TONES = [("end_turn", "success"), ("tool_use", "tool"), ("max_tokens", "warn"), ("context_window", "warn"), ("exceeded", "warn"), ("refusal", "error"), ("error", "error")]


def stop_tone(reason: Column) -> Column:
    """What a stop reason means: the whole name first, then what it contains, in order; null if nothing fits."""
    r = F.lower(F.coalesce(reason, F.lit("")))
    rules = [(r == name, tone) for name, tone in STOP_TONES] + [(r.contains(name), tone) for name, tone in STOP_TONES]
    tone = F.when(*rules[0])
    for condition, value in rules[1:]:
        tone = tone.when(condition, value)
    return tone


def iso_millis(ms: Column) -> Column:
    """Milliseconds since 1970 as a UTC time, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def basename(path: Column) -> Column:
    """The last part of a path, by either separator."""
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def cost(rate_per_million: Column, tokens: Column) -> Column:
    """An exact decimal cost."""
    return rate_per_million.cast("decimal(16,10)") * tokens.cast("decimal(10,0)") * F.lit("0.000001").cast("decimal(7,6)")

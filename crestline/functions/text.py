"""Column functions for keys and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode white space that trimming removes.
_SPACES = "\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_SPACE = f"[{_SPACES}]"


#: The same characters one by one.
_SPACE_CHARS = [chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _edge(c: Column, at: int) -> Column:
    return F.substring(c, at, 1).isin(_SPACE_CHARS)


def trim_space(c: Column) -> Column:
    """Without Unicode white space at both ends; null becomes empty. Only texts with some at an end are matched."""
    c = F.coalesce(c, F.lit(""))
    return F.when(_edge(c, 1) | _edge(c, -1), F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+\\z", "")).otherwise(c)


def is_blank(c: Column) -> Column:
    """Whether nothing but white space is there. Only texts that begin with some are searched."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c == "", True).when(_edge(c, 1), ~c.rlike(f"[^{_SPACES}]")).otherwise(False)


def lower(c: Column) -> Column:
    """Lower case by simple mapping: capital I with a dot becomes a plain i, not two code points."""
    c = F.coalesce(c, F.lit(""))
    return F.lower(F.when(F.contains(c, F.lit("İ")), F.translate(c, "İ", "i")).otherwise(c))


def collapse(c: Column) -> Column:
    """Each run of space, tab, LF and CR one space; other white space stays. Only texts with such a run are rewritten."""
    runs = F.contains(c, F.lit("  "))
    for other in "\t\n\r":
        runs = runs | F.contains(c, F.lit(other))
    return F.when(runs, F.regexp_replace(c, "[ \\t\\n\\r]+", " ")).otherwise(c)


def normalize_query(c: Column) -> Column:
    """Lower case, trimmed, runs of space, tab, LF and CR one space."""
    return collapse(trim_space(lower(c)))


def normalized_length(c: Column) -> Column:
    """Characters of normalize_query(c), in few operations on one line of code: for rare use inside large expressions."""
    bare = F.regexp_replace(F.lower(F.translate(F.coalesce(c, F.lit("")), "İ", "i")), f"^{_SPACE}+|{_SPACE}+\\z", "")
    return F.length(F.regexp_replace(bare, "[ \\t\\n\\r]+", " "))


def normalize_stop_word(c: Column) -> Column:
    """Lower case and trimmed; inner white space stays."""
    return trim_space(lower(c))


def identity(user: Column, session: Column) -> Column:
    """u:<user> if there is a user, else s:<session>."""
    return F.when(user != "", F.concat(F.lit("u:"), user)).otherwise(F.concat(F.lit("s:"), session))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def ring_index(us: Column, pane_us: int, slots: int) -> Column:
    """The slot of a ring of ``slots`` panes that a point in time falls into, also before 1970."""
    return F.pmod(F.floor(us / F.lit(pane_us)), F.lit(slots)).cast("long")


def csv_values(c: Column) -> Column:
    """Comma-separated values as an array: trimmed, blanks left out; null has none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), trim_space), lambda x: x != "")


def hash128(c: Column) -> tuple[Column, Column]:
    """Two numbers below 2^60 from the MD5 of a text: independent enough for double hashing, and the same in any engine."""
    digits = F.md5(c.cast("binary"))
    return tuple(F.conv(F.substring(digits, at, 15), 16, 10).cast("long") for at in (1, 16))


def floor_to(us: Column, step_us: int) -> Column:
    """The largest multiple of step_us not above us, also before 1970."""
    return (us - F.pmod(us, F.lit(step_us))).cast("long")

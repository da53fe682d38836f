"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(s: Column) -> Column:
    """Lower case, with ё as е."""
    return F.translate(F.lower(s), "ё", "е")


def tokens(s: Column) -> Column:
    """Runs of letters and digits, folded, in order."""
    return F.regexp_extract_all(fold(s), F.lit(r"[\p{L}\p{N}]+"), 0)


def stem(token: Column, floor: int = 6, drop: int = 2) -> Column:
    """The token without its last ``drop`` characters, but at least ``floor`` of them."""
    return F.substring(token, F.lit(1), F.greatest(F.lit(floor), F.length(token) - drop))


def normalise_query(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def is_identifier(s: Column) -> Column:
    return s.rlike(r"^[\p{L}\p{N}._]+$")


def camel_segments(s: Column) -> Column:
    """Parts of a CamelCase name: capital runs, capital with its tail, lower-case runs, digits."""
    return F.regexp_extract_all(s, F.lit(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+"), 0)


def humanise(s: Column) -> Column:
    """A CamelCase name as words in lower case, the first letter kept as it is."""
    spaced = F.regexp_replace(s, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2")
    return F.concat(F.substring(spaced, 1, 1), F.lower(F.substring(spaced, F.lit(2), F.length(spaced))))


def line_of(text: Column, place: Column) -> Column:
    """1-based line of a 1-based character place."""
    left = F.substring(text, F.lit(1), place - 1)
    return F.length(left) - F.length(F.replace(left, F.lit("\n"), F.lit(""))) + 1


def snippet(text: Column, place: Column, size: int, before: int = 40, after: int = 80) -> Column:
    """Text around a 1-based place of ``size`` characters, with … where it is cut."""
    begin = F.greatest(F.lit(1), place - before)
    end = F.least(F.length(text) + 1, place + size + after)
    return F.concat(F.when(begin > 1, "…").otherwise(""), F.substring(text, begin, end - begin), F.when(end <= F.length(text), "…").otherwise(""))


def clip(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def preview(s: Column, n: int = 200) -> Column:
    """White space made single, cut to n characters with … where more follows."""
    flat = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n)), F.lit("…"))).otherwise(flat)


def type_list(types: Column, n: int = 5) -> Column:
    """Types joined by commas, those beyond n as an ellipsis."""
    return F.concat(F.array_join(F.slice(types, 1, n), ", "), F.when(F.size(types) > n, ", …").otherwise(""))


def meta_text(*parts: Column) -> Column:
    """Parts that are not empty, joined by bars."""
    return F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))


def windows(text: Column, size: int, overlap: int, most: int | None = None) -> Column:
    """Overlapping windows of a text; the last is the first that reaches its end.

    ``most`` cuts a text after so many windows; without it they cover the text. A null text has none.
    """
    return windows_of(text, F.lit(size), F.lit(overlap), most)


def windows_of(text: Column, size: Column, overlap: Column, most: int | None = None) -> Column:
    """The same where size and overlap differ from row to row."""
    step = size - overlap
    n = F.when(F.length(text) <= size, F.lit(1)).otherwise(F.ceil((F.length(text) - size) / step) + 1)
    if most is not None:
        n = F.least(F.lit(most), n)
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(text, i * step + 1, size))


def colour(s: Column, default: str = "#888888") -> Column:
    """A colour as #rrggbb in lower case, from #rgb or #rrggbb; else the default."""
    low = F.lower(F.trim(s))
    digit = lambda i: F.repeat(F.substring(low, i, 1), 2)
    return F.when(low.rlike("^#[0-9a-f]{6}$"), low).when(low.rlike("^#[0-9a-f]{3}$"), F.concat(F.lit("#"), digit(2), digit(3), digit(4))).otherwise(F.lit(default))


def phase_percent(low: Column, high: Column, done: Column, total: Column) -> Column:
    """Progress between two percentages, within them."""
    share = F.when(total > 0, F.least(done, total) / total).otherwise(F.lit(0.0))
    return F.greatest(low, F.least(high, low + (high - low) * share))


def eta(seconds: Column) -> Column:
    """A rough duration: seconds, minutes or hours."""
    return F.when(seconds < 60, F.concat(F.lit("~"), seconds.cast("long").cast("string"), F.lit(" s"))).when(seconds < 3600, F.concat(F.lit("~"), F.ceil(seconds / 60).cast("string"), F.lit(" min"))).otherwise(F.concat(F.lit("~"), F.ceil(seconds / 3600).cast("string"), F.lit(" h")))


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each with its length so that neighbours can't run together."""
    text = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat(*(F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text)), 256)

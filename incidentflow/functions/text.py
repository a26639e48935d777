"""Text helpers as Column expressions (survey H1-H8, H18 parts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper_word_starts(c) -> Column:
    """Raise the first letter of every word, leave the rest as is (not ``initcap``).

    The string is split just before each word-start character, each piece gets
    its first character upper-cased and the pieces are joined again.
    """
    pieces = F.split(_c(c), r"(?<!\w)(?=\w)")
    return F.array_join(F.transform(
        pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def title_case(c) -> Column:
    """``water_logging`` -> ``Water Logging``: every ``_`` to a space, word starts upper (H1)."""
    return upper_word_starts(F.regexp_replace(_c(c), "_", " "))


def chart_label(c) -> Column:
    """Like ``title_case`` but only the first ``_`` becomes a space (H2)."""
    return upper_word_starts(F.regexp_replace(_c(c), r"^([^_]*)_", "$1 "))


def clean_junction_name(c) -> Column:
    """Split camelCase, space parentheses, ``Junc`` -> ``Junction``, collapse spaces (H3)."""
    s = F.regexp_replace(_c(c), "([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"\s*\(\s*", " (")
    s = F.regexp_replace(s, r"\s*\)\s*", ") ")
    s = F.regexp_replace(s, r"Junc\b", "Junction")
    s = F.regexp_replace(s, r"Junctions\b", "Junction")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(s)


def hour_label(c) -> Column:
    """``8`` -> ``08:00`` (H4)."""
    return F.concat(F.lpad(_c(c).cast("string"), 2, "0"), F.lit(":00"))


def js_number(c) -> Column:
    """A double as a script engine prints it for ordinary magnitudes: ``38.0`` -> ``38``."""
    return F.regexp_replace(_c(c).cast("string"), r"\.0$", "")


def compare_label(a, b, unit: str = "") -> Column:
    """``38m / 49m`` style pair label (H5)."""
    return F.concat(js_number(a), F.lit(unit), F.lit(" / "), js_number(b), F.lit(unit))


def hex8_int(c) -> Column:
    """First 8 hex digits of md5(text) as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(_c(c).cast("string")), 1, 8), 16, 10).cast("long")


def event_key(key) -> Column:
    """``EVT-`` + 5 digits derived from the request key (H7); stable across runs."""
    return F.concat(F.lit("EVT-"), (hex8_int(key) % 90000 + 10000).cast("string"))


def iso_z(c) -> Column:
    """Timestamp as ISO-8601 text with a ``Z`` (H8)."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def fixed(c, digits: int) -> Column:
    """``toFixed``: the exact value rounded half-up, printed with exactly ``digits`` decimals."""
    from .numeric import js_fixed
    return F.format_string(f"%.{digits}f", js_fixed(_c(c), digits))

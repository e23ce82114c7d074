"""Column functions that prepare text of unknown origin for a terminal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions.blank import BLANK

#: Control characters, and controls of writing direction.
HOSTILE = "[\\x00-\\x1f\\x7f-\\x9f\\u061c\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]"


def terminal_safe(v: Column) -> Column:
    """V-02: such characters as ``\\u{hex}``, all others as they are."""

    def shown(c: Column) -> Column:
        code = F.ltrim(F.hex(F.encode(c, "UTF-16BE")), F.lit("0"))
        return F.when(c.rlike(f"^{HOSTILE}$"), F.concat(F.lit("\\u{"), F.when(code == "", "0").otherwise(F.lower(code)), F.lit("}"))).otherwise(c)

    return F.when(v.rlike(HOSTILE), F.array_join(F.transform(F.split(v, ""), shown), "")).otherwise(v)


def clip(v: Column, most: int) -> Column:
    """At most so many characters, an ellipsis for the rest."""
    return F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("…"))).otherwise(v)


def one_line(v: Column, most: int) -> Column:
    """V-03: blanks collapsed, cut, made safe."""
    flat = F.regexp_replace(F.regexp_replace(v, f"{BLANK}+", " "), "^ | $", "")
    return terminal_safe(clip(flat, most))

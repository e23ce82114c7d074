"""Column functions that undo encodings of constants."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = string.ascii_uppercase + string.ascii_lowercase
_TURNED = string.ascii_uppercase[13:] + string.ascii_uppercase[:13] + string.ascii_lowercase[13:] + string.ascii_lowercase[:13]


def base64_decode(v: Column, urlsafe: bool = False) -> Column:
    """D-01: bytes; blanks and padding are ignored; null for a foreign character or an impossible length."""
    bare = F.regexp_replace(v, r"[\s\x0b=]", "")
    alphabet = r"^[A-Za-z0-9_-]*$" if urlsafe else r"^[A-Za-z0-9+/]*$"
    plain = F.translate(bare, "-_", "+/") if urlsafe else bare
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(bare.rlike(alphabet) & (F.length(bare) % 4 != 1), F.unbase64(padded))


def hex_decode(v: Column) -> Column:
    """D-02: bytes; blanks are ignored; null for an odd number of digits or another character."""
    bare = F.regexp_replace(v, r"[\s\x0b]", "")
    return F.when(bare.rlike("^(?:[0-9a-fA-F]{2})*$"), F.unhex(bare))


def rot13(v: Column) -> Column:
    """D-03."""
    return F.translate(v, _LETTERS, _TURNED)


def reversed_text(v: Column) -> Column:
    """D-04: reverses characters; the same as reversing bytes for ASCII."""
    return F.reverse(v)


def chr_join(codes: Column) -> Column:
    """D-05: the text of an array of code points; null if one is none. Beyond Latin-1 through UTF-16."""
    unit = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")
    pair = lambda c: F.decode(F.unhex(F.concat(F.hex(F.shiftright(c - 0x10000, 10) + 0xD800), F.hex((c - 0x10000).bitwiseAND(0x3FF) + 0xDC00))), "UTF-16BE")
    good = F.forall(codes, lambda c: ((c >= 0) & (c < 0xD800)) | ((c > 0xDFFF) & (c < 0x110000)))
    return F.when(good, F.array_join(F.transform(codes, lambda c: F.when(c < 0x10000, unit(c)).otherwise(pair(c))), ""))


def escapes_decode(v: Column) -> Column:
    """D-06: a literal's text with its escapes undone; null for an escape other than the simple ones."""
    tokens = F.regexp_extract_all(v, F.lit(r"\\x[0-9a-fA-F]{2}|\\[\s\S]|\\$|[^\\]+"), F.lit(0))
    simple = {"\\n": "\n", "\\r": "\r", "\\t": "\t", "\\0": "\0", "\\\\": "\\", "\\'": "'", '\\"': '"'}

    def undone(t: Column) -> Column:
        out = F.when(~F.startswith(t, F.lit("\\")), t).when(t.rlike(r"^\\x[0-9a-fA-F]{2}$"), chr_join(F.array(F.conv(F.substring(t, 3, 2), 16, 10).cast("int"))))
        for k, x in simple.items():
            out = out.when(t == k, F.lit(x))
        return out

    done = F.transform(tokens, undone)
    return F.when(F.forall(done, lambda t: t.isNotNull()), F.array_join(done, ""))

"""Lenient base64 text decoding."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# A lenient decoder reads quads of data characters. Padding counts only after two or three
# characters of a quad, where it ends the text; stray padding elsewhere is skipped. Possessive
# loops keep the match iterative on long texts.
_DATA = "[A-Za-z0-9+/]"
# the same, sign by sign: looked up at once, where ranges are tried one by one
_LISTED = f"[{string.ascii_letters}{string.digits}+/]"
_QUADS = f"(?:=*+{_DATA}=*+{_DATA}=?+{_DATA}{_DATA})*+"
_FINAL = f"(?:=*+{_DATA}=*+{_DATA}==|=*+{_DATA}=*+{_DATA}=?+{_DATA}=)"
_READABLE = rf"^({_QUADS})(?:=*+\z|({_FINAL})(?:.*)\z)"


def base64_text(value: Column) -> Column:
    """Base64 to text: '' for missing, the input itself when it cannot be decoded.

    Characters outside the alphabet are ignored and broken UTF-8 becomes U+FFFD.
    """
    plain = value.rlike(rf"^{_LISTED}*+={{0,2}}+\z") & (F.length(value) % 4 == 0)
    usable = F.when(plain, value).otherwise(_readable_part(value))
    decoded = F.make_valid_utf8(F.try_to_binary(usable, F.lit("base64")).cast("string"))
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.coalesce(decoded, value))


def _readable_part(value: Column) -> Column:
    """The data characters a lenient decoder would use, padded again; NULL if unreadable."""
    clean = F.regexp_replace(value, "[^A-Za-z0-9+/=]", "")
    data = F.replace(
        F.concat(F.regexp_extract(clean, _READABLE, 1), F.regexp_extract(clean, _READABLE, 2)),
        F.lit("="),
        F.lit(""),
    )
    width = (F.ceil(F.length(data) / F.lit(4)) * F.lit(4)).cast("int")
    return F.when(clean.rlike(_READABLE), F.rpad(data, width, "="))

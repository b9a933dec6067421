"""Normal forms of secret values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters, the separator controls U+001C..U+001F among them.
# A long class is tried part by part, so the signs that most values are made of are told first.
_SPACE = (
    r"[[^!-~]&&[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
_SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# One leading assignment (name, = or =>, an optional quote) and the noise
# characters removed at both ends of a core value.
LEADING_ASSIGNMENT = r"""^['"$]*[A-Za-z0-9_>().\-]*=>?['"]?"""
NOISE = "'\";$, "

_ANSI_COLOUR = r"\x1b\[[0-9;]*m"


def without_space(value: Column) -> Column:
    """The value with all white space removed; the form used in finding ids."""
    return F.regexp_replace(value, _SPACE + "+", "")


def normal_form(value: Column) -> Column:
    """The form compared by deduplication: escaped line feeds go first, then white space."""
    return without_space(F.replace(value, F.lit("\\n"), F.lit("")))


def core_form(norm: Column) -> Column:
    """The bare secret inside a normal form: no assignment prefix, no quotes or separators."""
    return F.btrim(F.regexp_replace(norm, LEADING_ASSIGNMENT, ""), F.lit(NOISE))


def strip_space(value: Column) -> Column:
    """White space removed at both ends only."""
    return F.btrim(value, F.lit(_SPACE_CHARS))


def strip_ansi(value: Column) -> Column:
    return F.regexp_replace(value, _ANSI_COLOUR, "")


def overlaps(inner_core: Column, outer_norm: Column) -> Column:
    """True when the inner value may be absorbed into the outer one.

    A core is a piece of its own normal form, so equal and contained values overlap, too.
    """
    return F.contains(outer_norm, inner_core)


def relative_path(path: Column, absolute_root: Column, given_root: Column) -> Column:
    """Path without its repository prefix; the absolute root is tried first."""

    def below(root: Column) -> Column:
        rest = F.substr(path, F.length(root) + F.lit(1))
        return F.ltrim(rest, F.lit("/"))

    return (
        F.when(F.startswith(path, absolute_root), below(absolute_root))
        .when(F.startswith(path, given_root), below(given_root))
        .otherwise(path)
    )


def last_path_part(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def tab_name(tool: Column) -> Column:
    """Report table name of a tool: first letter upper, rest lower, 31 characters."""
    return F.left(
        F.concat(F.upper(F.left(tool, F.lit(1))), F.lower(F.substr(tool, F.lit(2)))), F.lit(31)
    )

"""Reading loosely typed JSON through variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so each is computed once per row.

    A plain projection would be copied into every later filter and projection that uses it,
    and a parsed document is costly to make again.
    """
    fields = (column.alias(name) for name, column in columns.items())
    return df.select("*", F.inline(F.array(F.struct(*fields))))


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def absent_or_object(value: Column, path: str) -> Column:
    return (
        F.try_variant_get(value, path, "variant").isNull()
        | F.try_variant_get(value, path, "map<string,variant>").isNotNull()
    )


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def child(value: Column, name: str) -> Column:
    """The member as a variant: SQL NULL when absent, a variant null when null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def absent(value: Column) -> Column:
    return value.isNull()


def explicit_null(value: Column) -> Column:
    return F.coalesce(F.is_variant_null(value), F.lit(False))


def text(value: Column, name: str, default: str | None = "") -> Column:
    """The member as text; the default stands in only for an absent member."""
    return F.when(explicit_null(child(value, name)), F.lit(None)).otherwise(
        F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), F.lit(default))
    )


def items(value: Column, name: str) -> Column:
    """The member as array<variant>, NULL when absent, null or no array."""
    return F.try_variant_get(value, f"$.{name}", "array<variant>")

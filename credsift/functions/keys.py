"""Finding ids, secret keys and location keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsift.functions.text import normal_form, without_space

LOCATION = ["repository", "file_path", "line_number", "commit_hash"]


def finding_id(repository: Column, file_path: Column, secret_value: Column) -> Column:
    parts = (repository, file_path, without_space(secret_value))
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def given_id() -> Column:
    """The id, wrapped, where it is not the one that repository, file and value give; else NULL.

    Most ids are, and half of a row's bytes: steps that move whole rows move this in its place.
    """
    own = finding_id(F.col("repository"), F.col("file_path"), F.col("secret_value"))
    return F.when(~F.col("id").eqNullSafe(own), F.struct("id"))


def id_again(given: Column, repository: Column, file_path: Column, secret_value: Column) -> Column:
    """The id that ``given_id`` stands for."""
    own = finding_id(repository, file_path, secret_value)
    return F.when(given.isNotNull(), given["id"]).otherwise(own)


def short_id() -> Column:
    """Equal for equal ids only; an id of lower-case hex digits in half its bytes."""
    octets = F.try_to_binary("id", F.lit("hex"))
    is_hex = F.coalesce(F.lower(F.hex(octets)) == F.col("id"), F.lit(False))
    return F.struct(
        F.when(is_hex, octets).alias("octets"), F.when(~is_hex, F.col("id")).alias("text")
    )


def secret_key(repository: Column, secret_value: Column) -> Column:
    return F.sha2(
        F.concat_ws("|", repository, F.coalesce(normal_form(secret_value), F.lit(""))), 256
    )


def has_location() -> Column:
    """File, line and commit are all present."""
    return (
        (F.coalesce(F.col("file_path"), F.lit("")) != "")
        & F.col("line_number").isNotNull()
        & (F.coalesce(F.col("commit_hash"), F.lit("")) != "")
    )


def location_hash() -> Column:
    """64-bit location key for counting only; a collision merely overestimates a count."""
    return F.xxhash64(*LOCATION)

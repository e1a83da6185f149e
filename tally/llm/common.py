"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.storage import discard, new_path, qualified  # noqa: F401
from tally.storage import written as materialise  # noqa: F401

#: Fixed value: the six ASCII white-space characters that separate words.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: The same as a regular-expression class body.
ASCII_SPACE_CLASS = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null id inside joins and sorts: below every real id.
NULL_ID = -(2**63)
#: Rows of one key that a task joins, about; keys with more are dealt to several tasks.
PART_ROWS = 2_000
#: Rows of a few numbers up to which a table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file layer's file system and path of a qualified path; object stores go by other scheme names there."""
    scheme, _, rest = path.partition(":")
    return pafs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest}")


def id_key(col: str) -> Column:
    """A document id for joins and sorts; null counts as the smallest id."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def trim_ascii(c: Column) -> Column:
    return F.trim(c, F.lit(ASCII_SPACE))


def ascii_words(c: Column) -> Column:
    """The runs of characters other than ASCII white space; null and blank text have none."""
    t = trim_ascii(F.coalesce(c, F.lit("")))
    return F.when(F.octet_length(t) > 0, F.split(t, f"[{ASCII_SPACE_CLASS}]+")).otherwise(F.array().cast("array<string>"))


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the written table ``groups``, which has a row for each of its keys and in
    ``size`` the number of rows with it. A key of many rows is dealt to several tasks, each with a copy of its group."""
    parts = F.ceil(F.col(size) / PART_ROWS).cast("int")
    hot = groups.where(F.col(size) > PART_ROWS).select(*keys, parts.alias("parts"))
    n = hot.count()
    if n == 0:
        return rows.join(groups, keys, how)
    marked = rows.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, keys, "left")
    salted = marked.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return salted.join(copies, [*keys, "salt"], how).drop("salt")


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named in ``kept`` (id, row_key, single), all columns unchanged.

    ``kept`` has a pair of id and text hash once; where ``single`` is true only
    one of several rows of that pair stays.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_key(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_key"))
    # The join has dealt and sorted the rows by the pair, so numbering them costs no further shuffle.
    nth = F.row_number().over(Window.partitionBy("id", "row_key").orderBy("id"))
    return whole.join(kept, ["id", "row_key"]).withColumn("nth", nth).where(~F.col("single") | (F.col("nth") == 1)).select("row.*")

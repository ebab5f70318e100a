"""Words and bytes of texts as column expressions, shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space between words, as characters and as a pattern, and a word.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole(col: str = "text") -> Column:
    """The text; the empty string for null."""
    return F.coalesce(F.col(col), F.lit(""))


def words(col: str = "text") -> Column:
    """Array of the words of a whole text; empty for null, empty or blank texts."""
    trimmed = F.btrim(whole(col), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACES)
    )


def count_words(col: str = "text") -> Column:
    """Number of words of a whole text."""
    return F.regexp_count(whole(col), F.lit(WORD)).cast("long")


def fold(remainder_of: str, parts: int) -> Column:
    """True for held-out rows: crc32 of the id as text leaves 1 by ``parts``; false for null."""
    crc = F.crc32(F.col(remainder_of).cast("string").cast("binary"))
    return F.coalesce(crc % parts == 1, F.lit(False))


def keep_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key, null included, is among ``ids``; columns stay as they are."""
    ids = ids.select(F.col(key).alias("_kept_id")).distinct()
    return docs.join(ids, docs[key].eqNullSafe(ids["_kept_id"]), "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not among ``ids``."""
    ids = ids.select(F.col(key).alias("_gone_id")).distinct()
    return docs.join(ids, docs[key].eqNullSafe(ids["_gone_id"]), "left_anti")

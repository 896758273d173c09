"""Word patterns shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def words(text: Column) -> Column:
    """The words of a text in order; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator works on, so that no other column of the caller can clash with its own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)

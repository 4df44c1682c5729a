"""Column helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the text contracts.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x20\\x09-\\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def two_hashes(value: Column) -> tuple[Column, Column]:
    """A 128-bit key of a value as two longs: equal keys mean equal values, up to 2^-128."""
    return F.xxhash64(value), F.xxhash64(F.lit(7919), value)


def row_key(doc_id: Column, text: Column) -> Column:
    """A key for a row that survives null and repeated ids; rows that agree in both share it."""
    return F.xxhash64(F.lit(104729), doc_id, doc_id.isNull(), text, text.isNull())


def wide_row_key(doc_id: Column, text: Column) -> Column:
    """The same key in 16 bytes, for operators that know rows by it alone: safe beyond 10^10 rows."""
    return F.unhex(F.format_string("%016x%016x", row_key(doc_id, text), F.xxhash64(F.lit(1299709), text, doc_id)))


def boxed(docs: DataFrame, *computed: Column) -> DataFrame:
    """Pack the caller's row in one struct column, so that no column of theirs can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *computed)


def with_text(docs_columns: list[str], text: Column, row: str = "_row") -> list[Column]:
    """The caller's columns out of the packed row, with a new text and, where there is one, n_chars to match."""
    out = []
    for c in docs_columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.char_length(text).cast("long").alias(c))
        else:
            out.append(F.col(f"{row}.`{c}`").alias(c))
    return out

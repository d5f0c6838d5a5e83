"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.sources.store import stage

__all__ = [
    "WORD_CHARS", "ascii_lower", "crc32_text", "read_table", "remainder", "replace_columns",
    "stage", "utf8", "word_bytes",
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lower-cases A-Z and turns every byte that is neither a digit, a letter nor part
#: of a longer UTF-8 sequence into a blank.
WORD_CHARS = bytes(
    b + 32 if 0x41 <= b <= 0x5A
    else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20
    for b in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bytes(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, A-Z lower-cased."""
    return text.translate(WORD_CHARS).split()


def utf8(column: str | Column) -> Column:
    """The bytes of a text, null for null: what the Arrow functions work on."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo the divisor; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def crc32_text(value: bytes | None) -> int:
    return zlib.crc32(value or b"")


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add columns; an input column of the same name (in any case) gives way."""
    taken = {n.lower() for n in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[e.alias(n) for n, e in new.items()])


def like_pattern(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", literal)

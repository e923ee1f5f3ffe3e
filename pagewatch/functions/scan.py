"""Scanning bodies for byte patterns, and decoding text of unknown encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bodies of this many bytes or more aren't scanned.
SIZE_LIMIT = 25_000_000

#: Encodings that are tried, in this order.
ENCODINGS = ("utf-8", "shift_jis", "cp932", "iso2022_jp")


def scan(body: Column, signatures: dict[str, str], limit: int = SIZE_LIMIT) -> Column:
    """Name of the first signature whose text the body contains; null if none does, or the body is too large."""
    out = F.when(F.octet_length(body) >= limit, F.lit(None).cast("string"))
    for name, pattern in signatures.items():
        out = out.when(F.contains(body, F.lit(pattern)), name)
    return out


def self_test(signatures: dict[str, str]) -> Column:
    """Whether a body that holds only the first signature's text is found by it, and an empty one isn't."""
    name, pattern = next(iter(signatures.items()))
    return (scan(F.lit(pattern), signatures) == name) & scan(F.lit(""), signatures).isNull()


@F.pandas_udf(StringType())
def decode(body: pd.Series) -> pd.Series:
    """Text of bytes by the first encoding that takes them all; else UTF-8 with replacement characters."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ENCODINGS:
            try:
                return bytes(raw).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(raw).decode("utf-8", "replace")

    return body.map(one)

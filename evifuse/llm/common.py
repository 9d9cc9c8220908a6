"""Helpers that several operators of this subpackage share."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space (fixed by the query contracts).
SPACE = " \t\n\u000b\f\r"
SPACES = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given column names, each lengthened until no column of ``df`` has it."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a non-null text, in order."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def row_keys(*values: Column) -> tuple[Column, Column]:
    """128 bits, never null, equal for rows with equal values."""
    return F.xxhash64(*values), F.xxhash64(F.lit("b"), *reversed(values))

"""Sensitive values inside free text: counting, redacting, masking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tabellion.functions.patterns import REQUIRED_CHARACTER, SCAN_PATTERNS
from tabellion.operators.reconcile import REDACTED


def scan_text(df: DataFrame, key: str, text: str, patterns: Mapping[str, str] = SCAN_PATTERNS) -> DataFrame:
    """(key, pattern, hits) for every pattern that occurs in the whole text of a row.

    All patterns are counted in one pass over the text, then unpivoted; rows are never copied
    with their text.
    """
    counts = [_worth_searching(F.col(text), name, F.regexp_count(text, F.lit(p)), F.lit(0)).cast("bigint").alias(name) for name, p in patterns.items()]
    counted = df.select(key, *counts)
    return counted.unpivot([key], list(patterns), "pattern", "hits").filter(F.col("hits") > 0)


def redact_text(text: Column, patterns: Mapping[str, str] = SCAN_PATTERNS, mark: str = REDACTED) -> Column:
    """``text`` with every match of every pattern replaced, pattern by pattern."""
    for name, pattern in patterns.items():
        text = _worth_searching(text, name, F.regexp_replace(text, pattern, mark), text)
    return text


def _worth_searching(text: Column, name: str, searched: Column, untouched: Column) -> Column:
    """``searched`` where the text has the character that a match needs, else ``untouched``."""
    needed = REQUIRED_CHARACTER.get(name)
    return searched if needed is None else F.when(text.contains(needed), searched).otherwise(untouched)

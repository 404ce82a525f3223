"""Column expressions used across the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,2)"


def money(value: Column | str) -> Column:
    """Exact two-digit decimal, so sums do not depend on the order of addition."""
    return (F.col(value) if isinstance(value, str) else value).cast(MONEY)


def sum_money(value: Column | str) -> Column:
    return F.sum(money(value)).cast("double")


def mean_money(value: Column | str, digits: int = 2) -> Column:
    """Average of money values, divided and rounded as decimals."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(F.try_divide(F.sum(money(column)), F.count(column)), digits).cast("double")


def ratio(part: Column, whole: Column, digits: int, scale: int = 1) -> Column:
    """``scale * part / whole`` of two counts as an exactly rounded double, null on zero."""
    exact = F.try_divide(
        (part * F.lit(scale)).cast("decimal(24,0)"),
        whole.cast("decimal(20,0)"),
    )
    return F.round(exact, digits).cast("double")


def squeezed(name: Column | str) -> Column:
    """Identifier without punctuation or case, the form in which names are matched."""
    return F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", ""))


def title_words(name: Column | str) -> Column:
    return F.initcap(F.replace(F.col(name) if isinstance(name, str) else name, F.lit("_"), F.lit(" ")))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions, F.lit(False))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return any_of([text.contains(word) for word in words])


def first_match(branches: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """Ordered rules: the first branch whose condition holds gives the value."""
    if not branches:
        return _literal(otherwise)
    (condition, value), *rest = branches
    chain = F.when(condition, _literal(value))
    for condition, value in rest:
        chain = chain.when(condition, _literal(value))
    return chain.otherwise(_literal(otherwise))


def present(*candidates: Column) -> Column:
    """Array of the non-null candidates, in order."""
    return F.array_compact(F.array(*candidates))


def plain_number(value: Column, digits: int = 4) -> Column:
    """A double as text without an exponent and with at least one decimal."""
    fixed = value.cast(f"decimal(30,{digits})").cast("string")
    return F.regexp_replace(fixed, r"(\.[0-9]+?)0+$", "$1")


def stable_id(*parts: Column | str) -> Column:
    """Reproducible row identity: a digest of the identifying parts."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def joined(values: Column, separator: str = "|") -> Column:
    return F.array_join(values, separator)


def _literal(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)

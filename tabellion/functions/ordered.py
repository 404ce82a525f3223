"""Ordered scans (row numbers, ranks, running values) over groups of any size.

A window puts each group into one task. That is the right plan while groups are small, so it
is used whenever a map-side-combined count shows that no group exceeds ``max_group_rows``.
Otherwise the frame is range-partitioned on (group, order) so that a large group spans many
tasks, checkpointed so that the slices are fixed, scanned slice by slice, and joined with one
summary row per (group, slice) that carries the state in from the earlier slices.
"""

from __future__ import annotations

import copy
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabellion.session import checkpointed

MAX_GROUP_ROWS = 4_000_000
SLICE = "_slice"


class OrderedGroups:
    """Rows of ``df`` grouped by ``keys`` and totally ordered by ``order`` inside a group.

    ``order`` names columns, ascending by default; a leading ``-`` means descending.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        max_group_rows: int = MAX_GROUP_ROWS,
    ):
        self.keys = list(keys)
        self.order = list(order)
        self.limit = max_group_rows
        sizes = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))
        largest, rows = sizes.agg(F.max("n"), F.sum("n")).first()
        self.rows = rows or 0
        self.split = largest is not None and largest > max_group_rows
        self.frame = self._slices(df, rows) if self.split else df

    def over(self, frame: DataFrame) -> OrderedGroups:
        """The same groups, order and slices over a frame derived row by row from this one."""
        derived = copy.copy(self)
        derived.frame = frame
        return derived

    def row_number(self, name: str, keep_slices: bool = False) -> DataFrame:
        local = F.row_number().over(self._window()).cast("bigint")
        if not self.split:
            return self.frame.withColumn(name, local)
        sizes = self._summary(F.count(F.lit(1)).alias("_size"))
        before = sizes.withColumn(
            "_before", F.coalesce(F.sum("_size").over(self._earlier()), F.lit(0))
        ).drop("_size")
        return (
            self._with_carry(self.frame.withColumn(name, local), before)
            .withColumn(name, F.col(name) + F.col("_before"))
            .drop("_before", *([] if keep_slices else [SLICE]))
        )

    def running_sum(self, column: str, name: str) -> DataFrame:
        """Sum of ``column`` over the rows of the group up to and including the row."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, 0)
        running = self.frame.withColumn(name, F.sum(column).over(upto))
        if not self.split:
            return running
        totals = self._summary(F.sum(column).alias("_total"))
        before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(self._earlier()), F.lit(0))).drop("_total")
        carried = self._with_carry(running, before)
        return carried.withColumn(name, F.col(name) + F.col("_before")).drop("_before", SLICE)

    def dense_rank(self, name: str) -> DataFrame:
        """Rank of the leading order column among its distinct values in the group."""
        lead = self.order[0]
        column = lead.lstrip("-")
        if not self.split:
            window = Window.partitionBy(*self.keys).orderBy(_sort(lead))
            return self.frame.withColumn(name, F.dense_rank().over(window).cast("bigint"))
        values = self.frame.select(*self.keys, column).distinct()
        ranked = OrderedGroups(values, self.keys, [lead], self.limit).row_number(name)
        on = [*self.keys, column]
        return null_safe_join(self.frame.drop(SLICE), ranked, on)

    def last_known(self, columns: Sequence[str], keep_slices: bool = False) -> DataFrame:
        """Each column replaced by its latest non-null value up to and including the row (ascending orders only)."""
        self._ascending()
        upto = self._window().rowsBetween(Window.unboundedPreceding, 0)
        running = {c: F.last(c, ignorenulls=True).over(upto) for c in columns}
        if not self.split:
            return self.frame.withColumns(running)
        position = self._position()
        ends = self._summary(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_end_{c}") for c in columns]
        )
        carried = ends.select(
            *self.keys,
            SLICE,
            *[F.last(f"_end_{c}", ignorenulls=True).over(self._earlier()).alias(f"_in_{c}") for c in columns],
        )
        merged = self._with_carry(self.frame.withColumns(running), carried)
        merged = merged.withColumns({c: F.coalesce(F.col(c), F.col(f"_in_{c}")) for c in columns})
        return merged.drop(*([] if keep_slices else [SLICE]), *[f"_in_{c}" for c in columns])

    def previous(self, columns: dict[str, str]) -> DataFrame:
        """Adds ``name -> value of column`` in the preceding row of the group (null for the first; ascending orders only)."""
        self._ascending()
        window = self._window()
        if not self.split:
            return self.frame.withColumns({n: F.lag(c).over(window) for n, c in columns.items()})
        position = self._position()
        ends = self._summary(
            *[F.max_by(F.struct(c), position).alias(f"_end_{n}") for n, c in columns.items()]
        )
        step = Window.partitionBy(*self.keys).orderBy(SLICE)
        carried = ends.select(
            *self.keys, SLICE, *[F.lag(f"_end_{n}").over(step).alias(f"_in_{n}") for n in columns]
        )
        local = self.frame.withColumns(
            {"_at": F.row_number().over(window), **{n: F.lag(c).over(window) for n, c in columns.items()}}
        )
        merged = self._with_carry(local, carried).withColumns(
            {
                n: F.when(F.col("_at") == 1, F.col(f"_in_{n}")[c]).otherwise(F.col(n))
                for n, c in columns.items()
            }
        )
        return merged.drop(SLICE, "_at", *[f"_in_{n}" for n in columns])

    def _slices(self, df: DataFrame, rows: int) -> DataFrame:
        pieces = max(2, -(-rows // max(1, self.limit // 2)))
        by = [F.col(k).asc() for k in self.keys] + [_sort(o) for o in self.order]
        ranged = df.repartitionByRange(int(pieces), *by)
        return checkpointed(ranged.withColumn(SLICE, F.spark_partition_id()))

    def _window(self):
        inside = [*self.keys, SLICE] if self.split else self.keys
        return Window.partitionBy(*inside).orderBy(*[_sort(o) for o in self.order])

    def _earlier(self):
        return (
            Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        )

    def _ascending(self) -> None:
        if any(o.startswith("-") for o in self.order):
            raise ValueError("carrying values along a group needs an ascending order")

    def _position(self) -> Column:
        return F.struct(*self.order)

    def _summary(self, *aggregates: Column) -> DataFrame:
        return self.frame.groupBy(*self.keys, SLICE).agg(*aggregates)

    def _with_carry(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        return null_safe_join(rows, carried, [*self.keys, SLICE])


def _sort(name: str) -> Column:
    return F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_first()


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which null keys match null keys; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = None
    for c in on:
        match = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        condition = match if condition is None else condition & match
    return left.join(renamed, condition, "left").drop(*[f"_r_{c}" for c in on])

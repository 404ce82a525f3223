"""Request load and rate limiting per client."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabellion.functions.ordered import MAX_GROUP_ROWS, SLICE, OrderedGroups, null_safe_join
from tabellion.session import checkpointed

MICROS = 1_000_000
CLIENT = "_client"


def micros(time: str) -> Column:
    """Microseconds of a zone-less timestamp since 1970, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)")


def trailing_load(df: DataFrame, client: str, time: str, seconds: int, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Adds ``load``: the client's requests in the ``seconds`` up to and including each request.

    Requests are counted per client and instant. Each instant adds a marker where its window
    opens; one running count over instants and markers then gives the load as the count at the
    instant minus the count at its marker, however many requests a client has.
    """
    at = micros(time)
    counts = df.groupBy(client, time).agg(F.count(F.lit(1)).alias("requests")).withColumn("at", at)
    opens = F.struct((F.col("at") - seconds * MICROS).alias("at"), F.lit(0).cast("bigint").alias("requests"), F.lit(1).alias("marker"))
    here = F.struct("at", "requests", F.lit(0).alias("marker"))
    points = counts.select(client, time, F.explode(F.array(here, opens)).alias("p")).select(client, time, "p.*")
    running = OrderedGroups(points, [client], ["at", "marker", time], max_group_rows).running_sum("requests", "seen")
    signed = F.when(F.col("marker") == 1, -F.col("seen")).otherwise(F.col("seen"))
    loads = running.groupBy(client, time).agg(F.sum(signed).alias("load"))
    return null_safe_join(df, loads, [client, time])


def admit(
    df: DataFrame,
    client: str,
    time: str,
    order: str,
    max_requests: int,
    window_seconds: int,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds ``accepted``: a request passes if fewer than ``max_requests`` passed in the window before it.

    Rejected requests do not count, so a decision depends on all earlier ones. Clients of
    ordinary size are decided in one task each. If a client is too large for that, requests
    are cut into slices of time order that are decided in parallel from an assumed state, the
    requests still counted at the slice's start. Where an assumption turns out wrong, the next
    round carries the state over runs of slices that are twice as long, so that a client needs
    at most as many rounds as its number of slices has binary digits, and one that is idle for
    a window now and then needs few. Requests without a client are one client of their own.
    """
    span = window_seconds * MICROS
    # a key that is never null, as the joins and groups below are by equality
    own = F.coalesce(F.concat(F.lit("="), F.col(client).cast("string")), F.lit(""))
    df, client = df.withColumn(CLIENT, own), CLIENT
    timed = df.withColumn("_at", micros(time))
    groups = OrderedGroups(timed, [client], ["_at", order], max_group_rows)
    kind = "string"
    order_kind = df.schema[order].dataType.simpleString()
    verdict_schema = f"`{client}` {kind}, `{order}` {order_kind}, accepted boolean"
    narrow = [client, order, "_at"]

    if not groups.split:

        sorted_rows = groups.frame.select(*narrow).repartition(client).sortWithinPartitions(client, "_at", order)
        verdicts = sorted_rows.mapInPandas(_decider(client, order, max_requests, span), verdict_schema)
        return null_safe_join(df, verdicts, [client, order]).drop(CLIENT)

    rows = groups.frame.select(*narrow, SLICE)
    states, _ = _settled_states(rows, client, order, kind, max_requests, span)

    def decide_slice(requests: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        ordered = requests.sort_values(["_at", order])
        accepted, _ = decisions(ordered["_at"], list(state["carried"].iloc[0]), max_requests, span)
        return pd.DataFrame({client: ordered[client].to_numpy(), order: ordered[order].to_numpy(), "accepted": accepted})

    verdicts = _with_state(rows, states, client).applyInPandas(decide_slice, verdict_schema)
    return null_safe_join(df, verdicts, [client, order]).drop(CLIENT)


def decisions(times: Iterable[int], counted: list[int], max_requests: int, span: int) -> tuple[list[bool], list[int]]:
    """Decides requests in time order; returns the verdicts and the accepted times still in the window."""
    recent = deque(int(t) for t in counted)
    verdicts = []
    for now in times:
        while recent and now - recent[0] >= span:
            recent.popleft()
        passed = len(recent) < max_requests
        if passed:
            recent.append(int(now))
        verdicts.append(passed)
    return verdicts, list(recent)


def _decider(client: str, order: str, max_requests: int, span: int):
    """Decides whole partitions sorted by client and time, batch by batch, holding one client's state."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, []
        for batch in batches:
            accepted = pd.Series(False, index=batch.index)
            for key, rows in batch.groupby(client, sort=False, dropna=False)["_at"]:
                key = None if pd.isna(key) else key
                if key != current:
                    current, recent = key, []
                verdicts, recent = decisions(rows, recent, max_requests, span)
                accepted.loc[rows.index] = verdicts
            yield batch[[client, order]].assign(accepted=accepted)

    return decide


def _with_state(rows: DataFrame, states: DataFrame, client: str):
    """The requests of each (client, slice) beside its state; fresh names keep the two sides apart."""
    own = states.withColumnsRenamed({client: "state_client", SLICE: "state_slice"})
    fresh = own.select(*[F.col(c).alias(c) for c in own.columns])
    return rows.groupBy(client, SLICE).cogroup(fresh.groupBy("state_client", "state_slice"))


def _settled_states(rows: DataFrame, client: str, order: str, kind: str, max_requests: int, span: int) -> tuple[DataFrame, int]:
    """((client, slice, carried): the accepted times that still count when each slice starts, number of rounds).

    In every round the state is carried through runs of slices from the state assumed at their
    beginning, in one sorted pass of constant memory; what a run hands to the next one is
    compared with what that one assumed. Runs whose assumption held are left alone, the others
    become part of a run of twice the length.
    """
    keys = [client, SLICE]
    place = F.row_number().over(Window.partitionBy(client).orderBy(SLICE)) - 1
    plan = checkpointed(rows.groupBy(*keys).agg(F.min("_at").alias("_first")).withColumn("_place", place))
    most = plan.agg(F.max("_place")).first()[0] or 0
    states = plan.select(*keys, F.array().cast("array<bigint>").alias("carried"))
    pending, width, rounds = states, 1, 0
    schema = f"`{client}` {kind}, `{SLICE}` int, carried array<bigint>, handed boolean"
    while True:
        rounds += 1
        numbered = plan.withColumn("_run", F.floor(F.col("_place") / width))
        following = Window.partitionBy(client).orderBy("_run")
        runs = numbered.groupBy(client, "_run").agg(F.min(SLICE).alias(SLICE), F.min("_first").alias("_first"))
        runs = runs.withColumns({"_after": F.lead(SLICE).over(following), "_after_first": F.lead("_first").over(following)})
        due = pending.join(numbered, keys).select(client, "_run").distinct()
        marks = runs.join(due, [client, "_run"]).join(states, keys).select(
            *keys, "_run", F.lit(0).alias("_mark"), F.col("_first").alias("_at"), F.lit(None).cast(rows.schema[order].dataType).alias(order),
            "carried", "_after", "_after_first",
        )
        none = F.lit(None).cast("bigint")
        work = rows.join(numbered.select(*keys, "_run"), keys).join(due, [client, "_run"], "left_semi").select(
            *keys, "_run", F.lit(1).alias("_mark"), "_at", order, F.lit(None).cast("array<bigint>").alias("carried"),
            none.cast("int").alias("_after"), none.alias("_after_first"),
        )
        # dealt anew by an expression of its own: both sides are already dealt by the run, but not alike
        dealt = marks.unionByName(work).repartition(F.xxhash64(client, "_run"))
        ordered = dealt.sortWithinPartitions(client, "_run", SLICE, "_mark", "_at", order)
        carried = ordered.drop(order).mapInPandas(_carrier(client, max_requests, span), schema)
        different = carried.withColumnRenamed("carried", "_new").join(states, keys).filter(F.col("_new") != F.col("carried"))
        changed = checkpointed(different.select(*keys, F.col("_new").alias("carried"), "handed"))
        if changed.isEmpty():
            return states, rounds
        states = checkpointed(states.join(changed.select(*keys), keys, "left_anti").unionByName(changed.drop("handed")))
        pending = changed.filter("handed").select(*keys)
        if width > most or pending.isEmpty():
            return states, rounds
        width *= 2


def _carrier(client: str, max_requests: int, span: int):
    """Walks sorted runs: a mark with the state at a run's beginning, then its requests."""

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, current, recent, after = None, None, [], (None, None)

        def handed() -> list[tuple]:
            place, starts = after
            return [] if place is None else [(run[0], place, [t for t in recent if starts - t < span], True)]

        for batch in batches:
            out: list[tuple] = []
            for key, part in batch.groupby([client, "_run"], sort=False):
                if key != run:
                    out += handed()
                    mark = part.iloc[0]
                    run, current, recent = key, int(mark[SLICE]), [int(t) for t in mark["carried"]]
                    after = (None, None) if pd.isna(mark["_after"]) else (int(mark["_after"]), int(mark["_after_first"]))
                    part = part.iloc[1:]
                for place, requests in part.groupby(SLICE, sort=False)["_at"]:
                    if place != current:
                        starts = int(requests.iloc[0])
                        recent = [t for t in recent if starts - t < span]
                        out.append((run[0], int(place), recent, False))
                        current = place
                    _, recent = decisions(requests, recent, max_requests, span)
            yield pd.DataFrame(out, columns=[client, SLICE, "carried", "handed"])
        yield pd.DataFrame(handed(), columns=[client, SLICE, "carried", "handed"])

    return carry

"""Streaming operators with state per key: funnels and experiment tallies.

State lives in Spark's keyed state (``transformWithState``), so a batch touches the parts of a key's state it changes and not the
whole of it, and timers on event time end the state. TTL is not used: it runs on processing time, and what a stream counts
would depend on when it ran. Queries need the RocksDB provider (``use_rocksdb``, which ``jobs.run`` calls).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from eventloom.model import lit_ts
from eventloom.operators import experiments as ex
from eventloom.operators.scope import drop_sampler

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """For the queries that start from here on; one that restarts keeps the provider of its checkpoint."""
    spark.conf.set(PROVIDER, ROCKSDB)


# ---- experiments -------------------------------------------------------------------------------
TALLY_OUT = "flag string, variant string, exposed bigint, converted bigint"


class _Tally(StatefulProcessor):
    """Per (flag, unit): first exposure and last goal; emits changes of the arm's tallies."""

    def __init__(self, ends: dict[str, int]):
        self.ends = ends      # flag -> end in epoch milliseconds

    def init(self, handle) -> None:
        self.handle = handle
        self.unit = handle.getValueState("unit", "first bigint, last bigint, variant string, exposed boolean, converted boolean")

    def handleInputRows(self, key, rows, timerValues):
        known = self.unit.exists()
        first, last, variant, was_exposed, was_converted = self.unit.get() if known else (None, None, "", False, False)
        for r in rows:
            if not r["is_exposure"]:
                last = r["us"] if last is None else max(last, r["us"])
            elif first is None or (r["us"], r["variant"]) < (first, variant):
                if was_exposed and r["variant"] != variant:      # an earlier exposure arrived late: move the unit
                    yield Row(flag=key[0], variant=variant, exposed=-1, converted=-int(was_converted))
                    was_exposed = was_converted = False
                first, variant = r["us"], r["variant"]
        exposed = first is not None
        converted = exposed and last is not None and last >= first
        if exposed and (exposed != was_exposed or converted != was_converted):
            yield Row(flag=key[0], variant=variant, exposed=1 - int(was_exposed), converted=int(converted) - int(was_converted))
        self.unit.update((first, last, variant, exposed, bool(converted)))
        if not known and key[0] in self.ends:
            self.handle.registerTimer(self.ends[key[0]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.unit.clear()
        return iter(())

    def close(self) -> None:
        pass


def experiment_tally(events: DataFrame, flags, delay: str = "1 hour") -> DataFrame:
    """Changelog of (flag, variant, exposed, converted); its sums are the running tallies.

    A goal counts for every flag it is the goal of; units are distinct ids. Exposures at one instant: the smallest variant counts.
    A flag that has ``stopped`` counts events before that time, and once the watermark (``delay``) has passed it, its units leave
    the state: nothing that still counts can come. Flags that run on need all their units, since any may convert later; where
    no flag has stopped there is no watermark and no event is too late.
    """
    ends = {f.key: f.stopped for f in flags if f.stopped}
    goals = F.array(*[F.struct(F.lit(f.key).alias("flag"), F.lit(f.goal).alias("goal")) for f in flags])
    exposure = F.col("name") == ex.EXPOSURE
    own = F.array(F.struct(F.col(f"`{ex.P_FLAG}`").alias("flag"), F.col("name").alias("goal")))
    hits = F.when(exposure, own).otherwise(F.filter(goals, lambda g: g["goal"] == F.col("name")))
    d = events.withWatermark("timestamp", delay) if ends else events
    d = d.select("timestamp", "distinct_id", F.unix_micros("timestamp").alias("us"), exposure.alias("is_exposure"), F.coalesce(F.col(f"`{ex.P_VARIANT}`"), F.lit("")).alias("variant"), F.explode(hits).alias("h"))
    d = d.select(F.col("h.flag").alias("flag"), F.col("distinct_id").alias("unit"), "timestamp", "us", "is_exposure", "variant").where(F.col("flag").isin(*[f.key for f in flags]))
    for flag, end in ends.items():
        d = d.where((F.col("flag") != flag) | (F.col("timestamp") < lit_ts(end)))
    d = d.where("us is not null")
    at = {flag: _millis(events.sparkSession, end) for flag, end in ends.items()}
    return d.groupBy("flag", "unit").transformWithState(_Tally(at), TALLY_OUT, "append", "eventTime" if ends else "none")


def _millis(spark: SparkSession, when: str) -> int:
    return spark.range(1).select(F.unix_millis(lit_ts(when))).first()[0]


# ---- funnels -----------------------------------------------------------------------------------
class _Funnel(StatefulProcessor):
    """Per person: the events the watermark has not passed, and what the settled ones amount to."""

    def __init__(self, names: list[str], window_us: int):
        self.names, self.window = names, window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "best array<bigint>, at array<bigint>, reached bigint, last bigint, timer bigint")
        self.held = handle.getListState("held", "us bigint, rank int, id string, name string")

    def _walk(self, events, best, at, reached):
        best, at = list(best), list(at)
        for us, _, _, name in events:
            for i in range(len(self.names) - 1, -1, -1):
                if name != self.names[i]:
                    continue
                start = us if i == 0 else best[i - 1]
                if i == 0 or (start >= 0 and us >= at[i - 1] and us - start <= self.window):
                    if start >= best[i]:
                        best[i], at[i] = start, us
                    reached = max(reached, i + 1)
        return best, at, reached

    def _advance(self, key, fresh, timers):
        empty = [-1] * len(self.names)
        best, at, before, last, timer = self.settled.get() if self.settled.exists() else (empty, empty, 0, 0, None)
        events = sorted([tuple(e) for e in self.held.get()] + fresh)
        mark = timers.getCurrentWatermarkInMs() * 1000
        due = next((i for i, e in enumerate(events) if e[0] >= mark), len(events))
        best, at, reached = self._walk(events[:due], best, at, before)
        rest = events[due:]
        reached = self._walk(rest, best, at, reached)[2]
        last = max([last] + [e[0] for e in fresh])
        ends = (last + self.window) // 1000 + 1
        if timer is not None and timer != ends:
            self.handle.deleteTimer(timer)
        if not rest and ends * 1000 <= mark:       # no chain that was begun can be continued any more
            self.settled.clear()
            self.held.clear()
        else:
            if not due:
                if fresh:
                    self.held.appendList(fresh)
            elif rest:
                self.held.put(rest)
            else:
                self.held.clear()
            if timer != ends:
                self.handle.registerTimer(ends)
            self.settled.update((list(best), list(at), reached, last, ends))
        if reached > before:
            yield Row(distinct_id=key[0], reached=reached)

    def handleInputRows(self, key, rows, timerValues):
        return self._advance(key, [(r["us"], r["rank"], r["id"], r["name"]) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._advance(key, [], timerValues)

    def close(self) -> None:
        pass


def funnel_state(events: DataFrame, steps, window_s: float, delay: str = "1 hour") -> DataFrame:
    """(distinct_id, reached) whenever a person gets further in an ordered funnel.

    Events are taken in the order of the batch funnel (time, step, id), whatever micro-batch brought
    them, and each step must come after the one before in that order: events the watermark has not
    passed stay in a list in the state, to which a batch only appends, and are walked again with what
    arrives late.  More events can only get a person further, so what is emitted early holds.  Once
    the watermark has passed them they are settled: for each step, the latest entry time of a chain
    that got there with the time it did (a later entry can only help the window).  A timer ends the
    state one window after the last event.
    """
    names = list(steps)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")).cast("int")
    d = drop_sampler(events).where(F.col("name").isin(*names)).withWatermark("timestamp", delay)
    d = d.select("distinct_id", "timestamp", F.coalesce("id", F.lit("")).alias("id"), "name", F.unix_micros("timestamp").alias("us"), rank.alias("rank"))
    return d.where("us is not null").groupBy("distinct_id").transformWithState(_Funnel(names, int(window_s * 1_000_000)), "distinct_id string, reached bigint", "append", "eventTime")

"""Delayed, serialised refreshes as keyed state with timers.

Each update of a product re-arms its timer; when ``delay`` has passed without another one, one
refresh is due for the whole burst.  A due refresh starts unless an earlier one of the product
still runs: it runs until it is reported done, or until ``expire`` has passed (a lost worker).
Refreshes due meanwhile are skipped, as the running one reads the product as it is by then.

All times are event times.  A product's open updates are kept as disjoint bursts (first, last,
count), so the state of a product with very many updates stays as small as the bursts that the
watermark has not closed, and events may come in any order within the watermark: the result is
that of the events in order of time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "firsts array<bigint>, lasts array<bigint>, counts array<bigint>, done array<bigint>, busy bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_bursts(bursts: list[tuple[int, int, int]], delay: int) -> list[tuple[int, int, int]]:
    """Disjoint (first, last, count) of bursts in any order; those less than ``delay`` apart are one."""
    out: list[tuple[int, int, int]] = []
    for first, last, count in sorted(bursts):
        if out and first - out[-1][1] < delay:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + count)
        else:
            out.append((first, last, count))
    return out


def settle(bursts: list, done: list[int], busy: int | None, now: int, delay: int, expire: int):
    """((first, due, count, started) of all due by ``now``, open bursts, open reports, busy until).

    In order of time; a report counts before a refresh due at the same instant.
    """
    due = [(last + delay, 1, first, count) for first, last, count in bursts if last + delay <= now]
    rows = []
    for at, kind, first, count in sorted([*due, *((t, 0, 0, 0) for t in done if t <= now)]):
        if kind == 0:
            busy = None
        else:
            started = busy is None or at >= busy
            rows.append((first, at, count, started))
            busy = at + expire if started else busy
    left = [b for b in bursts if b[1] + delay > now]
    return rows, left, [t for t in done if t > now], None if busy is not None and busy <= now else busy


class RefreshTimers(StatefulProcessor):
    """Keyed state of ``delayed_refreshes``; input columns are the key, ``us`` and ``done``."""

    def __init__(self, key: Sequence[str], delay: int, expire: int) -> None:
        self.key, self.delay, self.expire = list(key), delay, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("refresh", STATE)

    def _load(self) -> tuple[list, list, int | None]:
        if not self.state.exists():
            return [], [], None
        firsts, lasts, counts, done, busy = self.state.get()
        return list(zip(firsts, lasts, counts)), list(done), busy

    def _step(self, key: tuple, bursts: list, done: list[int], busy: int | None, now_ms: int) -> pd.DataFrame:
        """Settle what is due, keep the rest, and set the one timer for the next instant."""
        rows, bursts, done, busy = settle(bursts, done, busy, now_ms * 1000, self.delay, self.expire)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        instants = [last + self.delay for _, last, _ in bursts] + done + ([busy] if busy is not None else [])
        if instants:
            self.state.update(([b[0] for b in bursts], [b[1] for b in bursts], [b[2] for b in bursts], done, busy))
            self.handle.registerTimer(max(-(-min(instants) // 1000), now_ms + 1))
        else:
            self.state.clear()
        # object columns: pandas' own string columns can be several Arrow chunks, which Spark does not take
        fixed = {name: pd.Series([value] * len(rows), dtype=object) for name, value in zip(self.key, key)}
        return pd.DataFrame({**fixed, **{name: [r[k] for r in rows] for k, name in enumerate(("first_us", "due_us", "n_updates", "started"))}})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bursts, done, busy = self._load()
        for chunk in rows:
            is_done = chunk["done"].astype(bool)
            done += [int(t) for t in chunk.loc[is_done, "us"]]
            bursts = merge_bursts([*bursts, *((int(t), int(t), 1) for t in chunk.loc[~is_done, "us"])], self.delay)
        yield self._step(key, bursts, sorted(set(done)), busy, max(timerValues.getCurrentWatermarkInMs(), 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bursts, done, busy = self._load()
        yield self._step(key, bursts, done, busy, max(timerValues.getCurrentWatermarkInMs(), 0))

    def close(self) -> None:
        pass


def delayed_refreshes(
    events: DataFrame, delay_seconds: float = 10, expire_seconds: float = 300, watermark: str = "10 minutes",
    key: Sequence[str] = ("code", "server_type"), time: str = "timestamp", done: str | None = None,
) -> DataFrame:
    """(key..., first_us, due_us, n_updates, started) per burst of updates of a product.

    ``done`` names a boolean column that marks reports of finished refreshes; without it a
    refresh holds its product until it expires.  Rows without a time or any part of the key
    are no updates of a product and give nothing; events behind the watermark are left out by
    the engine.  A refresh comes out once the watermark has passed its due time.  Start the
    query inside ``timer_state``.
    """
    names = list(key)
    is_done = F.coalesce(F.col(done).cast("boolean"), F.lit(False)) if done else F.lit(False)
    known = events.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*names, time])).withWatermark(time, watermark)
    rows = known.select(*names, F.col(time).alias("at"), F.unix_micros(time).alias("us"), is_done.alias("done"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*names).schema)
    processor = RefreshTimers(names, round(delay_seconds * 1_000_000), round(expire_seconds * 1_000_000))
    return rows.groupBy(*names).transformWithStateInPandas(
        processor, f"{shape}, first_us bigint, due_us bigint, n_updates bigint, started boolean", "Append", "EventTime"
    )


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)

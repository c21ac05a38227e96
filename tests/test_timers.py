"""Delayed refreshes: bursts, locks, and the stream against a plain simulation."""

import os
import random

import pytest

from larder.streaming import timers as T

SECOND = 1_000_000


def simulated(events, delay, expire, until):
    """Events in order of time, one by one: (first, due, count, started) due by ``until``."""
    out, pending, busy = [], None, None

    def fire():
        nonlocal busy
        first, last, n = pending
        started = busy is None or last + delay >= busy
        busy = last + delay + expire if started else busy
        out.append((first, last + delay, n, started))

    for us, done in sorted(events, key=lambda e: (e[0], not e[1])):
        if pending and (pending[1] + delay < us or (pending[1] + delay == us and not done)):
            fire()
            pending = None
        if done:
            busy = None
        else:
            pending = (pending[0], us, pending[2] + 1) if pending else (us, us, 1)
    if pending:
        fire()
    return [r for r in out if r[1] <= until]


@pytest.mark.parametrize("seed", range(20))
def test_settling_in_steps_equals_the_simulation(seed):
    rng = random.Random(seed)
    events = [(rng.randrange(400), rng.random() < 0.2) for _ in range(120)]
    events = [(t, d) for t, d in events]
    rows, bursts, done, busy, now = [], [], [], None, -1
    for until in sorted(rng.sample(range(600), 9)) + [1000]:
        arrived = [e for e in events if now <= e[0] < until] if now >= 0 else [e for e in events if e[0] < until]
        rng.shuffle(arrived)
        done += [t for t, d in arrived if d]
        bursts = T.merge_bursts([*bursts, *((t, t, 1) for t, d in arrived if not d)], 7)
        # instants before ``until`` are complete: nothing earlier comes any more
        new, bursts, done, busy = T.settle(bursts, done, busy, until - 1, 7, 50)
        rows, now = rows + new, until
    assert rows == simulated(events, 7, 50, 1000)
    assert not bursts and not done


def test_a_stream_out_of_order_equals_the_simulation(spark, tmp_path):
    rng = random.Random(5)
    start = 1_700_000_000 * SECOND
    events = {k: [(start + rng.randrange(3000) * SECOND // 4, rng.random() < 0.15) for _ in range(60)] for k in ("a", "b", "c")}
    rows = sorted(((us, k, done) for k, all_ in events.items() for us, done in all_), key=lambda r: r[0] + rng.randrange(20 * SECOND))
    rows += [(start + 5000 * SECOND, "z", False)]
    files = tmp_path / "in"
    files.mkdir()
    for n in range(0, len(rows), 40):  # a batch each; late by less than the watermark
        lines = [f'{{"code":"{k}","server_type":"off","us":{us},"done":{str(d).lower()}}}' for us, k, d in rows[n : n + 40]]
        lines += ['{"code":null,"server_type":"off","us":1700000000000000,"done":false}', '{"code":"a","server_type":"off","us":null,"done":false}']
        (files / f"{n:05d}.json").write_text("\n".join(lines))
        os.utime(files / f"{n:05d}.json", (1_600_000_000 + n, 1_600_000_000 + n))  # the source reads files by age
    read = spark.readStream.schema("code string, server_type string, us long, done boolean").option("maxFilesPerTrigger", 1).json(str(files))
    out = T.delayed_refreshes(read.selectExpr("code", "server_type", "timestamp_micros(us) AS timestamp", "done"), 10, 60, "1 minute", done="done")

    def run():
        with T.timer_state(spark):
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    want = sorted((k, "off", *r) for k, all_ in events.items() for r in simulated(all_, 10 * SECOND, 60 * SECOND, start + 4940 * SECOND))
    assert run() == want and any(not r[-1] for r in want)
    assert run() == want  # nothing new: nothing comes twice

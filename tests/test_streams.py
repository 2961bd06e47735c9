"""Streaming jobs against batch results: shuffled arrival, restarts, late rows."""

import datetime
import random

import pandas as pd
import pytest

from gridloom.streaming import jobs

START = datetime.datetime(2024, 1, 1)
SCHEMA = "book long, ts timestamp, id long, pnl double"


def _rows(n, books, seed):
    rng = random.Random(seed)
    return [(rng.randrange(books), START + datetime.timedelta(minutes=rng.randrange(20 * 1440)), i, rng.uniform(-60, 50)) for i in range(n)]


def _settled(rows, base, limit, until):
    """Equity, worst drawdown and first breach of each book over the rows before ``until``, in order of time."""
    out = {}
    for book, ts, _, pnl in sorted(rows, key=lambda r: (r[1], r[2])):
        if ts < until:
            n, equity, peak, worst, hit = out.get(book, (0, base, base, 0.0, None))
            equity += pnl
            peak = max(peak, equity)
            worst = min(worst, equity / peak - 1)
            out[book] = n + 1, equity, peak, worst, hit or (ts if equity / peak - 1 <= limit else None)
    return {b: (n, pytest.approx(e), pytest.approx(w), t is not None, t) for b, (n, e, _, w, t) in out.items()}


def _drain(spark, folder, out, late):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    found = jobs.run_available(jobs.drawdown_switch(stream, 1000.0, -0.25, "12 hours", late), out).collect()
    last = {}
    for r in found:
        if r.book not in last or r.n > last[r.book].n:
            last[r.book] = r
    trips = {}
    for r in sorted(found, key=lambda r: r.n):  # once tripped, a book stays so
        assert not (trips.get(r.book) and not r.tripped)
        trips[r.book] = r.tripped
    return {b: (r.n, r.equity, r.worst, r.tripped, r.tripped_at) for b, r in last.items()}


def test_drawdown_switch_on_shuffled_rows_and_after_a_restart(spark, tmp_path):
    rows = _rows(900, 4, 3)
    rng = random.Random(4)
    by_arrival = sorted(rows, key=lambda r: r[1] + datetime.timedelta(hours=rng.uniform(0, 40)))  # at most 40 hours behind
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    parts = [by_arrival[k * 150 : (k + 1) * 150] for k in range(6)]
    for k, part in enumerate(parts[:3]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{src}")
    newest = lambda seen: max(r[1] for r in seen) - datetime.timedelta(hours=48)
    edge = lambda t: datetime.datetime(t.year, t.month, t.day, 12 * (t.hour // 12))
    seen = [r for p in parts[:3] for r in p]
    assert _drain(spark, src, out, "48 hours") == _settled(seen, 1000.0, -0.25, edge(newest(seen)))
    for part in parts[3:]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{src}")
    got, want = _drain(spark, src, out, "48 hours"), _settled(rows, 1000.0, -0.25, edge(newest(rows)))
    assert got == want and len(got) == 4


def test_late_and_incomplete_rows_leave(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    at = lambda d, h=1: START + datetime.timedelta(days=d, hours=h)
    first = [(1, at(0), 1, -100.0), (1, at(0), 0, 50.0), (None, at(0), 2, 1.0), (1, None, 3, 1.0), (1, at(1), 4, None), (2, at(9), 5, 1.0)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    _drain(spark, src, out, "1 day")
    spark.createDataFrame([(1, at(0, 2), 6, -900.0), (1, at(8, 2), 7, 25.0), (2, at(20), 8, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    got = _drain(spark, src, out, "1 day")
    # the loss of 900 came eight days after its time and the watermark
    assert got[1] == (3, 975.0, pytest.approx(950 / 1050 - 1), False, None) and got[2] == (1, 1001.0, 0.0, False, None)


def test_a_book_is_read_once_for_all_intervals_that_a_batch_closes(spark, tmp_path):
    """Rows of 40 days at once, some of them open: a row per settled interval."""
    step = lambda d, k: (k, START + datetime.timedelta(days=d, hours=k), 10 * d + k, -1.0 if d % 3 else 2.0)
    rows = [step(d, k) for d in range(40) for k in range(3)]
    rows += [(0, START + datetime.timedelta(days=42, hours=1), 999, 0.0)]
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    got = jobs.run_available(jobs.drawdown_switch(spark.readStream.schema(SCHEMA).parquet(src), 1000.0, -0.25, "1 day", "4 days"), out).collect()
    assert sorted((r.book, r.n) for r in got) == [(k, n) for k in range(3) for n in range(1, 39)]
    until = START + datetime.timedelta(days=38)
    last = {r.book: (r.n, r.equity, r.worst, r.tripped, r.tripped_at) for r in sorted(got, key=lambda r: r.n)}
    assert last == _settled(rows, 1000.0, -0.25, until)


class _Cell:
    """A state variable in memory; reads and writes are counted."""

    def __init__(self):
        self.held, self.reads, self.writes = None, 0, 0

    def get(self):
        self.reads += 1
        return self.held

    def update(self, value):
        self.held, self.writes = value, self.writes + 1


def test_state_is_read_once_for_all_intervals_of_a_batch():
    day, cells = 86_400_000_000, []
    handle = type("Handle", (), {"getValueState": lambda self, *_: cells.append(_Cell()) or cells[-1]})()
    p = jobs._Drawdown(1000.0, -0.25)
    p.init(handle)
    (cell,) = cells  # no list of waiting rows and no timers
    step = lambda days, gain: pd.DataFrame({"until": [(d + 1) * day for d in days], "us": [d * day + 5 for d in days], "id": days, "pnl": gain})
    (out,) = p.handleInputRows((1,), iter([step([3, 2, 1], [-200.0, -100.0, 100.0]), step([0], [0.0])]), None)
    assert out.n.tolist() == [1, 2, 3, 4] and out.equity.tolist() == [1000.0, 1100.0, 1000.0, 800.0]
    assert out.tripped.tolist() == [False, False, False, True] and out.tripped_at[3] == pd.Timestamp(3 * day + 5, unit="us")
    (out,) = p.handleInputRows((1,), iter([step([9], [900.0])]), None)
    assert out.n.tolist() == [5] and out.tripped.tolist() == [True] and out.tripped_at[0] == pd.Timestamp(3 * day + 5, unit="us")
    assert (cell.reads, cell.writes) == (2, 2)

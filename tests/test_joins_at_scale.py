"""Nearest neighbours by cells, name prefixes, overfitting over blocks of strategies, numbered lines of split files."""

import datetime

import numpy as np
import pytest

from gridloom.operators import joins, pnl, signals, stats
from gridloom.sources import parsers as ps


def _brute_nearest(points, asked, n):
    out = {}
    for bar, ea in asked:
        own = points.get((bar, ea))
        if own is None or None in own:
            continue
        found = [(round(float(np.hypot(p[0] - own[0], p[1] - own[1])), 9), a) for (b, a), p in points.items() if b == bar and a != ea and None not in p]
        out[bar, ea] = [(a, k) for k, (_, a) in enumerate(sorted(found)[:n], 1)]
    return out


@pytest.mark.parametrize("one_cell", [2, 10_000])
def test_nearest_by_cells_matches_all_pairs(spark, one_cell):
    rng = np.random.default_rng(0)
    points = {}
    for bar, m in ((1, 150), (2, 60), (3, 3), (4, 1)):
        for a in range(m):
            x = rng.standard_normal(2)
            if bar == 2:
                x = np.round(x * 2) / 2  # ties, and equal points
            points[bar, f"A{a:03d}"] = tuple(map(float, x))
    points |= {(1, "far"): (900.0, -20.0), (1, "further"): (-4000.0, 3.0), (1, "none"): (None, 1.0), (2, "edge"): (2.0, -2.0), (1, "dense1"): (0.1, 0.1)}
    points |= {(1, f"D{k}"): (0.1 + k * 1e-7, 0.1) for k in range(40)}  # a crowd in one place
    rows = [(b, a, *p) for (b, a), p in points.items()]
    asked = [(b, a) for b, a in points] + [(1, "unknown"), (9, "A000")]
    events = spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(asked + asked[:5])], "event_id long, bar_no long, asset string")
    got = joins.nearest(events, spark.createDataFrame(rows, "bar_no long, asset string, size double, mom double"), 4, one_cell).collect()
    want = _brute_nearest(points, asked, 4)
    found = {}
    for r in sorted(got, key=lambda r: r.k):
        found.setdefault((r.bar_no, r.event_asset), {}).setdefault(r.event_id, []).append((r.asset, r.k))
    assert {k: list(v.values())[0] for k, v in found.items()} == {k: v for k, v in want.items() if v}
    assert len(found[1, "A000"]) == 2 and len(got) == sum(len(want.get(k, [])) for k in asked + asked[:5])


def test_names_match_by_whole_word_prefixes(spark):
    names = ["ACME", "ACME CORP", "ACME CORP HOLDINGS", "ALPHA BETA", "ALPHA", "OTHER", "GAMMA DELTA", None, "FIRST NATIONAL BANK OF X", "ACM"]
    book = [("ACME CORP", 1), ("ACME CORP", 0), ("ALPHA BETA GAMMA", 2), ("ALPHABET", 3), ("GAMMA DELTA ONE", 4), ("GAMMA DELTA TWO", 5), ("FIRST", 6), (None, 7), ("FIRST NATIONAL", 8)]
    got = {(r.name, r.id, r.how) for r in joins.name_match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(book, "book_name string, id long")).collect()}
    want = {(n, i, "exact") for n in names for b, i in book if n and n == b}
    for n in filter(None, names):
        hits = {b for b, _ in book if b and b != n and (n.startswith(b + " ") or b.startswith(n + " "))}
        if len(hits) == 1 and n not in {b for b, _ in book}:
            want.add((n, min(i for b, i in book if b in hits), "prefix"))
    assert got == want and len(got) == 6


def test_many_names_with_one_first_word_are_linear(spark):
    a = spark.range(60_000).selectExpr("concat('FIRST BANK ', id, ' OF TOWN') as name")
    b = spark.range(60_000).selectExpr("concat('FIRST BANK ', id) as book_name", "id")
    got = joins.name_match(a, b)
    assert got.count() == 60_000 and got.filter("how = 'prefix' and name = concat('FIRST BANK ', id, ' OF TOWN')").count() == 60_000


def test_pbo_over_blocks_of_strategies(spark, monkeypatch):
    rng = np.random.default_rng(1)
    t, m, blocks = 48, 23, 6
    x = rng.standard_normal((t, m)) * 0.01
    x[:, 3] = 0.0
    x[:, 7] = x[:, 5]  # ties: the lesser name wins
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
    rows = [(day(i), f"S{j:02d}", float(x[i, j])) for i in range(t) for j in range(m)]
    df = spark.createDataFrame(rows, "dt date, strategy_id string, ret double")
    sharpe = lambda r: np.array([np.mean(c) / np.std(c, ddof=1) if np.var(c, ddof=1) > 1e-18 else 0.0 for c in r.T])
    at = np.arange(t) * blocks // t
    omega, loss = [], []
    for split in range(1 << blocks):
        if split.bit_count() == blocks // 2:
            inside = (split >> at & 1).astype(bool)
            ins, oos = np.round(sharpe(x[inside]), 9), sharpe(x[~inside])
            best = ins.argmax()
            omega.append((np.round(oos, 9) <= np.round(oos[best], 9)).sum() / (m + 1))
            loss.append(oos[best] < 0)
    for size in (256, 4):
        monkeypatch.setattr(stats, "PBO_BLOCK", size)
        got = stats.pbo(df, blocks).first()
        assert (got.splits, got.pbo, got.loss_prob) == (len(omega), pytest.approx(np.mean(np.array(omega) <= 0.5)), pytest.approx(np.mean(loss)))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a.txt", 4000), ("b.txt", 10), ("c.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 37)}\n" for i in range(n)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "9000")
    try:
        got = ps.read_numbered_lines(spark, f"file://{tmp_path}")
        assert got.rdd.getNumPartitions() > 3
        rows = got.collect()
    finally:
        spark.conf.set(key, before)
    assert len(rows) == 4010 and all(r.line.split()[:2] == [r.file, str(r.line_no)] for r in rows)


def test_interval_members_expand_once(spark):
    """Overlapping, repeated and open intervals without a table of expanded rows that must be made distinct."""
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
    rng = np.random.default_rng(5)
    iv = [(f"A{rng.integers(6)}", int(a), None if rng.random() < 0.4 else int(a + rng.integers(-2, 15))) for a in rng.integers(-5, 40, 60)]
    iv += [("A0", 3, None), ("A0", 3, None), (None, 1, 4), ("A1", None, 9)]
    rows = [(n, None if a is None else day(a), None if b is None else day(b)) for n, a, b in iv]
    cal = [0, 2, 3, 7, 8, 21, 30, 31, 45]
    got = joins.interval_members(spark.createDataFrame([(day(c),) for c in cal * 2], "dt date"), spark.createDataFrame(rows, "asset string, valid_from date, valid_to date"))
    want = {(day(c), n) for c in cal for n, a, b in iv if a is not None and a <= c and (b is None or c < b)}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("explode(sequence(")]
    assert "Aggregate" not in above.split("Generate")[0] and "Window" not in above.split("Join")[0]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_and_labels_without_tables_of_owners_and_dates(spark):
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=int(i))
    rng = np.random.default_rng(8)
    rows = [(f"O{rng.integers(4)}", f"T{rng.integers(3)}", day(rng.integers(0, 1500)), day(0), "RAN"[rng.integers(3)]) for _ in range(400)]
    rows = [(o, t, f, f - datetime.timedelta(days=int(rng.integers(0, 9))), c) for o, t, f, _, c in rows]
    df = spark.createDataFrame(rows, "owner string, ticker string, filed date, traded date, code string")
    grid = [day(i) for i in (0, 20, 21, 300, 330, 400, 1499)]
    net = signals.net_cluster(df, spark.createDataFrame([(g,) for g in grid * 2], "dt date"), 90)
    want = {}
    for g in grid:
        for o, t, f, _, c in rows:
            if g - datetime.timedelta(days=90) < f <= g and c in "RA":
                want.setdefault((g, t), (set(), set()))["RA".index(c)].add(o)
    assert {(r.t, r.ticker): (r.buyers, r.sellers) for r in net.collect()} == {k: (len(b), len(s)) for k, (b, s) in want.items()}
    assert "owner" not in _plan(net).split("Window")[0]  # an owner is counted where its filings are in order
    label = signals.routine(df)
    first = {}
    for o, t, f, at, _ in rows:
        key = (o, t, at.month, at.year)
        first[key] = min(first.get(key, f), f)
    since = {}
    for (o, t, m, y), f in first.items():
        run = [first.get((o, t, m, y + k)) for k in range(3)]
        if all(run):
            since[o, t] = min(since.get((o, t), max(run)), max(run))
    got = sorted((r.owner, r.ticker, r.filed, r.traded, r.code, r.routine) for r in label.collect())
    assert got == sorted((*r, r[2] > since.get(r[:2], datetime.date.max)) for r in rows) and any(g[-1] for g in got)
    assert "Join" not in _plan(label)


def test_latest_surprises_and_sides_are_not_expanded(spark):
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=int(i))
    rng = np.random.default_rng(9)
    rows = [(f"T{rng.integers(3)}", day(rng.integers(0, 500)), k, float(k)) for k in range(150)]
    grid = [day(i) for i in range(-30, 600, 31)]
    df = spark.createDataFrame(rows, "ticker string, ann_date date, o_orderkey long, sue double")
    got = {(r.t, r.ticker): r.sue for r in signals.latest_surprise(df, spark.createDataFrame([(g,) for g in grid], "dt date"), 90).collect()}
    want = {}
    for t, a, k, v in sorted(rows, key=lambda r: r[1:3]):
        want |= {(g, t): v for g in grid if g - datetime.timedelta(days=90) < a <= g}
    assert got == want
    events = [(int(rng.integers(1, 30)), f"T{rng.integers(3)}", int(rng.choice([-1, 1]))) for _ in range(200)]
    bars = [(b, f"T{a}") for b in range(1, 31) for a in range(4)]
    x = pnl.sides_on_bars(spark.createDataFrame(events, "bar_no int, asset string, side int"), spark.createDataFrame(bars, "bar_no int, asset string"), {"x": (2, 5)})
    found = {(r.bar_no, r.asset): (r.x_side, r.x_n) for r in x.collect()}
    held = {(b, a): [s for e, n, s in events if n == a and 2 <= b - e <= 5] for b, a in bars}
    assert found == {k: (sum(v), len(v)) for k, v in held.items()} and "Join" not in _plan(x)

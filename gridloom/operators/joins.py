"""Point-in-time, interval, window and nearest-neighbour joins without nested loops over panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import last_known


def asof(grid: DataFrame, data: DataFrame, value: str, tolerance_days: int | None = None, last_print: str | None = None) -> DataFrame:
    """Latest ``value`` of (asset, dt) rows in ``data`` at or before each grid row.

    One union, one shuffle by asset, one sort: grid rows follow data rows of the
    same date. With a tolerance, older values are null. With ``last_print`` (a
    grid column holding the asset's last valid date), rows after it are null.
    """
    g = grid.withColumn("_side", F.lit(1)).withColumns({"_v": F.lit(None).cast(data.schema[value].dataType), "_at": F.lit(None).cast("date")})
    d = data.filter(F.col(value).isNotNull()).select("asset", "dt", F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col("dt").alias("_at"))
    w = W.partitionBy("asset").orderBy("dt", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = g.unionByName(d, allowMissingColumns=True).withColumn("_v", last_known(F.col("_v"), w)).withColumn("_at", last_known(F.col("_at"), w))
    out = both.filter("_side = 1")
    keep = F.lit(True)
    if tolerance_days is not None:
        keep = keep & (F.datediff("dt", "_at") <= tolerance_days)
    if last_print is not None:
        keep = keep & (F.col("dt") <= F.col(last_print))
    return out.withColumn(value, F.when(keep, F.col("_v"))).withColumn("source_dt", F.when(keep, F.col("_at"))).drop("_side", "_v", "_at")


def pit_value(asofs: DataFrame, facts: DataFrame) -> DataFrame:
    """Value of (entity, tag) as known at each ``asof``: greatest (filed, period_end) with filed <= asof.

    An as-of join per (entity, tag): asof dates and facts are merged in date
    order and the latest fact is carried forward.
    """
    keys = facts.select("entity", "tag").distinct().crossJoin(asofs.select("asof").distinct())
    best = facts.groupBy("entity", "tag", "filed").agg(F.max_by("value", "period_end").alias("value"), F.max("period_end").alias("period_end"))
    rows = keys.select("entity", "tag", F.col("asof").alias("d"), F.lit(1).alias("s"), F.lit(None).cast("struct<value:double,filed:date>").alias("v"))
    rows = rows.unionByName(best.select("entity", "tag", F.col("filed").alias("d"), F.lit(0).alias("s"), F.struct(F.col("value").cast("double").alias("value"), "filed").alias("v")))
    w = W.partitionBy("entity", "tag").orderBy("d", "s").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("v", last_known(F.col("v"), w)).filter("s = 1 and v is not null")
    return out.select(F.col("d").alias("asof"), "entity", "tag", "v.value", "v.filed")


def interval_members(dates: DataFrame, intervals: DataFrame) -> DataFrame:
    """(dt, asset) with valid_from <= dt < valid_to; a null valid_to is open.

    Interval ends become positions on the calendar of distinct dates, and each
    interval is expanded over the positions that it covers: the work is that of
    the members found, not of dates times assets. An asset's intervals are cut
    where an earlier one ends, so that expanded rows needn't meet again. Joins are
    on dates only, and those tables are sent to all tasks: open intervals, which
    share one missing end, stay where they lie.
    """
    cal = dates.select("dt").distinct().withColumn("g", F.lit(1))
    ends = intervals.select(F.col("valid_from").alias("dt")).unionByName(intervals.select(F.col("valid_to").alias("dt"))).distinct()
    # the one global window runs over distinct dates; an end comes before the calendar's own row of its date
    points = cal.unionByName(ends.filter("dt is not null").withColumn("g", F.lit(0)))
    before = F.sum("g").over(W.orderBy("dt", "g").rowsBetween(W.unboundedPreceding, 0))
    points = points.withColumn("pos", before.cast("int"))
    at = points.filter("g = 0").select("dt", "pos")
    on = lambda end, pos: F.broadcast(at.select(F.col("dt").alias(end), F.col("pos").alias(pos)))
    i = intervals.select("asset", "valid_from", "valid_to").join(on("valid_from", "lo"), "valid_from").join(on("valid_to", "hi"), "valid_to", "left")
    i = i.crossJoin(F.broadcast(cal.agg(F.count("*").cast("int").alias("top"))))
    i = i.withColumn("hi", F.when(F.col("valid_to").isNull(), F.col("top")).otherwise(F.col("hi"))).filter("lo < hi")
    i = i.groupBy("asset", "lo").agg(F.max("hi").alias("hi"))
    earlier = W.partitionBy("asset").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    i = i.withColumn("lo", F.greatest("lo", F.max("hi").over(earlier))).filter("lo < hi")
    i = i.select("asset", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"))
    return i.join(F.broadcast(points.filter("g = 1").select("dt", (F.col("pos") - 1).alias("pos"))), "pos").select("dt", "asset")


def membership_intervals(today: DataFrame, changes: DataFrame, start: Column) -> DataFrame:
    """Member intervals from today's members and a change log (dt, asset, action add|remove).

    A name's state at any time follows from its next change: before a removal it
    is a member, before an addition it is not; after the last change today's
    membership holds. On one date a removal wins. Changes at or before ``start``
    are ignored.
    """
    c = changes.filter(F.col("dt") > start).groupBy("asset", "dt").agg(F.max((F.col("action") == "remove").cast("int")).alias("rem"))
    names = today.select("asset").unionByName(c.select("asset")).distinct()
    last = names.join(today.select("asset").distinct().withColumn("now", F.lit(1)), "asset", "left")
    # the row at dt ends an interval in which the state is known; a last open interval ends nowhere
    ends = c.select("asset", "dt", "rem").unionByName(
        last.select("asset", F.lit(None).cast("date").alias("dt"), F.coalesce("now", F.lit(0)).alias("rem"))
    )
    w = W.partitionBy("asset").orderBy(F.col("dt").asc_nulls_last())
    rows = ends.withColumn("valid_from", F.coalesce(F.lag("dt").over(w), start))
    return rows.filter("rem = 1").select("asset", "valid_from", F.col("dt").alias("valid_to"))


def events_to_bars(events: DataFrame, cal: DataFrame, date: str, lag: int = 0) -> DataFrame:
    """Last bar at or before each event date, plus ``lag`` bars; events outside the calendar are dropped."""
    e = events.withColumn("_side", F.lit(1)).withColumn("dt", F.col(date)).withColumn("bar_no", F.lit(None).cast("int"))
    c = cal.select("dt", F.col("bar_no").cast("int").alias("bar_no"), F.lit(0).alias("_side"))
    # the one global window runs over distinct dates; events then join on their date
    dates = e.select("dt").distinct().withColumn("_side", F.lit(1)).withColumn("bar_no", F.lit(None).cast("int"))
    w = W.orderBy("dt", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = dates.unionByName(c).withColumn("bar_no", last_known(F.col("bar_no"), w)).filter("_side = 1").select("dt", "bar_no")
    top = cal.agg(F.max("bar_no").alias("_top"))
    out = e.drop("bar_no", "_side").join(found, "dt").crossJoin(F.broadcast(top))
    return out.withColumn("bar_no", F.col("bar_no") + lag).filter("bar_no is not null and bar_no <= _top").drop("_top", "dt")


def event_window(events: DataFrame, bars: int) -> DataFrame:
    """Each event on bars entry + 1 ... entry + ``bars`` (column step), ready for an equi join on bar_no."""
    return events.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(bars)))).withColumn("bar_no", F.col("bar_no") + F.col("step"))


def trailing_window(rows: DataFrame, grid: DataFrame, date: str, days: int) -> DataFrame:
    """Rows with date in (t - days, t] for each grid date t, as (…, t).

    Grid dates are expanded to the days that reach them and sent to all tasks
    (grid dates times ``days`` rows), so the join is on the day and rows stay
    where they lie.
    """
    g = grid.select(F.col("dt").alias("t")).distinct()
    g = g.select("t", F.explode(F.sequence(F.date_sub("t", days - 1), F.col("t"))).alias("_day"))
    return rows.join(F.broadcast(g), F.col(date) == F.col("_day")).drop("_day")


def reached(rows: DataFrame, grid: DataFrame, date: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``lo`` and ``hi``, the positions of the first and last grid date t with date in (t - days, t], and the grid as (t, pos).

    As :func:`trailing_window`, but a row stays one row; rows that reach no date leave.
    """
    # the global window runs over the grid's distinct dates
    cal = grid.select(F.col("dt").alias("t")).distinct().withColumn("pos", F.row_number().over(W.orderBy("t")))
    g = cal.select("pos", F.explode(F.sequence(F.date_sub("t", days - 1), F.col("t"))).alias("_day")).groupBy("_day").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return rows.join(F.broadcast(g), F.col(date) == F.col("_day")).drop("_day"), cal


#: Widths of grid cells in units of the features, coarsest first; -1 is the level of the whole bar. Assets up to which a bar is one cell.
WIDTHS = (256.0, 64.0, 16.0, 4.0, 2.0, 1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625, 0.0078125)
WHOLE, ONE_CELL = -1, 256


def _cells(x: str, y: str) -> Column:
    """The cell of each level that (x, y) lies in."""
    at = lambda c, w: F.floor(F.col(c) / w).cast("long")
    whole = F.struct(F.lit(WHOLE).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    fine = (F.struct(F.lit(k).alias("level"), at(x, w).alias("cx"), at(y, w).alias("cy")) for k, w in enumerate(WIDTHS))
    return F.array(whole, *fine)


def nearest(events: DataFrame, features: DataFrame, n: int, one_cell: int = ONE_CELL) -> DataFrame:
    """The ``n`` other assets nearest to an event's asset by (size, mom) on its bar; distances to nine decimals, ties by name.

    Neighbours depend on bar and asset alone: they are found once per distinct
    pair that an event names. Assets lie in grids of falling width. The finest
    cell around an asset that holds more than ``n`` bounds the n-th distance;
    the at most nine cells of at least that width around it then hold all that
    can be as near. So an asset meets its surroundings and not its bar; a bar of
    up to ``one_cell`` assets is a single cell. Assets without both features
    neither have nor are neighbours.
    """
    f = features.select("bar_no", "asset", F.col("size").cast("double").alias("size"), F.col("mom").cast("double").alias("mom"))
    f = f.filter("asset is not null and size is not null and mom is not null and not isnan(size) and not isnan(mom)")
    f = f.withColumn("_few", F.count("*").over(W.partitionBy("bar_no")) <= one_cell)
    cells = F.when(F.col("_few"), F.slice(_cells("size", "mom"), 1, 1)).otherwise(_cells("size", "mom"))
    members = f.select("bar_no", "asset", "size", "mom", F.inline(cells))
    held = members.groupBy("bar_no", "level", "cx", "cy").agg(F.count("*").alias("held")).filter((F.col("level") == WHOLE) | (F.col("held") > n))
    named = events.select("event_id", "bar_no", F.col("asset").alias("ea"))
    own = members.select("bar_no", F.col("asset").alias("ea"), F.col("size").alias("es"), F.col("mom").alias("em"), "level", "cx", "cy")
    asked = named.select("bar_no", "ea").distinct().join(own, ["bar_no", "ea"]).join(held.drop("held"), ["bar_no", "level", "cx", "cy"])
    asked = asked.groupBy("bar_no", "ea").agg(F.max(F.struct("level", "cx", "cy", "es", "em")).alias("c")).select("bar_no", "ea", "c.*")
    others = members.select("bar_no", "level", "cx", "cy", "asset", "size", "mom")
    rank = W.partitionBy("bar_no", "ea").orderBy("distance", "asset")

    def met(q: DataFrame) -> DataFrame:
        c = q.join(others, ["bar_no", "level", "cx", "cy"]).filter("asset <> ea")
        far = F.sqrt(F.pow(F.col("size") - F.col("es"), 2) + F.pow(F.col("mom") - F.col("em"), 2))
        c = c.withColumn("distance", F.round(far, 9)).withColumn("k", F.row_number().over(rank))
        return c.filter(F.col("k") <= n)

    first = met(asked)
    keep = ["bar_no", "ea", "asset", "distance", "k"]
    reach = first.filter(F.col("level") != WHOLE).groupBy("bar_no", "ea", "es", "em").agg((F.max("distance") + 2e-9).alias("reach"))
    level = F.size(F.filter(F.lit(list(WIDTHS)), lambda w: w >= F.col("reach"))) - 1
    reach = reach.withColumn("level", level)
    width = F.get(F.lit(list(WIDTHS)), F.col("level"))
    span = lambda c: F.when(F.col("level") == WHOLE, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.floor((F.col(c) - F.col("reach")) / width), F.floor((F.col(c) + F.col("reach")) / width))
    )
    around = reach.select("bar_no", "ea", "es", "em", "level", F.explode(span("es")).alias("cx"), "reach").withColumn("cy", F.explode(span("em")))
    near = first.filter(F.col("level") == WHOLE).select(*keep).unionByName(met(around).select(*keep))
    return named.join(near, ["bar_no", "ea"]).select("event_id", "bar_no", F.col("ea").alias("event_asset"), "asset", "distance", "k")


def _word_prefixes(name: str) -> Column:
    """The name's first words, all but the whole."""
    words = F.split(name, " ")
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).otherwise(F.array().cast("array<string>"))


def name_match(names: DataFrame, book: DataFrame) -> DataFrame:
    """(name, id): exact normalised match, else the one book name that is a word prefix of the name or the other way round.

    ``names``: name; ``book``: book_name, id. Prefixes are keys of joins on
    equality, the book's summed up before; names that share their first words
    don't meet.
    """
    exact = names.join(book, F.col("name") == F.col("book_name")).select("name", "id", F.lit("exact").alias("how"))
    left = names.join(exact, "name", "left_anti").select("name").distinct()
    one = book.filter("book_name is not null").groupBy("book_name").agg(F.min("id").alias("id"))
    shorter = left.select("name", F.explode(_word_prefixes("name")).alias("book_name")).join(one, "book_name").select("name", F.lit(1).cast("long").alias("k"), "id")
    longer = one.select(F.explode(_word_prefixes("book_name")).alias("name"), "id").groupBy("name").agg(F.count("*").alias("k"), F.min("id").alias("id"))
    longer = left.join(longer, "name").select("name", "k", "id")
    near = shorter.unionByName(longer).groupBy("name").agg(F.sum("k").alias("k"), F.min("id").alias("id"))
    return exact.unionByName(near.filter("k = 1").select("name", "id", F.lit("prefix").alias("how")))

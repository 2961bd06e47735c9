"""Joins whose keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that may be sent to all tasks: those with more than this fraction of the weight, so fewer than this many.
MAX_HOT = 10_000


def join_to_one(rows: DataFrame, ones: DataFrame, key: str, weight: str, spread: Column, outer: bool = False) -> DataFrame:
    """Join of ``rows`` to ``ones``, which has one row per key and in ``weight`` how many rows share it.

    An inner join, or with ``outer`` a left one, without a null key's rows
    becoming hot. ``spread`` is a value of the key's type that differs from row
    to row.

    A key that holds more than 1 / ``MAX_HOT`` of the weight is joined where its
    rows lie; there are fewer than ``MAX_HOT`` of these, whatever the data. Its
    rows still go through the shuffle of the others, dealt by ``spread``, so the
    rows are read once and no task gets a hot key. ``ones`` is read twice and
    should be a written table.
    """
    total = ones.agg(F.sum(weight)).first()[0] or 0
    rest = [c for c in ones.columns if c not in (key, weight)]
    held = F.struct(key, *rest)
    hot = F.col(weight) * MAX_HOT > total
    near = ones.filter(hot).select(F.col(key).alias("_near"), held.alias("_hot"))
    far = ones.filter(~hot).select(F.col(key).alias("_far"), held.alias("_cold"))
    found = rows.join(F.broadcast(near), F.col(key) == F.col("_near"), "left")
    # a spread row's deal may by chance be some key: what it meets there is ignored
    spread_out = F.col("_hot").isNotNull() | F.col(key).isNull()
    deal = F.when(spread_out, spread).otherwise(F.col(key)).alias("_deal")
    found = found.select(deal, "_hot", F.col(key).isNull().alias("_none"), *(c for c in rows.columns if c != key))
    found = found.join(far.hint("merge"), F.col("_deal") == F.col("_far"), "left")
    found = found.withColumn("_one", F.when(~F.col("_none"), F.coalesce("_hot", "_cold")))
    if not outer:
        found = found.filter("_one is not null")
    # a row without its one keeps its key, which is then the deal
    own = F.when(~F.col("_none"), F.coalesce(F.col("_one")[key], F.col("_deal"))).alias(key)
    return found.select(*(own if c == key else F.col(c) for c in rows.columns), *(F.col("_one")[c].alias(c) for c in rest))

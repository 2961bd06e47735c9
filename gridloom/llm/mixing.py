"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time [0, 1], linear between
knots. Its integral is the source's weight in the token budget; its running
integral, scaled to the source's target, is the cumulative token demand. The
source's documents, in a fixed pseudo-random order and repeated from the start
when used up, form a token stream that is cut at the target. A document's
training position is the time at which cumulative demand reaches its first
token: the inverse of a piecewise quadratic. Documents are range-sorted by it.

All work is DataFrame expressions. Running sums go through ``BUCKETS`` hash
buckets per source, so a source of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.store import materialize

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"

#: (time, multiple of the source's weight) of a source that rises, stays or falls; each integrates to 1.
SHAPES = {
    3: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)],
    1: [(0.0, 1.0), (1.0, 1.0)],
    2: [(0.0, 1.5), (1.0, 0.5)],
}
CYCLE = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of maximal runs without 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def cycle_schedule(sources: DataFrame, source: str = "source") -> DataFrame:
    """(source, knots): weights 3, 1, 2, repeating over the distinct sources by code point, null last."""
    rank = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1
    rows = sources.select(source).distinct().withColumn("_k", rank % len(CYCLE))

    def knots(weight: int) -> Column:
        return F.array(*(F.struct(F.lit(t).alias("t"), F.lit(weight * m).alias("w")) for t, m in SHAPES[weight]))

    pick = F.when(F.col("_k") == 0, knots(CYCLE[0])).when(F.col("_k") == 1, knots(CYCLE[1])).otherwise(knots(CYCLE[2]))
    return rows.select(source, pick.alias("knots"))


def _segments(knots: str) -> Column:
    """Linear pieces of a schedule with the running integral at their start."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.element_at(knots, i)["t"].alias("t0"),
            (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]).alias("dt"),
            F.element_at(knots, i)["w"].alias("w0"),
            F.element_at(knots, i + 1)["w"].alias("w1"),
        ),
    )

    def area(p: Column) -> Column:
        return p["dt"] * (p["w0"] + p["w1"]) / 2

    def with_start(i: Column) -> Column:
        before = F.aggregate(F.slice(pieces, 1, i - 1), F.lit(0.0), lambda s, p: s + area(p))
        p = F.element_at(pieces, i)
        return F.struct(
            p["t0"].alias("t0"), p["dt"].alias("dt"), p["w0"].alias("w0"), p["w1"].alias("w1"),
            before.alias("d0"), area(p).alias("d"),
        )

    return F.transform(F.sequence(F.lit(1), F.size(pieces)), with_start)


def source_targets(sizes: DataFrame, schedule: DataFrame, share: float, ceiling: float) -> DataFrame:
    """Per source: docs, source_size, weight, target and schedule segments.

    The budget ``share * total`` is dealt by weight; no source gets more than
    ``ceiling`` times its size and the excess is dealt again by weight among the
    others. Written as the level at which the filled sources and the weighted
    rest meet the budget, over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    plan = schedule.select(F.col("source").alias("_s"), _segments("knots").alias("segments"))
    weight = F.aggregate("segments", F.lit(0.0), lambda s, p: s + p["d"])
    per = per.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    per = per.withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    everything = W.partitionBy()
    cap = ceiling * F.col("source_size")
    ratio = F.when(F.col("weight") > 0, cap / F.col("weight"))
    per = per.withColumn("_cap", cap).withColumn("_ratio", ratio)
    budget = F.least(share * F.sum("source_size").over(everything), F.sum(F.when(F.col("weight") > 0, F.col("_cap"))).over(everything))
    below = W.orderBy(F.col("_ratio").asc_nulls_first(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("_cap"))).over(below), F.lit(0.0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    level = F.when(open_ > 0, (budget - filled) / open_)
    per = per.withColumn("_level", level)
    # the first source, by ratio, whose own cap lies at or above the level fixes it for all that follow
    fixed = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(fixed.isNull(), F.col("_cap")).otherwise(
        F.least("_cap", F.col("weight") * fixed)
    )
    return per.select("source", "docs", "source_size", "weight", target.alias("target"), "segments")


def _position(token: Column, target: Column, segments: str, weight: str) -> Column:
    """Training time at which the source's cumulative demand reaches ``token``."""
    demand = F.try_divide(token, target) * F.col(weight)
    at = F.coalesce(
        F.get(F.filter(segments, lambda p: (p["d0"] <= demand) & (demand < p["d0"] + p["d"])), F.lit(0)),
        F.try_element_at(F.filter(segments, lambda p: p["d"] > 0), F.lit(-1)),
    )
    rest = demand - at["d0"]
    slope = F.try_divide(at["w1"] - at["w0"], at["dt"])
    root = F.sqrt(F.greatest(at["w0"] * at["w0"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(at["t0"] + F.try_divide(2 * rest, at["w0"] + root), F.lit(1.0))


def curriculum_mix(
    docs: DataFrame,
    schedule: DataFrame | None = None,
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document, range-sorted by first training position.

    doc_id, source, size, source_size, target, taken, copies (array of
    struct(copy, words, position) in stream order), position (of the first
    copy; null if nothing is taken).

    ``schedule`` is (source, knots array<struct<t double, w double>>); without
    it :func:`cycle_schedule` is used; a source it lacks has weight 0. A
    source's taken words sum to its target, rounded to a word: the document in
    which the stream reaches the target gives the words up to it.

    Null, empty and separator-only texts: size 0, taken 0. A null source is a
    source. Repeated rows are documents of their own; equal ids follow each
    other in the order. An empty table gives no rows. Other columns are ignored.
    """
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sizes = sizes.withColumn("_h", _order(F.col("doc_id"), seed))
    sizes = materialize(sizes.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")), "sizes")
    if schedule is None:
        schedule = cycle_schedule(sizes)
    targets = source_targets(sizes, schedule, share, ceiling)
    known = ["source", "docs", "source_size", "weight", "target", "segments"]
    per_bucket = sizes.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    ahead = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    per_bucket = per_bucket.join(
        targets.select(*(F.col(c).alias(f"_t_{c}" if c == "source" else c) for c in known)),
        F.col("source").eqNullSafe(F.col("_t_source")),
    ).select(F.col("source").alias("_ps"), F.col("_b").alias("_pb"), "_ahead", "source_size", "weight", "target", "segments")
    rows = sizes.join(per_bucket, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_b") == F.col("_pb")))
    inside = W.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.withColumn("_start", start).withColumn("_goal", F.round("target").cast("long"))
    passes = int(-(-ceiling // 1))
    copies = []
    for k in range(passes):
        first = F.col("_start") + k * F.col("source_size")
        words = F.greatest(F.least("size", F.col("_goal") - first), F.lit(0))
        copies.append(F.struct(
            F.lit(k + 1).alias("copy"), words.cast("long").alias("words"),
            _position(first.cast("double"), F.col("target"), "segments", "weight").alias("position"),
        ))
    rows = rows.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    out = rows.select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
        taken.alias("taken"), "copies", F.get("copies", F.lit(0))["position"].alias("position"), "_h",
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, "position", "_h").sortWithinPartitions("position", "_h").drop("_h")


def training_order(mix: DataFrame) -> DataFrame:
    """One row per taken copy (doc_id, source, copy, words, position), range-sorted by position."""
    parts = int(mix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = mix.select("doc_id", "source", F.explode("copies").alias("c"))
    rows = rows.select("doc_id", "source", "c.copy", "c.words", "c.position")
    return rows.repartitionByRange(parts, "position", "doc_id").sortWithinPartitions("position", "doc_id")

"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers, and names (capitalised words inside a sentence)
become typed placeholders; five-word windows of the result are hash-joined to
the benchmark's. Between a document and an item, the words behind the
placeholders must correspond one to one: "Ann has 3 ... Ann" matches
"Tom has 7 ... Tom", not "Tom has 7 ... Bob". Where they don't, pairs of words are
taken in the order of the item's windows that hold them, most first (then equal
words first, then as they come in item and document), each if neither of its
words is taken; a window counts if all its pairs are. This is done twice, once
with the pairs of all word-for-word windows taken before the others, and the
better counts: a passage with one number changed loses that number's windows
only. A document is contaminated when the windows that count cover
``threshold`` of an item's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.bytetext import Chunk, chunks, lists, mix, rows_of
from gridloom.llm.store import materialize, small_batches

WIDTH, THRESHOLD, MIN_PLAIN = 5, 0.8, 2
#: Benchmark windows up to this number (8 bytes each) are sent to the tasks to thin the document side before the join.
MAX_BROADCAST_WINDOWS = 2_000_000
# fixed values: unit words
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms oz ounce "
    "ounces lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons meter meters metre metres "
    "kilometer kilometers kilometre kilometres second seconds sec minute minutes min hour hours hr day days week weeks "
    "month months year years percent % dollar dollars euro euros cent cents usd eur degrees celsius fahrenheit mph kph "
    "watt watts kw volt volts joule joules byte bytes kb mb gb"
).split()

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*b"!\"#$&'()*,-./:;<=>?@[\\]^_`{|}~"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".!?:"]] = True
_SLOT = mix(np.arange(1, 4, dtype=np.uint64), 77)


def _unit_hashes() -> np.ndarray:
    c = next(chunks(pa.array([" ".join(UNITS)])))
    return np.sort(c.words())


_UNIT_HASHES = _unit_hashes()


def _stripped(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without outer punctuation."""
    start, end = c.start.copy(), c.end.copy()
    while len(start):
        move = (start < end) & _PUNCT[c.data[np.minimum(start, len(c.data) - 1)]]
        if not move.any():
            break
        start[move] += 1
    while len(start):
        move = (start < end) & _PUNCT[c.data[np.maximum(end - 1, 0)]]
        if not move.any():
            break
        end[move] -= 1
    return start, end


def canonical_words(c: Chunk, lower: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, canonical hash, slot word hash or 0, word hash) per word, outer punctuation stripped, bare punctuation dropped.

    ``lower`` holds the same rows in lower case, and so the same words.
    """
    start, end = _stripped(c)
    row = c.row
    full = start < end
    newline = np.concatenate(([0], np.cumsum(c.raw == 10)))
    opening = np.ones(len(start), dtype=bool)
    if len(start) > 1:
        same = row[1:] == row[:-1]
        opening[1:] = ~same | _STOP[c.raw[c.end[:-1] - 1]] | (newline[c.start[1:]] > newline[c.end[:-1]])
    start, end, row, opening = start[full], end[full], row[full], opening[full]
    word = lower.hashes(*(x[full] for x in _stripped(lower)))
    digits = np.concatenate(([0], np.cumsum((c.raw >= 48) & (c.raw <= 57))))
    number = digits[end] > digits[start]
    second = np.minimum(start + 1, max(len(c.raw) - 1, 0))
    title = (_UPPER[c.raw[start]] & ~_UPPER[c.raw[second]]) if len(start) else number
    name = title & (end - start > 1) & ~opening & ~number
    unit = np.zeros(len(word), dtype=bool)
    if len(word) > 1:
        spot = np.minimum(np.searchsorted(_UNIT_HASHES, word), len(_UNIT_HASHES) - 1)
        unit[1:] = (_UNIT_HASHES[spot] == word)[1:] & number[:-1] & (row[1:] == row[:-1])
    kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
    canonical = np.where(kind > 0, _SLOT[np.maximum(kind - 1, 0)], word)
    return row, canonical, np.where(kind > 0, word, np.uint64(0)), word


def _window_rows(texts: DataFrame, document: bool, wanted=None) -> DataFrame:
    """(id, window, pos, n_windows, slots) for all windows of documents or items, or those whose hash is in the sorted ``wanted``."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        for batch in batches:
            for c in chunks(batch.column(1)):
                row, word, slot, plain_word = canonical_words(c, rows_of(batch.column(2), c.first, c.rows))
                last = len(word) - WIDTH + 1
                if last <= 0:
                    continue
                at = np.flatnonzero(row[:last] == row[WIDTH - 1 :])
                plain = sum((slot[at + k] == 0).astype(np.int64) for k in range(WIDTH)) >= MIN_PLAIN
                # windows of nothing but names and numbers count word for word, in items that have no others
                bare = at[~plain]
                at = at[plain]
                count = np.bincount(row[at], minlength=c.rows)
                if not document:
                    bare = bare[count[row[bare]] == 0]
                    count = count + np.bincount(row[bare], minlength=c.rows)
                # each window as it is; word for word, for texts whose case hides the names; and on the document
                # side with a plain first word, which a passage pasted into a sentence has capitalised
                slotted = at[sum((slot[at + k] != 0).astype(np.int64) for k in range(WIDTH)) > 0]
                opening = at[slot[at] != 0] if document else at[:0]
                kind = np.repeat([0, 1, 2], [len(at), len(slotted) + len(bare), len(opening)])
                at = np.concatenate((at, slotted, bare, opening))
                window = np.zeros(len(at), dtype=np.uint64)
                for k in range(WIDTH):
                    verbatim = (kind == 1) | (kind == 2) & (k == 0)
                    window = mix(window + np.where(verbatim, plain_word[at + k], word[at + k]), 20 + k)
                window = window.view(np.int64)
                if known is not None and len(known):
                    spot = np.minimum(np.searchsorted(known, window), len(known) - 1)
                    use = known[spot] == window
                    at, window, kind = at[use], window[use], kind[use]
                begin = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=c.rows))))
                slots = np.stack([slot[at + k] for k in range(WIDTH)], axis=1)
                slots[kind == 1] = 0
                slots[kind == 2, 0] = 0
                slots = slots.view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row[at] + c.first)),
                        pa.array(window),
                        pa.array(at - begin[row[at]], pa.int64()),
                        pa.array(count[row[at]], pa.int64()),
                        lists(slots, np.arange(len(at) + 1) * WIDTH, pa.int64()),
                    ],
                    names=["id", "window", "pos", "n_windows", "slots"],
                )

    return texts.select("id", "t", F.lower("t").alias("l")).mapInArrow(run, "id long, window long, pos long, n_windows long, slots array<long>")


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_windows", pa.int64()), ("item_windows", pa.int64()), ("reworded", pa.bool_())])


def consistent_windows(windows: list[tuple[int, int, list[int], list[int]]]) -> dict[int, bool]:
    """The item positions of windows whose pairs of slot words are all taken, and whether each only matches reworded.

    ``windows`` are (item position, document position, item slots, document slots), 0 where there is no slot.
    """
    held: dict[tuple[int, int], set[int]] = {}
    first: dict[tuple[int, int], tuple[int, int]] = {}
    each = []
    for q, p, mine, other in windows:
        own = {(a, b): (q + k, p + k) for k, (a, b) in reversed(list(enumerate(zip(mine, other, strict=True)))) if a}
        for x, at in own.items():
            held.setdefault(x, set()).add(q)
            first[x] = min(first.get(x, at), at)
        each.append((q, own))
    order = sorted(held, key=lambda x: (-len(held[x]), x[0] != x[1], first[x]))
    verbatim = {q for q, own in each if own and all(a == b for a, b in own)}

    def cover(taken: set[tuple[int, int]], windows: list) -> dict[int, bool]:
        left, right = {a for a, _ in taken}, {b for _, b in taken}
        for x in order:
            if x[0] not in left and x[1] not in right:
                left.add(x[0])
                right.add(x[1])
                taken.add(x)
        places: dict[int, bool] = {}
        for q, own in windows:
            if taken.issuperset(own):
                places[q] = places.get(q, True) and any(a != b for a, b in own)
        return places

    fixed = {x for _, own in each if all(a == b for a, b in own) for x in own}
    # without them fixed, what is known to be word for word must agree with the rest like any other window
    ways = cover(fixed, each), cover(set(), [(q, own) for q, own in each if own or q not in verbatim])
    return max(ways, key=len)


def _covered(threshold: float):
    """Rows of a document and an item with all their windows to those that are contaminated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):  # a pair's windows take many times their Arrow size as Python objects
                (r,) = batch.slice(at, 1).to_pylist()
                places = consistent_windows([(w["item_pos"], w["pos"], w["item_slots"], w["slots"]) for w in r["windows"]])
                if len(places) >= threshold * r["item_windows"] - 1e-9:
                    rows.append({
                        "doc_id": r["id"], "item_id": r["item_id"], "coverage": len(places) / r["item_windows"], "matched_windows": len(places),
                        "item_windows": r["item_windows"], "reworded": any(places.values()),
                    })
            yield from pa.Table.from_pylist(rows, schema=_FOUND).to_batches()

    return run


def contaminated_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, coverage, matched_windows, item_windows, reworded), one row per contaminated pair.

    ``reworded`` is true when a window counts that matches with other words behind its placeholders only.
    Null, empty and short texts (under five words) match nothing, on both
    sides. An item whose windows all hold fewer than two plain words is matched
    word for word. Repeated rows are one document of that id; several texts under one id
    are judged together. Rows with a null id are left out, other columns ignored.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("t"))
    items = materialize(_window_rows(items.filter("id is not null").distinct(), document=False), "bench")
    bench = items.select(
        F.col("id").alias("item_id"), "window", F.col("pos").alias("item_pos"),
        F.col("n_windows").alias("item_windows"), F.col("slots").alias("item_slots"),
    )
    spark = docs.sparkSession
    wanted, distinct = None, items.select("window").distinct()
    if distinct.count() <= MAX_BROADCAST_WINDOWS:
        found = np.array([r.window for r in distinct.toLocalIterator()], dtype=np.int64)
        wanted = spark.sparkContext.broadcast(np.sort(found))
        if len(found) == 0:
            wanted = spark.sparkContext.broadcast(np.array([0], dtype=np.int64))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    found = _window_rows(texts.filter("id is not null"), document=True, wanted=wanted).drop("n_windows")
    if wanted is None:
        found = found.join(distinct, "window", "left_semi")
    found = materialize(found, "found")
    # a pair that reaches the threshold shares one of any k windows of the item if it may miss k - 1: ask by the rarest ones
    held = bench.select("window", "item_id").distinct().groupBy("window").agg(F.count("*").alias("held"))
    places = bench.join(held, "window").groupBy("item_id", "item_pos").agg(F.max("held").alias("held"), F.max("item_windows").alias("n"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("held", "item_pos"))
    rare = places.withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    asked = bench.join(rare.select("item_id", "item_pos"), ["item_id", "item_pos"]).select("window", "item_id").distinct()
    pairs = found.select("id", "window").distinct().join(asked, "window").select("id", "item_id").distinct()
    hits = found.join(pairs, "id").join(bench, ["item_id", "window"])
    # windows of equal slots count once; a pair whose windows can't reach the threshold, consistent or not, leaves here
    hits = hits.groupBy("id", "item_id", "item_windows", "item_pos", "item_slots", "slots").agg(F.min("pos").alias("pos"))
    per = hits.groupBy("id", "item_id", "item_windows").agg(
        F.collect_list(F.struct("item_pos", "pos", "item_slots", "slots")).alias("windows"), F.count_distinct("item_pos").alias("places")
    )
    per = per.filter(F.col("places") >= threshold * F.col("item_windows") - 1e-9).drop("places")
    return per.mapInArrow(_covered(threshold), "doc_id long, item_id long, coverage double, matched_windows long, item_windows long, reworded boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates; rows with a null id stay."""
    lost = contaminated_documents(docs, benchmark, **options).select(F.col("doc_id").alias("_gl_lost")).distinct()
    return docs.join(lost, docs[options.get("id_col", "doc_id")] == F.col("_gl_lost"), "left_anti")

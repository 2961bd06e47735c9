"""MinHash near-duplicates: fast similarity sketches, banding, exact confirmation.

A document is the set of its distinct word shingles. The sketch throws every
shingle into one of ``bins`` bins per round and keeps each bin's least value of
the earliest round that reached it; after ``bins`` random rounds, round
``bins + j`` throws everything into bin j, so each bin fills for any non-empty
set. Equal coordinates of two sketches estimate the Jaccard similarity with the
concentration of independent samples without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.bytetext import Chunk, chunks, lists, mix
from gridloom.llm.components import connected_components
from gridloom.llm.hot import join_to_one
from gridloom.llm.store import materialize, small_batches

BINS, BAND_ROWS = 120, 5
#: Members a block: a task confirms one pair of blocks. Columns multiplied at once there.
BLOCK_ROWS, COLUMNS = 128, 4096
#: Sets of a large cluster that tell its frequent shingles, and members that share one copy of their list.
PROBE_SETS, LIST_ROWS = 32, 1024


def shingle_sets(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, bounds): sorted distinct shingle hashes, and each row's range in them.

    A row of fewer than ``width`` words is its whole word sequence as one shingle.
    """
    word, row = chunk.words(), chunk.row
    n = len(word)
    parts, rows = [], []
    if n >= width:
        full = row[width - 1 :] == row[: n - width + 1]
        at = np.flatnonzero(full)
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            h = mix(h + word[at + k], k + 1)
        parts.append(h)
        rows.append(row[at])
    count = chunk.word_counts()
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(count)))[short]
        h = np.full(len(short), 1, dtype=np.uint64)
        for k in range(width - 1):
            live = count[short] > k
            h[live] = mix(h[live] + word[begin[live] + k], 100 + k)
        parts.append(mix(h, 99))
        rows.append(short)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(chunk.rows + 1, np.int64)
    h, r = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return r, h, np.searchsorted(r, np.arange(chunk.rows + 1))


def fast_sketches(row: np.ndarray, value: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """(rows, bins) coordinates of the fast similarity sketch; rows without values stay empty."""
    none = np.uint64(2**64 - 1)
    sketch = np.full(rows * bins, none, dtype=np.uint64)
    for i in range(2 * bins):
        if len(value) == 0:
            break
        h = mix(value, 1000 + i)
        bin_ = (h >> np.uint64(32)) % np.uint64(bins) if i < bins else np.full(len(h), i - bins, dtype=np.uint64)
        slot = row * bins + bin_.astype(np.int64)
        np.minimum.at(sketch, slot, np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF)))
        open_ = (sketch.reshape(rows, bins) == none).any(axis=1)
        live = open_[row]
        row, value = row[live], value[live]
    return sketch.reshape(rows, bins)


def _signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each row's set signature; 0 for an empty set."""
    full = np.flatnonzero(np.diff(bounds))
    low, high = np.zeros((2, len(bounds) - 1), np.uint64)
    if len(h):
        low[full] = np.add.reduceat(mix(h, 7), bounds[full])
        high[full] = np.bitwise_xor.reduceat(mix(h, 8), bounds[full])
    return low.view(np.int64), high.view(np.int64)


def sketch_rows(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_shingles, a 128-bit set signature and the sketch's band keys."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                row, h, bounds = shingle_sets(c, width)
                n = np.diff(bounds)
                low, high = _signatures(h, bounds)
                sketch = fast_sketches(row, h, c.rows)
                bands = np.zeros((c.rows, BINS // BAND_ROWS), dtype=np.uint64)
                for k in range(BAND_ROWS):
                    bands = mix(bands + sketch[:, k::BAND_ROWS], 50 + k)
                bands = mix(bands + np.arange(bands.shape[1], dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.first, c.rows),
                        pa.array(n, pa.int64()),
                        pa.array(low),
                        pa.array(high),
                        lists(bands.view(np.int64).ravel(), np.arange(c.rows + 1) * bands.shape[1], pa.int64()),
                    ],
                    names=["id", "n", "low", "high", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n long, low long, high long, bands array<long>"
    )


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, low, high, hashes): the whole sorted shingle sets of the (id, low, high) rows of ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                _, h, bounds = shingle_sets(c, width)
                low, high = _signatures(h, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.rows), pa.array(low), pa.array(high), lists(h.view(np.int64), bounds, pa.int64())],
                    names=["id", "low", "high", "hashes"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(wanted.select("id").distinct(), "id", "left_semi").distinct()
    sets = rows.mapInArrow(run, "id long, low long, high long, hashes array<long>")
    # texts that differ may have one set
    return sets.join(wanted, ["id", "low", "high"], "left_semi").dropDuplicates(["id", "low", "high"])


def _block_links(num: int, den: int):
    """Links between two blocks of sets as a forest: (id, root) of every linked member."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if right.empty:  # a block with itself
            right = left
        ia, ib = left.id.to_numpy(), right.id.to_numpy()
        sizes = [np.array([len(h) for h in x.hashes]) for x in (left, right)]
        flat = np.concatenate([*left.hashes, *right.hashes])
        row = np.repeat(np.arange(len(ia) + len(ib)), np.concatenate(sizes))
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        row, column = row[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(ia), len(ib)))
        width = int(column[-1]) + 1 if len(column) else 0
        for start in range(0, width, COLUMNS):
            piece = slice(*np.searchsorted(column, [start, start + COLUMNS]))
            dense = np.zeros((len(ia) + len(ib), min(COLUMNS, width - start)), dtype=np.float32)
            dense[row[piece], column[piece] - start] = 1
            common += dense[: len(ia)] @ dense[len(ia) :].T
        union = sizes[0][:, None] + sizes[1][None, :] - common
        link = (den * common >= num * union) & (ia[:, None] != ib[None, :])
        la, lb = ia.copy(), ib.copy()
        top = np.iinfo(np.int64).max
        while link.any():
            na = np.minimum(la, np.where(link, lb[None, :], top).min(axis=1))
            nb = np.minimum(lb, np.where(link, na[:, None], top).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        ra, rb = link.any(axis=1), link.any(axis=0)
        return pd.DataFrame({"id": np.concatenate((ia[ra], ib[rb])), "root": np.concatenate((la[ra], lb[rb]))})

    return run


def _frequent(wide: DataFrame) -> DataFrame:
    """(cluster, salts, frequent): the shingles that many sets of a large cluster hold, the most frequent last.

    Counted over about ``PROBE_SETS`` sets a cluster and kept from an eighth of
    these on, so a list is at most eight mean sets long. It only orders shingles:
    another list costs or saves work and changes no result.
    """
    probe = wide.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.ceil(F.col("size") / PROBE_SETS)) == 0)
    probe = probe.select("cluster", "salts", "size", F.explode("hashes").alias("token"))
    held = probe.groupBy("cluster", "salts", "size", "token").agg(F.count("*").alias("times"))
    held = held.filter(F.col("times") * 8 >= F.least(F.lit(PROBE_SETS), "size"))
    order = F.sort_array(F.collect_list(F.struct("times", "token")))
    return held.groupBy("cluster", "salts").agg(order["token"].alias("frequent"))


def _split_by_prefix(wide: DataFrame, num: int, den: int) -> DataFrame:
    """(id, part): the clusters of ``wide`` cut where no link can be.

    With the shingles in any one order, a set's prefix is all but its last
    ``t * n`` - 1; two sets that link share a shingle of their prefixes. The order
    puts the cluster's frequent shingles last, so sets that only have a frame in
    common share none, however many bands they meet in. A part is what hangs
    together by prefix shingles; sets without a shared one are in no part. Only
    prefixes become rows.
    """
    lists = materialize(_frequent(wide), "frequent")
    dealt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    lists = lists.select("cluster", dealt.alias("salt"), "frequent")
    rows = wide.withColumn("salt", F.pmod(F.xxhash64("id"), "salts"))
    rows = rows.join(lists.hint("merge"), ["cluster", "salt"], "left")
    frequent = F.coalesce("frequent", F.array().cast("array<long>"))
    order = F.concat(F.array_except("hashes", frequent), F.array_intersect(frequent, F.col("hashes")))
    n = F.size("hashes")
    prefix = F.slice(order, 1, (n - F.ceil(n * num / den) + 1).cast("int"))
    edge = rows.select("cluster", "id", F.explode(prefix).alias("token")).select("id", F.xxhash64("cluster", "token").alias("key"))
    edge = materialize(edge, "prefixes")
    least = edge.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("m")).filter("m > 1")
    links = join_to_one(edge, materialize(least, "least"), "key", "m", F.xxhash64("id", "key")).select("id", "first").distinct()
    parts = connected_components(links, "id", "first")
    return parts.select(F.col("node").alias("id"), F.col("component").alias("part"))


def _cut(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(cluster, id, hashes): ``sets`` with the clusters of more than a block cut as long as that makes them smaller.

    A cluster of several frames falls apart into them, and a frame's texts by
    their own shingles in the next round.
    """
    before = None
    while True:
        count = materialize(sets.groupBy("cluster").agg(F.count("*").alias("m")), "sizes")
        large = count.filter(F.col("m") > BLOCK_ROWS)
        # what is left to pair in large clusters; each round costs a pass over their sets
        pairs = large.agg(F.sum(F.col("m").cast("double") * F.col("m"))).first()[0] or 0
        if pairs == 0 or (before is not None and pairs > 0.5 * before):
            return sets
        before = pairs
        known = large.select("cluster", "m", F.col("m").alias("size"), F.ceil(F.col("m") / LIST_ROWS).cast("long").alias("salts"))
        wide = materialize(join_to_one(sets, known, "cluster", "m", F.xxhash64("id")), "large")
        parts = wide.select("id", "hashes").join(_split_by_prefix(wide, num, den).withColumnRenamed("part", "cluster"), "id")
        small = sets.join(large, "cluster", "left_anti").select("cluster", "id", "hashes")
        sets = materialize(small.unionByName(parts.select("cluster", "id", "hashes")), "parts")


def _confirmed(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, root): the links within clusters, by pairs of blocks of (cluster, id, hashes) rows."""
    sets = _cut(sets.select("cluster", "id", "hashes"), num, den)
    count = materialize(sets.groupBy("cluster").agg(F.count("*").alias("m")), "sizes")
    blocks = count.filter("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK_ROWS).cast("long"))
    rows = join_to_one(sets.select("cluster", "id", "hashes"), blocks, "cluster", "m", F.xxhash64("id")).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    rows = rows.select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "hashes",
    )
    return rows.groupBy("cluster", "i", "j").applyInPandas(_block_links(num, den), "id long, root long")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when ``den * |A & B| >= num * |A | B|`` on their distinct
    ``width``-word shingles; a component's least id is kept.

    Documents with equal sets form one class before any pairing, so a group of
    exact copies of any size is one row from then on. Classes that share a band
    are joined to the band's least class, and what hangs together is a cluster:
    two classes that meet in any band are in one. Clusters of more than a block
    are cut by prefixes of their sets, so that texts with a common frame don't
    all meet. Full sets are confirmed by pairs of blocks of bounded size, each a
    matrix product that yields a forest of its links; pairs are never rows.

    Null, empty and separator-only texts: n_shingles 0, their own component,
    kept. Repeated rows give repeated output rows; rows of one id with different
    texts are one document, linked to what any of them links to. A null id gets
    a null component and kept null. Other columns are ignored.
    """
    sketches = materialize(sketch_rows(docs, width, id_col, text_col), "sketches")
    filled = sketches.filter("n > 0 and id is not null").withColumn("sig", F.struct("low", "high"))
    classes = filled.groupBy("sig").agg(F.min("id").alias("cid"), F.count("*").alias("m"))
    copies = materialize(classes.filter("m > 1"), "copies")
    rows = sketches.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.struct("low", "high")).alias("sig"))
    spread = F.struct(F.xxhash64("id").alias("low"), F.xxhash64("id", F.lit(1)).alias("high"))
    member = join_to_one(rows, copies, "sig", "m", spread, outer=True)
    member = materialize(member.select("id", "n", "sig", F.coalesce("cid", "id").alias("cid")), "members")
    first = member.filter("sig is not null and id = cid").select("id", "sig.low", "sig.high").distinct()
    bands = filled.join(first, ["id", "low", "high"], "left_semi").dropDuplicates(["id", "low", "high"]).select("id", F.explode("bands").alias("band"))
    star = bands.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("m")).filter("m > 1")
    meets = join_to_one(bands, materialize(star, "star"), "band", "m", F.xxhash64("id")).filter("id > a").select("a", F.col("id").alias("b")).distinct()
    cluster = materialize(connected_components(meets, "a", "b"), "clusters").select(
        F.col("node").alias("id"), F.col("component").alias("cluster")
    )
    sets = _full_sets(docs, first.join(cluster, "id", "left_semi"), width, id_col, text_col).drop("low", "high")
    sets = materialize(sets.join(cluster, "id"), "sets")
    several = member.filter("sig is not null").groupBy("id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).filter("a < b").select("id")
    several = member.filter("sig is not null").join(several, "id", "left_semi").select("id", F.col("cid").alias("root"))
    links = materialize(_confirmed(sets, num, den).unionByName(several), "links")
    found = materialize(connected_components(links, "id", "root"), "found")
    held = member.groupBy("cid").agg(F.count("*").alias("m")).join(found, F.col("cid") == F.col("node")).select("cid", "m", "component")
    out = join_to_one(member, materialize(held, "held"), "cid", "m", F.xxhash64("id"), outer=True)
    comp = F.coalesce("component", "cid")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        comp.alias("component_id"),
        (F.col("id") == comp).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each id that :func:`near_duplicates` keeps, all columns unchanged; rows with a null id all stay.

    Of several rows of an id that of the least hash of its text stays. Only ids
    with several rows are dealt out to choose from.
    """
    key = options.get("id_col", "doc_id")
    marked = near_duplicates(docs, **options).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(~F.col("kept")).alias("_gl_lost"), F.count("*").alias("_gl_n"))
    marked = materialize(marked.filter("_gl_lost or _gl_n > 1").withColumnRenamed("doc_id", "_gl_id"), "marked")
    rest = docs.join(marked.select("_gl_id"), docs[key].cast("long") == F.col("_gl_id"), "left_anti")
    several = docs.join(marked.filter("not _gl_lost").select("_gl_id"), docs[key].cast("long") == F.col("_gl_id"))
    nth = F.row_number().over(W.partitionBy("_gl_id").orderBy(F.xxhash64(docs[options.get("text_col", "text")])))
    return rest.unionByName(several.withColumn("_gl_nth", nth).filter("_gl_nth = 1").drop("_gl_id", "_gl_nth"))

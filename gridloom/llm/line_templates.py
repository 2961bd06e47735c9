"""Line deduplication by a fixed-depth template tree.

A line's path in the tree is its token count, its leading token, then the tokens
of some blocks of its other places; tokens with a digit are a variable field
anywhere. Lines of 6 to 14 tokens have four blocks and a leaf for each two that
are kept; longer ones have three and a leaf for each one kept, so lines that
differ in any two places, or in more places of two blocks, meet in a leaf. In a
leaf the first line, by document, place and hash of the text, is the template's head. Lines that
agree with it in two thirds of their places are of its template; the places in
which any of them differs are its variable fields. The others part at the first
``SPLITS`` places in which they differ from the head, a leaf for each with its
own head, and once more below that: a line unlike the others doesn't hide them.
The lines of a leaf that are in no template after that are held against each
other, all pairs of them: one that agrees with such lines of ``min_docs``
documents in two thirds of its places recurs, however many others lie before it.
All lines also have the leaf of the whole line, for exact recurrence.

A template that occurs in ``min_docs`` documents or more is recurring, and so is
a line of 50 tokens or more that two documents hold verbatim. Its lines stay in
the first of these documents and are dropped from all others.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bytetext import Chunk, chunks, mix
from gridloom.llm.hot import join_to_one
from gridloom.llm.store import materialize, small_batches

LEAD, MIN_TOKENS, MIN_TOKENS_VARIABLE, THREE_BLOCKS, MIN_DOCS = 1, 3, 6, 15, 3
#: Share of equal places (2 of 3) that makes a line one of a template; tokens from which two documents are enough.
SAME, OF, LONG = 2, 3, 50
#: Heads on a path of the tree, and places of difference by which the lines unlike a head part; what these miss meets in pairs.
HEADS, SPLITS = 3, 3
#: Lines of a leaf that are compared at once, and pairs of tokens.
BLOCK, PAIRS = 1024, 1 << 22
_FIELD = np.uint64(0x5BD1E995A5A5A5A5)
#: Kinds of leaf, in its lowest two bits.
TEMPLATE, WHOLE, WHOLE_LONG = 0, 1, 2
_LINE = ["id", "mark", "line"]


def line_leaves(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line_no, leaf, first token, tokens) per line and leaf, and a 16-bit value per token of the chunk."""
    token = np.where(c.has_digit(), _FIELD, c.words())
    if len(token) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint16)
    breaks = np.flatnonzero(c.raw == 10)
    line_in_row = np.searchsorted(breaks, c.start) - np.searchsorted(breaks, c.offset[:-1])[c.row]
    first = np.flatnonzero(np.concatenate(([True], (c.row[1:] != c.row[:-1]) | (line_in_row[1:] != line_in_row[:-1]))))
    n = np.diff(np.append(first, len(token)))
    place = np.arange(len(token)) - np.repeat(first, n)
    part = mix(token + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
    size = np.repeat(n, n)
    blocks = np.where(size < THREE_BLOCKS, 4, 3)
    block = np.where(place < LEAD, -1, (place - LEAD) * blocks // np.maximum(size - LEAD, 1))
    of_block = [np.add.reduceat(np.where(block == b, part, np.uint64(0)), first) for b in range(-1, 4)]
    root = of_block[0] + n.astype(np.uint64)
    kinds = [(n >= MIN_TOKENS, mix(root + sum(of_block[1:]), 40), np.where(n >= LONG, WHOLE_LONG, WHOLE))]
    for a, b in itertools.combinations(range(4), 2):
        short = (n >= MIN_TOKENS_VARIABLE) & (n < THREE_BLOCKS)
        kinds.append((short, mix(root + of_block[1 + a] + of_block[1 + b], 50 + 4 * a + b), np.full(len(n), TEMPLATE)))
    for a in range(3):
        kinds.append((n >= THREE_BLOCKS, mix(root + of_block[1 + a], 45 + a), np.full(len(n), TEMPLATE)))
    at = np.concatenate([np.flatnonzero(use) for use, *_ in kinds])
    leaf = np.concatenate([(leaf & ~np.uint64(3) | kind.astype(np.uint64))[use] for use, leaf, kind in kinds])
    return c.row[first][at], line_in_row[first][at], leaf, first[at], n[at], (token >> np.uint64(48)).astype(np.uint16)


def _leaf_rows(docs: DataFrame) -> DataFrame:
    """(leaf, id), once per leaf of a document row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                row, _, leaf, *_ = line_leaves(c)
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (leaf[1:] != leaf[:-1])
                ids = batch.column(0).take(pa.array(row[new] + c.first))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[new].view(np.int64)), ids], names=["leaf", "id"])

    return docs.mapInArrow(run, "leaf long, id long")


def _line_rows(docs: DataFrame) -> DataFrame:
    """(leaf, id, mark, line, tokens) per line and leaf; no tokens for the leaf of the whole line."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                row, line, leaf, first, n, token = line_leaves(c)
                n = np.where(leaf & np.uint64(3) == TEMPLATE, n, 0)
                ends = np.cumsum(n)
                places = np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)
                at = pa.array(row + c.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(leaf.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()),
                        _binaries(token[places], np.concatenate(([0], ends)) * 2),
                    ],
                    names=["leaf", "id", "mark", "line", "tokens"],
                )

    return docs.mapInArrow(run, "leaf long, id long, mark int, line int, tokens binary")


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of the bytes of flat values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _least(min_docs: int) -> Column:
    return F.when(F.col("leaf").bitwiseAND(3) == WHOLE_LONG, min(2, min_docs)).otherwise(min_docs)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, lines): 0-based numbers of the lines to drop from a document; mark is the text's hash.

    Leaves are counted with a combine before the shuffle, in documents and not
    in lines. Lines are joined to the leaves that enough documents reach, to
    the leaf's head and to its support; hot leaves are spread each time. Lines
    in no template by then meet in blocks of a leaf.
    """
    keyed = docs.select(
        F.col(id_col).cast("long").alias("id"), F.hash(F.col(text_col).cast("string")).alias("mark"), F.col(text_col).cast("string").alias("text")
    ).withColumn("id", F.coalesce("id", F.lit(-(2**63))))
    per = _leaf_rows(keyed).groupBy("leaf").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    wanted = materialize(per.filter((F.col("n") >= _least(min_docs)) & (F.col("a") < F.col("b"))).select("leaf", "n"), "leaves")
    at = F.xxhash64("id", "line")
    hits = materialize(join_to_one(_line_rows(keyed), wanted, "leaf", "n", at), "lines")
    held, apart = None, None
    for depth in range(HEADS):
        heads = hits.groupBy("leaf").agg(F.min_by("tokens", F.struct("id", "line", "mark")).alias("head"), F.count("*").alias("n"))
        met = join_to_one(hits, materialize(heads, "heads"), "leaf", "n", at)
        places = F.sequence(F.lit(1), F.octet_length("tokens") - 1, F.lit(2))
        other = F.filter(places, lambda i: F.substring("tokens", i, 2) != F.substring("head", i, 2))
        met = met.withColumn("other", F.when(F.octet_length("tokens") > 0, other).otherwise(F.array().cast("array<int>")))
        unlike = 2 * OF * F.size("other") > (OF - SAME) * F.octet_length("tokens")
        met = materialize(met.select("leaf", *_LINE, "tokens", F.when(unlike, F.slice("other", 1, SPLITS)).alias("other")), "members")
        same = met.filter("other is null").drop("other")
        docs = same.groupBy("leaf", "id").agg(F.count("*").alias("m"))
        support = docs.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("m").alias("n"), F.min("id").alias("first"))
        support = materialize(support.select("leaf", "n", F.when(F.col("docs") >= _least(min_docs), F.col("first")).alias("first")), "support")
        alone = F.col("first").isNull()
        judged = join_to_one(same, support, "leaf", "n", at)
        judged = materialize(
            judged.select(*_LINE, F.when(alone, F.col("leaf")).alias("leaf"), F.when(alone, F.col("tokens")).alias("tokens"), (F.col("id") > F.col("first")).alias("lost")),
            "judged",
        )
        found = judged.filter("lost is not null").select(*_LINE, "lost")
        held = found if held is None else held.unionByName(found)
        rest = met.filter("other is not null")
        if depth == 0:
            few = judged.filter((F.col("leaf").bitwiseAND(3) == TEMPLATE) & F.col("lost").isNull()).select("leaf", *_LINE, "tokens")
            apart = materialize(few.unionByName(rest.select(few.columns)), "apart")
        if depth == HEADS - 1:
            break
        rest = rest.select("leaf", *_LINE, "tokens", F.explode("other").alias("i"))
        part = F.xxhash64("leaf", "i", F.substring("tokens", F.col("i"), F.lit(2))).bitwiseAND(F.lit(~3))  # a leaf of kind TEMPLATE
        rest = rest.select(part.alias("leaf"), *_LINE, "tokens")
        per = rest.groupBy("leaf").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
        wanted = materialize(per.filter((F.col("n") >= min_docs) & (F.col("a") < F.col("b"))).select("leaf", "n"), "leaves")
        if wanted.isEmpty():
            break
        hits = materialize(join_to_one(rest, wanted, "leaf", "n", at), "lines")
    known = held.join(apart.select(*_LINE).distinct(), _LINE, "left_semi").select(*_LINE).distinct()
    lost = held.filter("lost").select(*_LINE).unionByName(_agreeing(apart.join(known, _LINE, "left_anti"), min_docs))
    return lost.groupBy("id", "mark").agg(F.collect_set("line").alias("lines"))


def _agreeing(rest: DataFrame, min_docs: int) -> DataFrame:
    """(id, mark, line) of lines that agree with lines of ``min_docs`` documents of their leaf, not the first of these.

    A leaf's lines are dealt into blocks, of which each two meet in a group; leaves of one block share groups.
    """
    rest = materialize(rest, "rest")
    docs = rest.groupBy("leaf", "id").agg(F.count("*").alias("m")).groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("m").alias("n"))
    docs = docs.filter(F.col("docs") >= min_docs).select("leaf", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    wanted = materialize(docs, "leaves")
    groups = (wanted.filter("blocks = 1").agg(F.sum("n")).first()[0] or 0) // BLOCK + 1
    rows = join_to_one(rest, wanted, "leaf", "n", F.xxhash64("id", "line"))
    rows = rows.withColumn("own", F.pmod(F.hash(*_LINE), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.when(F.col("blocks") > 1, F.col("leaf")).otherwise(F.pmod(F.xxhash64("leaf"), F.lit(groups)))
    rows = rows.select(group.alias("group"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "leaf", "own", *_LINE, "tokens")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("leaf", "ascending"), ("own", "ascending"), ("id", "ascending")]).combine_chunks()
        leaf, own, ids = (rows[c].to_numpy() for c in ("leaf", "own", "id"))
        tokens = [np.frombuffer(x, np.uint16) for x in rows["tokens"].to_pylist()]
        found: list[list[int]] = [[] for _ in range(len(leaf))]
        ends = np.append(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, len(leaf))
        for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            cut = lo + int(np.searchsorted(own[lo:hi], own[lo], "right"))
            for a, b in [((lo, hi), (lo, hi))] if cut == hi else [((lo, cut), (cut, hi)), ((cut, hi), (lo, cut))]:
                _first_docs(tokens, ids, a, b, min_docs, found)
        kept = rows.select(["leaf", *_LINE])
        return kept.append_column("docs", pa.array(found, pa.list_(pa.int64())))

    met = rows.groupBy("group", "i", "j").applyInArrow(compare, "leaf long, id long, mark int, line int, docs array<long>")
    met = met.groupBy("leaf", *_LINE).agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))
    return met.filter((F.size("docs") >= min_docs) & (F.array_min("docs") < F.col("id"))).select(*_LINE)


def _first_docs(tokens: list[np.ndarray], ids: np.ndarray, a: tuple[int, int], b: tuple[int, int], most: int, found: list[list[int]]) -> None:
    """Adds to each line of ``a`` the first documents, up to ``most``, of the lines of ``b`` that agree with it; ``b`` lies in their order."""
    right = np.stack(tokens[b[0] : b[1]])
    docs, starts = np.unique(ids[b[0] : b[1]], return_index=True)
    step = max(1, PAIRS // right.size)
    for s in range(a[0], a[1], step):
        left = np.stack(tokens[s : min(s + step, a[1])])
        agree = OF * (left[:, None] == right[None]).sum(2) >= SAME * right.shape[1]
        agree = np.logical_or.reduceat(agree, starts, axis=1)
        row, doc = np.nonzero(agree & (np.cumsum(agree, axis=1) <= most))
        for r, d in zip(row.tolist(), docs[doc].tolist(), strict=True):
            found[s + r].append(d)


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with recurring lines removed from the text, and n_lines, n_dropped.

    Lines end at ``\\n``. Lines of fewer than 3 tokens never recur; those of 3 to
    5 only as they are, but for tokens with a digit. A template's first
    document, by id, keeps it; rows of one id are one document. Null and empty
    texts stay as they are (n_lines 0 and 1). Repeated rows share their
    decision. A null id is the first of all. The result has the input's columns,
    whatever they are called, and the two counts, which replace columns of
    these names.
    """
    lost = recurring_lines(docs, min_docs, id_col, text_col).select(
        F.col("id").alias("_gl_id"), F.col("mark").alias("_gl_mark"), F.col("lines").alias("_gl_lines")
    )
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    text = F.col(text_col).cast("string")
    joined = docs.join(lost, (key == F.col("_gl_id")) & (F.hash(text) == F.col("_gl_mark")), "left")
    joined = joined.withColumns({"_gl_parts": F.split(text, "\n"), "_gl_lines": F.array_sort("_gl_lines")})
    n = F.coalesce(F.size(F.when(F.col(text_col).isNotNull(), F.col("_gl_parts"))), F.lit(0))
    # the stretches between dropped lines, so that a text costs the same however many go
    before = F.concat(F.array(F.lit(-1)), "_gl_lines")
    after = F.concat("_gl_lines", F.array(F.size("_gl_parts")))
    kept = F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice("_gl_parts", a + 2, b - a - 1))), "\n")
    return (
        joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(n))
        .withColumn("n_dropped", F.when(F.col("_gl_lines").isNull(), 0).otherwise(F.size("_gl_lines")))
        .withColumn(text_col, F.when(F.col("_gl_lines").isNull(), F.col(text_col)).otherwise(kept))
        .drop("_gl_id", "_gl_mark", "_gl_lines", "_gl_parts")
    )

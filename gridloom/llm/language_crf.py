"""Language identification with a linear-chain conditional random field over words.

Each word has affix, byte n-gram and lexicon features; learned transitions tie
neighbouring words. Forward-backward gives every word's language distribution,
so code-switched text is labelled by word; a text's language is the one with the
highest mean probability over its words, and that mean is its score.

The model is fitted on a bounded sample of every labelled language: at most
``DOCS_PER_LANGUAGE`` documents each and about ``SAMPLE_DOCS`` in all (3 of each at
least), ``SPAN`` characters of each. Training sequences splice spans of different
languages, so transitions are learned. Prediction runs over all words of all
texts. Forward-backward is a scan over segments of ``SEGMENT`` words, all texts'
segments at once, so a long text takes few steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.bytetext import Chunk, chunks
from gridloom.llm.store import small_batches

DOCS_PER_LANGUAGE, SAMPLE_DOCS, SPAN, SEGMENT = 150, 9600, 3000, 128
BITS, LEXICON_SIZE, EPOCHS, SEQUENCE = 15, 20_000, 40, 40
#: Bytes of texts read at a time by up to 16 languages, fewer by more; weights of bytes held at a time.
CHUNK, SCORES = 1 << 19, 1 << 21
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    """languages, hashed feature weights (last row zero), lexicon word hashes and weights, transitions, start."""

    languages: list[str]
    weight: np.ndarray
    lexicon: np.ndarray
    lexicon_weight: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def _slots(a: np.ndarray, space: int) -> np.ndarray:
    """Feature rows of packed byte n-grams."""
    h = (a ^ np.uint32(space * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - BITS)


def features(c: Chunk) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Byte-level n-gram rows (two per byte), word-level affix rows, word hashes, whether a word has a letter."""
    none = np.uint32(1 << BITS)
    data = np.append(c.data, [32, 32, 32]).astype(np.uint32)
    n = len(c.data)
    letter = np.concatenate((_LETTER[c.data], [False, False, False]))
    two = data[:n] << np.uint32(8) | data[1 : n + 1]
    three = two << np.uint32(8) | data[2 : n + 2]
    last = np.zeros(n, dtype=bool)
    last[c.offset[1:][c.offset[1:] > 0] - 1] = True
    ok2 = letter[:n] & letter[1 : n + 1] & ~last
    ok3 = ok2 & letter[2 : n + 2]
    ok3[:-1] &= ~last[1:]
    grams = np.stack([np.where(ok2, _slots(two, 1), none), np.where(ok3, _slots(three, 2), none)])
    # affixes of the part between the outer non-letters
    start, end = c.start.copy(), c.end.copy()
    while len(start):
        move = (start < end) & ~letter[start]
        if not move.any():
            break
        start[move] += 1
    while len(start):
        move = (start < end) & ~letter[end - 1]
        if not move.any():
            break
        end[move] -= 1
    has = end > start
    affixes = []
    for k in (1, 2, 3):
        long = end - start >= k
        head, tail = np.zeros(len(start), np.uint32), np.zeros(len(start), np.uint32)
        for j in range(k):
            head = head << np.uint32(8) | data[np.minimum(start + j, n)]
            tail = tail << np.uint32(8) | data[np.maximum(end - k + j, 0)]
        affixes += [np.where(long, _slots(head, 10 + k), none), np.where(long, _slots(tail, 20 + k), none)]
    return grams, affixes, c.hashes(start, np.maximum(end, start)), has


def emissions(c: Chunk, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) scores and whether a word has a letter."""
    grams, affixes, word, has = features(c)
    if len(word) == 0:
        return np.zeros((0, len(m.languages)), np.float32), has
    k = len(m.languages)
    score = np.empty((len(word), k), np.float32)
    spot = np.minimum(np.searchsorted(m.lexicon, word), len(m.lexicon) - 1) if len(m.lexicon) else None
    # stretches of words with SCORES weights of bytes at a time, one word at least: a row of weights has as many as there are languages
    bound = np.append(c.start, len(c.data))
    at = 0
    while at < len(word):
        to = max(at + 1, int(np.searchsorted(bound, bound[at] + max(1, SCORES // k), side="right")) - 1)
        here = slice(bound[at], bound[to])
        per_byte = m.weight[grams[0][here]]
        per_byte += m.weight[grams[1][here]]
        part = np.add.reduceat(per_byte, c.start[at:to] - bound[at], axis=0)
        for rows in affixes:
            part += m.weight[rows[at:to]]
        if spot is not None:
            own = spot[at:to]
            part += np.where((m.lexicon[own] == word[at:to])[:, None], m.lexicon_weight[own], 0)
        score[at:to] = part
        at = to
    return np.where(has[:, None], score, np.float32(0)), has


def forward_backward(
    score: np.ndarray, count: np.ndarray, m: Model, transitions: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Per-word marginals of rows of words laid end to end, and on demand summed transition expectations.

    Rows are cut into segments. A segment of a row of several has a matrix, the
    product of its words' steps; these carry each row's state from segment to
    segment, forwards and backwards. Then all segments step together, longest
    first; each step is normalised.
    """
    k = score.shape[1]
    e = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
    a = np.exp(m.transition)
    pieces = -(-count // SEGMENT)
    row = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (np.cumsum(count) - count)[row] + nth * SEGMENT
    size = np.minimum(count[row] - nth * SEGMENT, SEGMENT)
    into, after = _segment_states(e, a, np.exp(m.start), pieces, nth, first, size)
    order = np.argsort(-size, kind="stable")
    begin, length = first[order], size[order]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), side="left")
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    now, last = into[order], after[order]
    for t in range(steps):
        n = alive[t]
        at = begin[:n] + t
        now = (now[:n] @ a if t else now[:n]) * e[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    expected = np.zeros((k, k))
    back = last
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        more = alive[t + 1] if t + 1 < steps else 0
        b = last[:n].copy()
        if more:
            ahead = e[at[:more] + 1] * back[:more]
            ahead /= ahead.sum(axis=1, keepdims=True)
            b[:more] = ahead @ a.T
        beta[at] = b
        back = b
    gamma = alpha * beta
    if len(gamma):
        gamma /= gamma.sum(axis=1, keepdims=True)
    if transitions and len(score):
        inner = np.ones(len(score), dtype=bool)
        inner[(np.cumsum(count) - 1)[count > 0]] = False
        i = np.flatnonzero(inner)
        ahead = e[i + 1] * beta[i + 1]
        whole = ((alpha[i] @ a) * ahead).sum(axis=1, keepdims=True)
        expected = a * ((alpha[i] / whole).T @ ahead)
    return gamma, expected


def _segment_states(
    e: np.ndarray, a: np.ndarray, start: np.ndarray, pieces: np.ndarray, nth: np.ndarray, first: np.ndarray, size: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per segment: the state before its first word, and what follows its last word weighs from each language."""
    k = e.shape[1]
    into = np.tile(start, (len(first), 1)).astype(e.dtype)
    after = np.ones((len(first), k), dtype=e.dtype)
    several = np.flatnonzero(np.repeat(pieces, pieces) > 1)
    if len(several) == 0:
        return into, after
    whole = np.zeros((len(several), k, k), dtype=e.dtype)
    whole[:, np.arange(k), np.arange(k)] = e[first[several]]
    for t in range(1, int(size[several].max())):
        use = np.flatnonzero(size[several] > t)
        step = (whole[use] @ a) * e[first[several][use] + t][:, None, :]
        whole[use] = step / step.max(axis=(1, 2), keepdims=True)
    matrix = np.zeros((len(first), k, k), dtype=e.dtype)
    matrix[several] = whole
    head = np.cumsum(pieces) - pieces
    for j in range(1, int(pieces.max())):
        here = head[pieces > j] + j
        now = np.einsum("ij,ijk->ik", into[here - 1], matrix[here - 1]) @ a
        into[here] = now / now.sum(axis=1, keepdims=True)
    for j in range(int(pieces.max()) - 1, 0, -1):
        here = head[pieces > j] + j
        now = np.einsum("ijk,ik->ij", matrix[here], after[here]) @ a.T
        after[here - 1] = now / now.sum(axis=1, keepdims=True)
    return into, after


def training_sample(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """(lang, text) spans of the bounded sample, the same on every run: documents in hash order of their id."""
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    base = base.filter("lang is not null and text is not null and id is not null").filter(F.rlike("text", F.lit(r"\p{L}")))
    langs = base.select("lang").distinct().count()
    most = max(3, min(DOCS_PER_LANGUAGE, SAMPLE_DOCS // max(langs, 1)))
    h = F.xxhash64("id")
    begin = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.length("text") - SPAN, F.lit(1)))
    span = base.select("lang", h.alias("h"), "id", F.substring("text", (begin + 1).cast("int"), F.lit(SPAN)).alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "id", "text"))
    chosen = span.withColumn("r", rank).filter(F.col("r") <= most)
    rows = chosen.toPandas()
    return rows.sort_values(["lang", "h", "id", "text"])[["lang", "text"]].reset_index(drop=True)


def fit(sample: pd.DataFrame, seed: int = 0, epochs: int = EPOCHS) -> Model:
    """Maximum likelihood with an L2 penalty by Adagrad over spliced sequences of the sample."""
    languages = sorted(sample.lang.unique())
    k = len(languages)
    zero = np.zeros((0, k), np.float32)
    if k == 0:
        return Model([], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0, np.uint64), zero, np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    pools = []
    for lang in languages:
        pools.append([" ".join(t.split()) for t in sample.text[sample.lang == lang]])
    texts, labels = [], []
    for _ in range(60 * k + 600):
        words, tags = [], []
        while len(words) < SEQUENCE:
            y = int(rng.integers(k))
            pool = pools[y][int(rng.integers(len(pools[y])))].split(" ")
            size = int(rng.integers(5, SEQUENCE + 1))
            at = int(rng.integers(max(1, len(pool) - size)))
            words += pool[at : at + size]
            tags += [y] * len(pool[at : at + size])
        texts.append(" ".join(words[:SEQUENCE]))
        labels += tags[:SEQUENCE]
    c = next(chunks(pa.array(texts), 2**40))
    y = np.array(labels)
    count = c.word_counts()
    grams, affixes, word, has = features(c)
    seen, times = np.unique(word[has], return_counts=True)
    keep = np.sort(seen[np.argsort(-times, kind="stable")[:LEXICON_SIZE]][: (times >= 2).sum()])
    m = Model(languages, np.zeros(((1 << BITS) + 1, k), np.float32), keep, np.zeros((len(keep), k), np.float32), np.zeros((k, k)), np.zeros(k))
    byte_word = np.repeat(np.arange(len(c.start)), np.diff(np.append(c.start, len(c.data))))
    slot = np.concatenate([grams[0], grams[1], *affixes])
    owner = np.concatenate([byte_word, byte_word, *([np.arange(len(word))] * len(affixes))])
    real = (slot < 1 << BITS) & has[owner]
    slot, owner = slot[real].astype(np.int64), owner[real]
    spot = np.minimum(np.searchsorted(keep, word), max(len(keep) - 1, 0))
    known = np.flatnonzero((keep[spot] == word) & has) if len(keep) else np.zeros(0, np.int64)
    gold = np.eye(k)[y]
    start_at = np.cumsum(count) - count
    inner = np.ones(len(y), dtype=bool)
    inner[np.cumsum(count) - 1] = False
    i = np.flatnonzero(inner)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[i], y[i + 1]), 1)
    memory = [np.full(x.shape, 1e-6) for x in (m.weight, m.lexicon_weight, m.transition, m.start)]

    def step(x: np.ndarray, g: np.ndarray, mem: np.ndarray, rate: float) -> None:
        mem += g * g
        x += (rate * g / np.sqrt(mem)).astype(x.dtype)

    for _ in range(epochs):
        score, _ = emissions(c, m)
        gamma, pairs = forward_backward(score.astype(np.float64), count, m, transitions=True)
        diff = gold - gamma
        g = np.stack([np.bincount(slot, diff[owner, j], minlength=(1 << BITS) + 1) for j in range(k)], axis=1)
        step(m.weight, g - 0.02 * m.weight, memory[0], 0.1)
        m.weight[-1] = 0
        if len(keep):
            g = np.stack([np.bincount(spot[known], diff[known, j], minlength=len(keep)) for j in range(k)], axis=1)
            step(m.lexicon_weight, g - 0.02 * m.lexicon_weight, memory[1], 0.1)
        step(m.transition, gold_pairs - pairs - 0.02 * m.transition, memory[2], 0.1)
        step(m.start, diff[start_at].sum(axis=0) - 0.02 * m.start, memory[3], 0.1)
    return m


def label_texts(c: Chunk, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(language index or -1, score) of each row of a chunk."""
    best, score = np.full(c.rows, -1), np.zeros(c.rows)
    if not m.languages or len(c.start) == 0:
        return best, score
    e, has = emissions(c, m)
    gamma, _ = forward_backward(e, c.word_counts(), _plain(m))
    use = has if has.any() else np.ones(len(has), dtype=bool)
    total = np.stack([np.bincount(c.row[use], gamma[use, j], minlength=c.rows) for j in range(len(m.languages))], axis=1)
    n = np.bincount(c.row[use], minlength=c.rows)
    some = n > 0
    best[some] = total[some].argmax(axis=1)
    score[some] = np.clip(total[some].max(axis=1) / n[some], 0, 1)
    return best, score


def _plain(m: Model) -> Model:
    return Model(m.languages, m.weight, m.lexicon, m.lexicon_weight, m.transition.astype(np.float32), m.start.astype(np.float32))


def _predict(m, batch: pa.RecordBatch, text: pa.Array, letter: pa.Array) -> tuple[pa.Array, pa.Array]:
    names = np.array([*m.languages, UNDETERMINED], dtype=object)
    best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
    for c in chunks(text, max(1 << 16, CHUNK * 16 // max(16, len(m.languages)))):
        best[c.first : c.first + c.rows], score[c.first : c.first + c.rows] = label_texts(c, m)
    there = letter.fill_null(False).to_numpy(zero_copy_only=False)
    best[~there], score[~there] = -1, 0
    return pa.array(names[best], pa.string()), pa.array(score)


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1).

    Null texts, texts without a letter and, for a model without languages, all
    texts: ``und`` with score 0. Repeated rows give repeated rows; other columns
    are ignored. The model's size is fixed by the sample's bounds, so it is sent
    to every task.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = _predict(shared.value, batch, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, score], names=["doc_id", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.rlike(text, F.lit(r"\p{L}")).alias("l"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language at score ``least`` or more, in their own columns, without a shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = _predict(shared.value, batch, batch.column(n), batch.column(n + 1))
            good = (np.asarray(score) >= least) & (np.asarray(lang, dtype=object) != UNDETERMINED)
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n]).filter(pa.array(good))

    text = docs[text_col].cast("string")
    wide = docs.select(*(docs[f"`{c}`"] for c in docs.columns), text.alias("_gl_text"), F.rlike(text, F.lit(r"\p{L}")).alias("_gl_letter"))
    return wide.mapInArrow(run, docs.schema)

"""Language-model scoring with a weighted backoff automaton over words.

States are the contexts of up to ``ORDER`` - 1 words that training holds, and a
root. A state's arcs are the n-grams that begin with its context; its failure
arc leads to the context without its first word. Smoothing is by a Dirichlet
prior at each order (MacKay and Peto, 1995): with u the context and u' the
shorter one, P(w|u) = (c(uw) + m P(w|u')) / (c(u) + m). An arc weighs log10 of
that; a failure arc log10 of m / (c(u) + m), which is what P(w|u) / P(w|u') comes
to where uw wasn't seen. So the probabilities of each state add up to 1. The
root has an arc for every word, weighted by the additive unigram estimate. A
text is read left to right: the state is the longest known context, failure arcs
are taken until there is an arc, and the weights add up.

The model is as large as the corpus and is never gathered in one place. Texts
are cut into blocks. A block asks for the counts of its distinct n-grams, one
packed request per order and hash range; a range's task adds up the requests of
all blocks and answers each; the block's task builds the states and arcs that
its texts can use from the answers and reads them, carrying a state for each. What moves is the texts once, compressed, and a few bytes per distinct
n-gram of a block. Words have 64-bit keys, longer n-grams ``SPARE_BITS`` more bits
than the corpus needs to count its bytes: about one n-gram in 2**SPARE_BITS
shares its key, whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bytetext import Chunk, chunks, mix
from gridloom.llm.store import materialize, small_batches

ORDER = 3
#: Prior mass m of the orders from 2 on; spare bits of n-gram keys.
PRIOR, SPARE_BITS = (4.0, 4.0), 20
#: Bytes of text a block, blocks a hash range at least and at most: the more blocks, the fewer ranges to a block. Tokens read in one go.
BLOCK_BYTES, BLOCKS_PER_RANGE, MOST_BLOCKS_PER_RANGE, STRETCH = 4 << 20, 2, 16, 512
_END, _BEGIN = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of integers, compressed: zero planes vanish."""
    if len(values) == 0:
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if n == 0:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).ravel()


def training_part(doc_id: Column, folds: int = 10) -> Column:
    """True for documents to learn from: crc32 of the id as text modulo ``folds`` is not 0 (null ids are learnt from)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) != 0, F.lit(True))


def text_blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """(block, ids, train, bounds, size, tokens, data), tokens those of training texts: about ``BLOCK_BYTES`` of texts a row, one text at least."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = tokens = 0

        def block() -> pa.RecordBatch:
            raw = np.concatenate([h[2] for h in held])
            lengths = np.concatenate([h[3] for h in held])
            data = pa.compress(raw.tobytes(), codec="zstd", asbytes=True) if len(raw) else b""
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part * 2**32 + seq], pa.int64()),
                    pa.array([[x for h in held for x in h[0]]], pa.list_(pa.int64())),
                    pa.array([[x for h in held for x in h[1]]], pa.list_(pa.bool_())),
                    pa.array([np.concatenate(([0], np.cumsum(lengths)))], pa.list_(pa.int64())),
                    pa.array([len(raw)], pa.int64()),
                    pa.array([tokens], pa.int64()),
                    pa.array([data], pa.binary()),
                ],
                names=["block", "ids", "train", "bounds", "size", "tokens", "data"],
            )

        for batch in batches:
            ids, learn = batch.column(0), batch.column(1)
            for c in chunks(batch.column(2)):
                part_of = learn.slice(c.first, c.rows).to_pylist()
                held.append((ids.slice(c.first, c.rows).to_pylist(), part_of, c.raw.copy(), np.diff(c.offset)))
                size += len(c.raw)
                tokens += int((c.word_counts() + 1)[np.array(part_of, bool)].sum())
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size, tokens, seq = [], 0, 0, seq + 1
        if held:
            yield block()

    rows = docs.select(F.col(id_col).cast("long"), train.alias("train"), F.col(text_col).cast("string"))
    return rows.mapInArrow(
        run, "block long, ids array<long>, train array<boolean>, bounds array<long>, size long, tokens long, data binary"
    )


class _Read:
    """A block's tokens: per token its document, and per order the block's sorted distinct n-gram keys and each token's among them."""

    def __init__(self, train: np.ndarray, bounds: np.ndarray, size: int, data: bytes, width: int) -> None:
        raw = np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
        words, rows = [], []
        first = 0
        while first < len(bounds) - 1:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + (1 << 20), side="right")) - 1)
            c = Chunk(first, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            words.append(c.words())
            rows.append(c.row + first)
            first = last
        docs = len(bounds) - 1
        word, row = np.concatenate(words), np.concatenate(rows)
        self.n_tokens = np.bincount(row, minlength=docs) + 1
        ends = np.cumsum(self.n_tokens) - 1
        self.doc = np.repeat(np.arange(docs), self.n_tokens)
        #: place of each token in its text, from 0
        self.place = np.arange(len(self.doc)) - np.repeat(ends - self.n_tokens + 1, self.n_tokens)
        token = np.empty(len(self.doc), np.uint64)
        is_end = np.zeros(len(self.doc), bool)
        is_end[ends] = True
        token[is_end], token[~is_end] = _END, word
        self.learn = np.asarray(train, bool)[self.doc]
        #: per order: sorted distinct keys, index of each token's key (-1: the n-gram would begin before the text), training count here
        self.keys, self.at, self.local = [], [], []
        gram = token
        for k in range(ORDER):
            if k:  # the n-gram is the one ending before, and this word; a text is preceded by one begin mark
                before = np.concatenate((token[:1], gram[:-1]))
                before = np.where(self.place == 0, _BEGIN, before) if k == 1 else before
                gram = mix(token + mix(before, 9 + k), 20 + k)
            use = self.place >= k - 1
            key = gram[use] >> np.uint64(0 if k == 0 else 64 - width)
            distinct, inverse = np.unique(key, return_inverse=True)
            at = np.full(len(gram), -1)
            at[use] = inverse
            self.keys.append(distinct)
            self.at.append(at)
            self.local.append(np.bincount(inverse[self.learn[use]], minlength=len(distinct)).astype(np.uint32))


def _requests(blocks: DataFrame, bits: int, width: int) -> DataFrame:
    """(kind, range, block, n, keys, counts): kind is the order less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                t = _Read(r["train"], np.array(r["bounds"]), r["size"], r["data"], width)
                out: list[tuple] = []
                for kind, (keys, local) in enumerate(zip(t.keys, t.local, strict=True)):
                    shift = np.uint64((width if kind else 64) - bits)
                    cut = np.searchsorted(keys >> shift, np.arange(2**bits + 1, dtype=np.uint64))
                    for s in np.flatnonzero(np.diff(cut)):
                        part = keys[cut[s] : cut[s + 1]]
                        out.append((kind, s, r["block"], len(part), _pack(np.diff(part, prepend=np.uint64(0))), _pack(local[cut[s] : cut[s + 1]])))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)],
                    names=["kind", "range", "block", "n", "keys", "counts"],
                )

    return blocks.mapInArrow(run, "kind int, range int, block long, n long, keys binary, counts binary")


def _answers(requests: DataFrame, tasks: int) -> DataFrame:
    """(kind, range, block, n, totals, distinct): per request its keys' training totals; the range's keys seen in training, in one of its rows."""

    def run(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        sides = {}
        for name, kind in (("keys", np.uint64), ("counts", np.uint32)):
            sides[name] = [_unpack(x.as_py(), int(k), kind) for x, k in zip(table[name], n, strict=True)]
        keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k in sides["keys"]])
        counts = np.concatenate(sides["counts"])
        distinct, inverse = np.unique(keys, return_inverse=True)
        del keys, sides
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
        ends = np.cumsum(n)
        totals = [_pack(total[inverse[b - k : b]]) for b, k in zip(ends, n, strict=True)]
        seen = np.zeros(len(n), np.int64)
        seen[0] = (total > 0).sum()
        kept = table.select(["kind", "range", "block", "n"])
        return kept.append_column("totals", pa.array(totals, pa.binary())).append_column("distinct", pa.array(seen))

    return requests.repartition(tasks, "kind", "range").groupBy("kind", "range").applyInArrow(
        run, "kind int, range int, block long, n long, totals binary, distinct long"
    )


class Automaton:
    """The states and arcs that a block's texts can use.

    States are the root (0), the begin of a text (1), the block's words and its
    pairs of words, each known if training holds it. An arc leads from a state
    by a word to the longest known context that ends there; a failure arc leads
    to the state without its first word. Arcs are sorted by state and word.
    """

    def __init__(self, t: _Read, total: list[np.ndarray], tokens: int, vocabulary: int, sequences: int) -> None:
        self.words = words = len(t.keys[0])
        self.root = np.log10((total[0] + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        size = np.concatenate(([0.0, sequences], total[0], total[1]))
        pair, self.known = 2 + words, size > 0
        word, at = t.at[0], [t.at[1], t.at[2]]
        # a token at which each n-gram ends
        end = [np.zeros(len(k), np.int64) for k in t.keys]
        for k in range(ORDER):
            use = np.flatnonzero(t.at[k] >= 0)
            end[k][t.at[k][use]] = use
        longest = lambda state, shorter: np.where(self.known[state], state, np.where(self.known[shorter], shorter, 0))
        prior = np.where(np.arange(len(size)) < pair, PRIOR[0], PRIOR[1])
        self.fail = np.zeros(len(size), np.int64)
        self.fail[pair:] = longest(2 + word[end[1]], 0)
        self.fail_weight = np.log10(prior / (size + prior))
        # arcs of two words: from the first, or the begin of a text
        e = end[1]
        source = np.where(t.place[e] == 0, 1, 2 + word[np.maximum(e - 1, 0)])
        plain = self.root[word[e]]
        seen = np.log10((total[1] + prior[source] * 10.0**plain) / (size[source] + prior[source]))
        # what a word weighs from the shorter context, with or without an arc
        lower = np.where(self.known[source], np.where(total[1] > 0, seen, self.fail_weight[source] + plain), plain)
        two = np.flatnonzero((total[1] > 0) & self.known[source])
        # arcs of three words: from a pair
        e3 = end[2]
        source3 = pair + at[0][np.maximum(e3 - 1, 0)]
        own = at[0][e3]
        seen3 = np.log10((total[2] + prior[source3] * 10.0 ** lower[own]) / (size[source3] + prior[source3])) if len(e3) else np.zeros(0)
        three = np.flatnonzero((total[2] > 0) & self.known[source3]) if len(e3) else np.zeros(0, np.int64)
        key = np.concatenate((source[two] * words + word[e[two]], source3[three] * words + word[e3[three]]))
        weight = np.concatenate((seen[two], seen3[three]))
        target = np.concatenate((pair + two, longest(pair + own[three], 2 + word[e3[three]])))
        order = np.argsort(key)
        self.key, self.weight, self.target = key[order], weight[order], target[order]
        self._pair, self._longest = pair, longest

    def start(self, t: _Read, first: np.ndarray) -> np.ndarray:
        """The state before the given tokens: the longest known context."""
        before = np.maximum(first - 1, 0)
        inside = self._longest(self._pair + t.at[1][before], 2 + t.at[0][before])
        return np.where(t.place[first] == 0, np.where(self.known[1], 1, 0), inside)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, state) after reading a word in each state: failure arcs until there is an arc, at the root for every word."""
        weight, arc = np.zeros(len(state)), np.full(len(state), -1)
        open_ = np.flatnonzero(state > 0) if len(self.key) else np.zeros(0, np.int64)
        if not len(self.key):
            while (state > 0).any():
                weight, state = weight + np.where(state > 0, self.fail_weight[state], 0.0), self.fail[state]
        state = state.copy()
        while len(open_):
            want = state[open_] * self.words + word[open_]
            spot = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[spot] == want
            arc[open_[hit]] = spot[hit]
            open_ = open_[~hit]
            weight[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
            open_ = open_[state[open_] > 0]
        found = arc >= 0
        at_root = ~found
        weight[found] += self.weight[arc[found]]
        weight[at_root] += self.root[word[at_root]]
        state[found] = self.target[arc[found]]
        state[at_root] = np.where(self.known[2 + word[at_root]], 2 + word[at_root], 0)
        return weight, state

    def read(self, t: _Read) -> np.ndarray:
        """Each token's weight: all texts are read left to right side by side, long ones in stretches that begin in their state."""
        n = len(t.doc)
        first = np.flatnonzero(t.place % STRETCH == 0)
        length = np.diff(np.append(first, n))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        state, out, word = self.start(t, first), np.zeros(n), t.at[0]
        for k in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -k, side="left"))  # those of more than k tokens
            at = first[:live] + k
            out[at], state[:live] = self.step(state[:live], word[at])
        return out


def _walk(tokens: int, vocabulary: int, sequences: int, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, out = right.to_pylist(), []
        for r in left.to_pylist():
            t = _Read(r["train"], np.array(r["bounds"]), r["size"], r["data"], width)
            total = []
            for kind in range(ORDER):
                rows = sorted((a for a in answers if a["kind"] == kind), key=lambda a: a["range"])
                total.append(np.concatenate([np.zeros(0, np.uint64), *(_unpack(a["totals"], a["n"], np.uint64) for a in rows)]).astype(np.float64))
            model = Automaton(t, total, tokens, vocabulary, sequences)
            per = lambda x: np.bincount(t.doc, weights=x, minlength=len(t.n_tokens))  # noqa: B023, E731
            out.append(pa.table({
                "doc_id": pa.array(r["ids"], pa.int64()),
                "train": pa.array(r["train"], pa.bool_()),
                "n_tokens": pa.array(t.n_tokens, pa.int64()),
                "n_known": pa.array(per(total[0][t.at[0]] > 0).astype(np.int64)),
                "base_score": pa.array(per(model.root[t.at[0]])),
                "score": pa.array(per(model.read(t))),
            }))
        return pa.concat_tables(out) if out else None

    return run


def score_documents(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` marks the rows to learn from (:func:`training_part` of the id by
    default); score is the sum of the automaton's weights, the log10 probability
    of the text, base_score that of the root alone. Null and empty texts are the
    end token alone. Repeated rows give repeated rows and count as often. With
    nothing to learn from, both scores are those of the uniform root. Other
    columns are ignored.
    """
    learn = training_part(F.col(id_col)) if train is None else train
    blocks = materialize(text_blocks(docs, id_col, text_col, learn), "blocks")
    n_blocks, tokens, size = blocks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    sequences = blocks.agg(F.coalesce(F.sum(F.size(F.filter("train", lambda t: t))), F.lit(0))).first()[0]
    per_range = min(MOST_BLOCKS_PER_RANGE, max(BLOCKS_PER_RANGE, np.sqrt(n_blocks) / 8))
    bits = max(4, int(np.ceil(np.log2(max(1, n_blocks / per_range)))))
    width = min(64, int(np.ceil(np.log2(size + 2 * n_blocks + 2))) + SPARE_BITS)
    answers = materialize(_answers(_requests(blocks, bits, width), ORDER * 2**bits), "answers")
    vocabulary = answers.filter("kind = 0").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    tasks = max(1, n_blocks)
    scored = blocks.repartition(tasks, "block").groupBy("block").cogroup(
        answers.drop("distinct").repartition(tasks, "block").groupBy("block")
    ).applyInArrow(
        _walk(tokens, vocabulary, sequences, width),
        "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )

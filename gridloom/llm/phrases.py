"""Phrase collocations: an FM-index per shard over word ids, extended word by word, counts summed across shards.

Texts become shards of word ids, with a stop between pieces. A shard's index is
bidirectional: the Burrows-Wheeler transforms of its text and of the reversed
text, sorted as deep as the longest phrase. A phrase is a pair of intervals, one
in each. Extending all phrases of a length by a word on the right is one sort of
the words that stand in their reverse intervals; it gives each extension's count
and both its intervals. An extension's phrase without its first word is found
by stepping from its forward interval, so extensions whose first or last words
are not frequent as a phrase go no further.

Levels alternate: shards count the extensions of phrases that are frequent in
the whole corpus, in packed lists by hash bucket; buckets add up the lists of all
shards and answer each with what is frequent. So every count is exact, nothing
is pruned by what a shard alone has seen, and no dictionary is broadcast.
Lists are never shorter than 8 extensions on average, whatever the number of
shards, and no list or answer depends on one key's frequency.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.bytetext import LOWER, mix
from gridloom.llm.store import materialize, small_batches

#: Bytes of text in a shard; extensions added up at a time; extensions in a list, at least.
SHARD_BYTES, BUCKET_ENTRIES, LIST_ENTRIES = 8 << 20, 2_000_000, 8
STOPS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_STOP = re.compile(b"[" + re.escape(STOPS) + b"]")
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(STOPS)] = 2


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes, all lowest bytes first, so that what they share lies together."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def _order(key: np.ndarray, limit: int) -> np.ndarray:
    """Stable order of whole numbers from 0 below ``limit``: sorted with their places in their lowest bits where 64 have room, which NumPy does much faster."""
    bits = max(1, len(key) - 1).bit_length()
    if limit - 1 >= 1 << (64 - bits):
        return np.argsort(key, kind="stable")
    packed = key.astype(np.uint64)
    packed <<= np.uint64(bits)
    packed |= np.arange(len(key), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << bits) - 1)
    return packed.view(np.int64)


def _pair_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Stable order by ``first``, then ``second``, whole numbers from 0."""
    base = int(second.max(initial=0)) + 1
    limit = (int(first.max(initial=0)) + 1) * base
    return _order(first * base + second, limit) if limit < 1 << 63 else np.lexsort((second, first))


def _sorted_bwt(text: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each position, positions ordered by ``depth`` symbols or more, the text read as a ring."""
    rank, reach = text, 1
    while True:
        following = np.roll(rank, -reach)
        base = int(following.max(initial=0)) + 1
        key = rank * base + following
        del rank, following
        order = _order(key, base * base)
        reach *= 2
        if reach >= depth:
            return text[order - 1].astype(np.int32)
        steps = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(len(text), np.int64)
        rank[order] = steps


class BidirectionalIndex:
    """FM-index of a ring of symbols, 0 being the stop, for phrases of up to ``depth`` symbols.

    ``text`` must hold a stop. Phrases are three arrays: where their interval
    begins in the forward and in the reverse order, and its size.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.size = np.bincount(text, minlength=1)
        self.first = np.cumsum(self.size) - self.size
        #: row of the suffix that follows, of each row of the forward order
        self.following = _order(_sorted_bwt(text, depth), len(self.size)).astype(np.int32)
        self.next_word = _sorted_bwt(text[::-1], depth)
        rows = _order(self.next_word, len(self.size))
        #: row of the reverse order that a step by its next word leads to
        self.step = np.empty(len(rows), np.int32)
        self.step[rows] = np.arange(len(rows))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol but the stop, in order."""
        return self.first[1:], self.first[1:], self.size[1:]

    def extend(self, forward: np.ndarray, reverse: np.ndarray, size: np.ndarray):
        """All one-word extensions to the right whose own last words are among the given phrases.

        Returns phrase (position among the given ones), word, and the three
        arrays of the extensions. Phrases must be of one length.
        """
        begin = np.cumsum(size) - size
        phrase = np.repeat(np.arange(len(size)), size)
        row = np.arange(len(phrase)) - begin[phrase] + reverse[phrase]
        word = self.next_word[row]
        key = phrase * len(self.size) + word  # whole numbers of 64 bits, as phrase is
        order = _order(key, len(size) * len(self.size))
        edge = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(key)))
        lead = order[edge]
        del key, order
        phrase, word, found = phrase[lead], word[lead], row[lead]
        ahead = forward[phrase] + edge - begin[phrase]  # words that sort before, the stop first, fill the interval's start
        known = np.zeros(len(self.step), dtype=bool)
        known[np.repeat(forward, size) + np.arange(size.sum()) - np.repeat(begin, size)] = True
        keep = word > 0
        keep[keep] = known[self.following[ahead[keep]]]
        return phrase[keep], word[keep], ahead[keep], self.step[found[keep]], count[keep]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str | None]]]:
    """Texts with their languages, some SHARD_BYTES at a time; longer ones are cut after a stop."""
    texts, langs, held = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, at = text.encode(), 0
            while at < len(data):
                stop = _STOP.search(data, at + SHARD_BYTES) if len(data) - at > SHARD_BYTES else None
                end = stop.end() if stop else len(data)
                texts.append(data[at:end])
                langs.append(lang)
                held += end - at
                at = end
                if held >= SHARD_BYTES:
                    yield texts, langs
                    texts, langs, held = [], [], 0
    if texts:
        yield texts, langs


def _shard(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Word ids from 1 with 0 for stops, and each id's language, word and count."""
    raw = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = _KIND[raw]
    inside = np.concatenate(([False], kind == 0, [False]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turn[::2], turn[1::2]
    if len(start) == 0:
        return np.zeros(1, np.int64), pa.array([], pa.string()), pa.array([], pa.string()), np.zeros(0, np.int64)
    piece = np.cumsum(kind == 2, dtype=np.int64)[start]
    ends = np.cumsum([len(t) + 1 for t in texts])
    names = pa.array(langs, pa.string()).dictionary_encode()
    lang = names.indices.to_numpy()[np.searchsorted(ends, start, side="right")].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw[kind == 0])])
    words = words.dictionary_encode()
    pair = words.indices.to_numpy().astype(np.int64) * len(names.dictionary) + lang
    order = _order(pair, len(words.dictionary) * len(names.dictionary))
    fresh = np.concatenate(([True], np.diff(pair[order]) != 0))
    known, count = pair[order[fresh]], np.diff(np.append(np.flatnonzero(fresh), len(pair)))
    own = np.empty(len(pair), np.int64)
    own[order] = np.cumsum(fresh) - 1
    often = np.argsort(-count, kind="stable")  # small ids for frequent words pack well
    place = np.empty(len(known), np.int64)
    place[often] = np.arange(1, len(known) + 1)
    fresh = np.concatenate(([False], np.diff(piece) != 0))
    text = np.zeros(len(own) + int(fresh.sum()) + 1, np.int64)
    text[np.arange(len(own)) + np.cumsum(fresh)] = place[own]
    known, count = known[often], count[often]
    langs_ = names.dictionary.take(pa.array(known % len(names.dictionary)))
    return text, langs_, words.dictionary.take(pa.array(known // len(names.dictionary))).cast(pa.string()), count


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for k, (texts, langs) in enumerate(_parts(batches)):
        text, lang, word, count = _shard(texts, langs)
        n = len(word)
        words = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.StructArray.from_arrays([lang, word, pa.array(count)], names=["lang", "word", "n"]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([(task << 24) + k]), pa.array([len(text)]), pa.array([pack(text)], pa.binary()), words], names=["shard", "size", "text", "words"]
        )


def _frequent_text(text: np.ndarray, word: np.ndarray, wid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with its rare words as stops, no two stops in a row, and the corpus's id of each of its new ids."""
    order = np.argsort(word)
    word, wid = word[order], wid[order]
    place = np.zeros(int(max(text.max(initial=0), word.max(initial=0))) + 1, np.int64)
    place[word] = np.arange(1, len(word) + 1)
    text = place[text]
    text = text[(text > 0) | (np.concatenate(([1], text[:-1])) > 0)]
    return np.append(text, 0), np.concatenate(([0], wid))


def _listed(index: BidirectionalIndex, wid: np.ndarray, answers: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]], level: int, buckets: int):
    """Per bucket, the extensions to ``level`` words (pid, wid, count) of the shard's frequent phrases.

    ``answers`` hold per level and bucket which of that level's list are
    frequent, and their ids; lists are made in the same order each time.
    """
    spans, ids = index.words(), wid[1:]
    for now in range(2, level + 1):
        phrase, word, *spans = index.extend(*spans)
        pid, last = ids[phrase], wid[word]
        bucket = (mix(pid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(last.astype(np.uint64)), now) % np.uint64(buckets)).astype(np.int64)
        order = _pair_order(pid, last)
        order = order[_order(bucket[order], buckets)]
        edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0))) if len(order) else np.zeros(0, np.int64)
        groups = zip(bucket[order[edge]].tolist(), np.split(order, edge[1:]) if len(order) else [], strict=True)
        if now == level:
            return [(b, pid[g], last[g], spans[2][g]) for b, g in groups]
        kept, named = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b, g in groups:
            if b in answers.get(now, {}):
                place, gid = answers[now][b]
                kept.append(g[place])
                named.append(gid)
        kept, named = np.concatenate(kept), np.concatenate(named)
        order = np.argsort(spans[1][kept])
        kept, ids = kept[order], named[order]
        spans = [s[kept] for s in spans]
    return []


LISTS = "shard long, size long, bucket long, text binary, ids binary, pids binary, wids binary, counts binary"
_LISTS = pa.schema({"shard": pa.int64(), "size": pa.int64(), "bucket": pa.int64(), "text": pa.binary(), "ids": pa.binary(), "pids": pa.binary(), "wids": pa.binary(), "counts": pa.binary()})


def _rows(shard: int, lists, text: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Table:
    rows = [{"shard": shard, "size": len(text[0]), "text": pack(text[0]), "ids": pack(text[1])}] if text else []
    rows += [{"shard": shard, "size": len(p), "bucket": b, "pids": pack(p), "wids": pack(w), "counts": pack(c)} for b, p, w, c in lists]
    return pa.Table.from_pylist(rows, schema=_LISTS)


def _index_shards(depth: int, buckets: int):
    """A shard's text of frequent words and its lists of two words."""

    def run(key: tuple, shard: pa.Table, words: pa.Table) -> pa.Table:
        if shard.num_rows == 0 or words.num_rows == 0:
            return _rows(key[0].as_py(), [])
        text, wid = _frequent_text(unpack(shard["text"][0].as_py()), words["place"].to_numpy(), words["wid"].to_numpy())
        return _rows(key[0].as_py(), _listed(BidirectionalIndex(text, depth), wid, {}, 2, buckets), (text, wid))

    return run


def _extend_shards(depth: int, level: int, buckets: int):
    """A shard's lists of ``level`` words, by the answers to all shorter ones."""

    def run(key: tuple, shard: pa.Table, answers: pa.Table) -> pa.Table:
        if shard.num_rows == 0 or answers.num_rows == 0:
            return _rows(key[0].as_py(), [])
        known: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        for r in answers.to_pylist():
            known.setdefault(r["level"], {})[r["bucket"]] = unpack(r["places"]), unpack(r["gids"])
        index = BidirectionalIndex(unpack(shard["text"][0].as_py()), depth)
        return _rows(key[0].as_py(), _listed(index, unpack(shard["ids"][0].as_py()), known, level, buckets))

    return run


SUMS = "shard long, bucket long, places binary, gids binary, gid long, pid long, wid long, f long"
_SUMS = pa.schema({"shard": pa.int64(), "bucket": pa.int64(), "places": pa.binary(), "gids": pa.binary(), "gid": pa.int64(), "pid": pa.int64(), "wid": pa.int64(), "f": pa.int64()})


def _summed(least: int):
    """Add up the lists of each bucket: a row per frequent phrase, and per list the places and ids of those in it."""

    def bucket(number: int, rows: list) -> Iterator[pa.RecordBatch]:
        pids, wids, counts = (np.concatenate([unpack(r[k]) for r in rows]) for k in (1, 2, 3))
        order = _pair_order(pids, wids)
        pids, wids = pids[order], wids[order]
        fresh = np.concatenate(([True], (np.diff(pids) != 0) | (np.diff(wids) != 0)))
        edge, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        total = np.add.reduceat(counts[order], edge)
        often = total >= least
        named = np.where(often, (number << 32) + np.cumsum(often) - 1, -1)
        gid = np.empty(len(order), np.int64)
        gid[order] = named[group]
        n = int(often.sum())
        at, hits = 0, []
        for shard, packed, *_ in rows:
            size = (len(packed) - 1) // packed[0]
            own = gid[at : at + size]
            at += size
            place = np.flatnonzero(own >= 0)
            if len(place):
                hits.append({"shard": shard, "bucket": number, "places": pack(place), "gids": pack(own[place])})
        if hits:
            yield from pa.Table.from_pylist(hits, schema=_SUMS).to_batches()
        if n:
            columns = {"bucket": np.full(n, number), "gid": named[often], "pid": pids[edge][often], "wid": wids[edge][often], "f": total[often]}
            yield from pa.table({f.name: pa.array(columns[f.name]) if f.name in columns else pa.nulls(n, f.type) for f in _SUMS}, schema=_SUMS).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for number, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if number != now and held:
                    yield from bucket(now, held)
                    held = []
                now = number
                held.append(row)
        if held:
            yield from bucket(now, held)

    return run


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with ``least`` occurrences or more in a language: (lang, words, phrase, f); and (lang, n), its words.

    ASCII letters are lower-cased; pieces end at ``.,;:!?`` and line ends, words
    at spaces and tabs. All contiguous occurrences within pieces count,
    overlaps included. A null language is ``und``; null texts are empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    shards = materialize(rows.mapInArrow(_shards, "shard long, size long, text binary, words array<struct<lang string, word string, n long>>"), "shards")
    words = shards.select("shard", F.posexplode("words").alias("place", "w")).select("shard", (F.col("place").cast("long") + 1).alias("place"), "w.*")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    common = materialize(common.select("lang", "word", "f", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "words")
    parts = common.groupBy("part").agg(F.count("*").alias("n"))  # one row per shuffle partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    common = materialize(common.join(F.broadcast(parts), "part").select((F.col("ahead") + F.col("nth") + 1).alias("wid"), "lang", "word", "f"), "words")

    size, count = (int(x or 0) for x in shards.agg(F.sum("size"), F.count("*")).first())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, size // BUCKET_ENTRIES)
    buckets = max(1, min(buckets, size // max(1, count) // LIST_ENTRIES))
    placed = words.join(common.select("lang", "word", "wid"), ["lang", "word"]).select(F.col("shard").alias("at"), "place", "wid")
    lists = shards.select("shard", "text").groupBy("shard").cogroup(placed.groupBy("at")).applyInArrow(_index_shards(longest, buckets), LISTS)
    lists = materialize(lists, "lists")
    index = lists.filter("text is not null").select("shard", "text", "ids")

    phrases = common.select(F.col("wid").alias("gid"), "lang", F.col("word").alias("phrase"), "f")
    last = phrases.select(F.col("gid").alias("wid"), F.col("phrase").alias("_last"))
    found, answers = phrases.select("lang", F.lit(1).alias("words"), "phrase", "f"), None
    for level in range(2, longest + 1):
        if level > 2:
            lists = index.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_extend_shards(longest, level, buckets), LISTS)
        lists = lists.filter("bucket is not null").select("bucket", "shard", "pids", "wids", "counts")
        sums = lists.repartition(partitions, "bucket").sortWithinPartitions("bucket", "shard").mapInArrow(_summed(least), SUMS)
        sums = materialize(sums, "sums")
        hits = sums.filter("places is not null").select("shard", F.lit(level).alias("level"), "bucket", "places", "gids")
        answers = hits if answers is None else answers.unionByName(hits)
        grams = sums.filter("gid is not null").select(F.col("gid").alias("_gid"), "pid", "wid", F.col("f").alias("_f"))
        grams = grams.join(phrases, F.col("pid") == F.col("gid")).join(last, "wid")
        phrases = materialize(grams.select(F.col("_gid").alias("gid"), "lang", F.concat_ws(" ", "phrase", "_last").alias("phrase"), F.col("_f").alias("f")), "phrases")
        found = found.unionByName(phrases.select("lang", F.lit(level).alias("words"), "phrase", "f"))
    return materialize(found, "found"), totals


def collocations(
    docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, contained: int = 80, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words with a occurrences, at least ``least``, is
    cut after its first k words into parts with l and r occurrences; its score is
    floor(2,000,000 a / (l + r)) at the cut where that is lowest, the first of
    such. Left out are phrases inside a longer one (itself left out or not) that
    has ``contained`` hundredths of their occurrences or more: by then the
    longer one by a word does. Ranked by score and a, falling, then the phrase
    by bytes. Arithmetic is on decimals.

    n counts the language's words. Repeated rows count each. An empty table
    gives no rows. Other columns are ignored.
    """
    found, totals = frequent_phrases(docs, longest, least, lang_col, text_col)
    cut = F.sequence(F.lit(1), F.col("words") - 1)
    rows = found.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("_w"))
    rows = rows.select("lang", "phrase", "a", "words", "_w", F.explode(cut).alias("k"))
    part = lambda first, n: F.array_join(F.slice("_w", first, n), " ")
    cuts = rows.select("lang", "phrase", "a", "words", "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("_right"))
    left = found.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    score = F.expr("(cast(a as decimal(19,0)) * 2000000) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_s"))
    inner = cuts.filter("words > 2").select("lang", "a", F.explode(F.array(*(
        F.struct((F.col("k") == at).alias("fits"), F.col(side).alias("p")) for at, side in ((F.lit(1), "_right"), (F.col("words") - 1, "_left"))
    ))).alias("x"))
    inner = inner.filter("x.fits").groupBy("lang", F.col("x.p").alias("phrase")).agg(F.max("a").alias("_longer"))
    rows = scored.join(inner, ["lang", "phrase"], "left").filter(
        F.col("_longer").isNull() | (F.col("_longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * contained)
    )
    rows = rows.select("lang", "phrase", "a", "_s.l", "_s.r", "_s.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= top)
    totals = totals.select(F.col("lang").alias("_lang"), "n")
    return rows.join(totals, F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


def collocation_sql(longest: int = 4, least: int = 30, top: int = 2000, contained: int = 80) -> str:
    """The rows of :func:`collocations` over ``documents`` in DuckDB's SQL."""
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{capital}', '{small}'), '[.,;:!?\\x0A-\\x0D]')) as t from documents),
w as (select lang, list_filter(regexp_split_to_array(t, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
totals as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: w[i:i + k - 1])) as g from w, (select unnest(generate_series(1, {longest})) as k)),
f as (select lang, g, count(*) as f from g group by lang, g having count(*) >= {least}),
c as (select f.lang, g, f as a, unnest(generate_series(1, len(g) - 1)) as k from f where len(g) > 1),
s as (select c.lang, c.g, a, k, x.f as l, y.f as r, ((2000000::hugeint * a) // (x.f + y.f))::bigint as score
  from c join f x on x.lang = c.lang and x.g = c.g[:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:]),
b as (select * from s qualify row_number() over (partition by lang, g order by score, k) = 1),
o as (select lang, g[:len(g) - 1] as g, f from f where len(g) > 2 union all select lang, g[2:], f from f where len(g) > 2),
m as (select lang, g, max(f) as longer from o group by lang, g),
k as (select b.* from b left join m on m.lang = b.lang and m.g = b.g where longer is null or 100::hugeint * longer < {contained}::hugeint * a),
z as (select *, array_to_string(g, ' ') as phrase from k),
q as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from z)
select q.lang, rank, phrase, a, l, r, n, score from q join totals on totals.lang = q.lang where rank <= {top}
"""

"""Phrase collocations, embedding whitening and document fingerprints."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import fingerprints as fp
from gridloom.llm import phrases, whitening
from tests.oracle import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


# phrases


def _grams(text, longest):
    """Every contiguous phrase of a ring-free list of pieces."""
    found = collections.Counter()
    for piece in text:
        for k in range(1, longest + 1):
            found.update(tuple(piece[i : i + k]) for i in range(len(piece) - k + 1))
    return found


def test_index_extensions_match_counting():
    rng = np.random.default_rng(3)
    for words, size in ((1, 30), (2, 200), (5, 400), (40, 300)):
        text = np.append(rng.integers(0, words + 1, size), 0)
        text[np.isin(text, np.setdiff1d(np.arange(1, words + 1), text))] = 0
        known = np.unique(text[text > 0])
        text = np.searchsorted(np.concatenate(([0], known)), text)
        pieces = [[]]
        for t in text.tolist():
            if t:
                pieces[-1].append(t)
            else:
                pieces.append([])
        want = _grams(pieces, 4)
        index = phrases.BidirectionalIndex(text, 4)
        spans, names = index.words(), [(w,) for w in range(1, len(known) + 1)]
        for k in range(2, 5):
            phrase, word, *spans = index.extend(*spans)
            names = [names[p] + (w,) for p, w in zip(phrase.tolist(), word.tolist(), strict=True)]
            assert dict(zip(names, spans[2].tolist(), strict=True)) == {g: n for g, n in want.items() if len(g) == k}
            keep = np.argsort(spans[1])[::2][: len(names)]  # some are dropped, as rare ones are
            keep = np.sort(keep)
            order = keep[np.argsort(spans[1][keep])]
            names, spans = [names[i] for i in order], [s[order] for s in spans]
            want = collections.Counter({g: n for g, n in want.items() if len(g) > k and g[:k] in set(names) and g[1 : k + 1] in set(names)})


def test_orders_are_stable_with_and_without_room_for_places():
    rng = np.random.default_rng(4)
    for most, size in ((1, 0), (1, 1), (3, 1000), (1 << 20, 5000), ((1 << 63) - 1, 5000)):
        key = rng.integers(0, most, size)
        key[: size // 2] = key[size - size // 2 :]
        assert np.array_equal(phrases._order(key, most), np.argsort(key, kind="stable"))
        for other in (1 << 10, 1 << 40):
            second = rng.integers(0, other, size)
            assert np.array_equal(phrases._pair_order(key, second), np.lexsort((second, key)))


def test_an_index_sorts_no_keys_by_the_slow_way(monkeypatch):
    """Two passes over a shard's text, its words and its extensions: each an order that fits 64 bits."""
    text = np.append(np.random.default_rng(5).integers(0, 50_000, 1 << 20), 0)
    text = np.unique(np.append(text, 0), return_inverse=True)[1]
    slow, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **y: slow.append(len(a)) or argsort(a, *x, **y))
    index = phrases.BidirectionalIndex(text, 4)
    index.extend(*index.words())
    assert slow == []


def _brute(docs, longest, least, top, contained):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in docs:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        pieces = [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", low)]
        f[lang or "und"] += _grams(pieces, longest)
        n[lang or "und"] += sum(map(len, pieces))
    rows = []
    for lang, c in f.items():
        c = {g: a for g, a in c.items() if a >= least}
        kept = []
        for g, a in c.items():
            longer = [q for q, b in c.items() if len(q) > len(g) and 100 * b >= contained * a and any(q[i : i + len(g)] == g for i in range(len(q)))]
            if len(g) > 1 and not longer:
                score, k = min(((2000000 * a) // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(rows)


def _collocations(spark, docs, **how):
    return sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit(1), "word": F.lit("w"), "phrase": F.lit("p")}), **how).collect())


def test_collocations_match_brute_force(spark):
    rng = random.Random(7)
    words = ["New", "York", "city", "a", "bé", "Ünder", "x"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und"])) for i in range(60)]
    docs += [(1, "new york city " * 30, "en")] * 2 + [(None, None, "en"), (70, "", None), (71, " .,;\n", "de"), (72, "solo", "fr")]
    for how in ({"longest": 4, "least": 3, "top": 40, "contained": 80}, {"longest": 3, "least": 5, "top": 2000, "contained": 60}):
        got = _collocations(spark, docs, **how)
        assert got == _brute(docs, *how.values()) and len(got) > 30


def test_collocations_over_many_shards(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(200)) + "! " + "the same passage again, ", "en") for i in range(30)]
    whole = _collocations(spark, docs, least=4)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 700)  # workers forked before this keep their own: the partitions make shards too
    assert _collocations(spark, docs, least=4) == whole == _brute(docs, 4, 4, 2000, 80)
    parts = list(phrases._parts([_Batch([d[1] for d in docs] + ["x" * 5000 + ". end"], ["en"] * 31)]))
    assert len(parts) > 8 and b"".join(t for ts, _ in parts for t in ts) == "".join(d[1] for d in docs).encode() + b"x" * 5000 + b". end"


class _Batch:
    def __init__(self, *columns):
        self._columns = columns

    def column(self, k):
        import pyarrow as pa

        return pa.array(self._columns[k])


def test_collocations_of_nothing(spark):
    assert _collocations(spark, []) == [] and _collocations(spark, [(1, None, None), (2, "", "en"), (3, "few words", "en")]) == []


def test_packed_numbers_return():
    for x in (np.zeros(0, np.int64), np.array([0, 255]), np.array([256, 1 << 40, 3]), np.arange(70000)):
        assert (phrases.unpack(phrases.pack(x)) == x).all()


# whitening


def _check_whitening(spark, rows, components=32):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, n long")
    got = whitening.whiten(df, components).toPandas()
    good = [(i, v) for i, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in good], dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = (x * n - s).astype(float) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * k and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(values[:k] / values.sum(), rel=1e-9)
    dev = {i: int(d) for i, d in zip((i for i, _ in good), ((x * n - s) ** 2).sum(axis=1), strict=True)}
    assert all(dev[r.vec_id] == r.deviation for r in got.itertuples())
    wide = got.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    want = z @ vectors[:, :k] / np.sqrt(values[:k])
    mine = wide.loc[[i for i, _ in good]].to_numpy()
    gaps = np.abs(np.subtract.outer(values[:k], values)) + np.where(np.eye(len(values))[:k] > 0, np.inf, 0)
    clear = gaps.min(axis=1) > 1e-6 * values[0]
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine - want * sign)[:, clear].max(initial=0) < 1e-7


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(rng.standard_normal((300, 40)) * np.linspace(3, 0.2, 40))]
    rows += [(300, None, 0, 0), (301, [1.0, None] * 20, 0, 0), (302, [float("nan")] * 40, 0, 0), (303, [float("inf")] * 40, 0, 0), (304, [], 0, 0), rows[0]]
    _check_whitening(spark, rows)


def test_whitening_of_low_rank_and_ties(spark):
    rng = np.random.default_rng(2)
    flat = rng.integers(-3, 4, (120, 3)) @ rng.integers(-2, 3, (3, 12)) / 64
    _check_whitening(spark, [(i, v.tolist(), 0, 0) for i, v in enumerate(flat)])
    cross = np.concatenate([np.eye(6), -np.eye(6)])  # six equal eigenvalues
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cross)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).toPandas()
    assert len(got) == 72 and got.identity_error.iloc[0] < 1e-9 and got.explained.to_numpy() == pytest.approx(np.full(72, 1 / 6))


def test_whitening_without_variance_or_rows(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).count() == 0
    mixed = [(1, [1.0]), (2, [1.0, 2.0]), (3, [5.0, 1.0]), (4, [3.0, 9.0]), (5, [1e300, 1.0])]
    assert {r.vec_id for r in whitening.whiten(spark.createDataFrame(mixed, "vec_id long, embedding array<double>")).collect()} == {2, 3, 4}


def test_jacobi_davidson_beyond_its_basis():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    e = 1 / np.arange(1, 401.0)
    a, calls = q * e @ q.T, [0]

    def product(b):
        calls[0] += 1
        return a @ b

    values, vectors = whitening.jacobi_davidson(product, 400, 12, basis=40)
    assert np.abs(values - e[:12]).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-13 and calls[0] < 200


def test_exact_deviations_of_large_entries():
    x = np.array([[1 << 45, 3], [5, 7]])
    total = [(1 << 45) + 5, 10]
    assert whitening.deviations(x, total, 2) == [None, None]
    assert whitening.deviations(np.array([[1_000_003, 999_990], [1_000_001, 1_000_010]]), [2_000_004, 2_000_000], 2) == [4 + 400, 4 + 400]


# fingerprints


def _vector(text):
    exact, counts, n = [0] * fp.EXACT, [0] * (2 * fp.PACKED), 0
    for p in (text or "").split("\n"):
        digest = "".join(hashlib.sha256(f"{k}:{p}".encode()).hexdigest() for k in (0, 1))
        exact = [(e + int(digest[8 * k : 8 * k + 8], 16)) % (1 << 32) for k, e in enumerate(exact)]
        words = ["", "", *(w for w in re.split("[ \t-\r]+", p) if w)]
        for i in range(2, len(words)):
            h = hashlib.md5(" ".join(words[i - 2 : i + 1]).encode()).hexdigest()
            halves = int(h[:15], 16), int(h[15:30], 16)
            for k in range(fp.PACKED):
                for high in (0, 1):
                    counts[2 * k + high] += halves[k // fp.HALF] >> (k % fp.HALF + 32 * high) & 1
            n += 1
    return n, exact, counts


def _unpacked(f):
    return f.n, list(f.exact), [c for x in f.counts for c in (x & 0xFFFFFFFF, x >> 32)]


TEXTS = ["one two three\nfour five", "four five\none two three", "", None, "a", "é ü " * 40, "same line\nsame line", "tab\there \x0b and\r\nthere", "one two three\nfour five"]


def test_fingerprints_match_brute_force_and_ignore_order(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "y"), (None, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumns({"n_chars": F.lit(1), "bucket": F.lit(2)})
    got = fp.document_fingerprints(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert _unpacked(r.fp) == _vector("a" if r.doc_id is None else TEXTS[r.doc_id])
    by_id = {r.doc_id: r.fp for r in got}
    assert by_id[0] == by_id[1] == by_id[8] and by_id[2] == by_id[3] and by_id[0] != by_id[6]


def test_paragraphs_are_inserted_and_deleted(spark):
    parts = ["first paragraph of some words", "", "second one", "second one", "é"]
    df = spark.createDataFrame([(1, "\n".join(parts)), (2, "\n".join(parts[:3])), (3, "\n".join(parts[3:]))], "doc_id long, text string")
    f = {r.doc_id: r.fp for r in fp.document_fingerprints(df).collect()}
    row = fp.document_fingerprints(df).groupBy().pivot("doc_id", [1, 2, 3]).agg(F.first("fp")).select(
        fp.plus(F.col("2"), F.col("3")).alias("sum"), fp.minus(F.col("1"), F.col("2")).alias("rest"), fp.from_text(fp.to_text(F.col("1"))).alias("back"),
        F.length(fp.to_text(F.col("1"))).alias("digits"), fp.plus(F.col("1"), F.lit(None).cast("struct<n:long,exact:array<long>,counts:array<long>>")).alias("none"),
    ).first()
    assert row["sum"] == f[1] and row["rest"] == f[3] and row["back"] == f[1] and row["digits"] == 1032 and row["none"] is None


def test_edited_texts_match_brute_force(spark):
    rng = random.Random(4)
    texts = {i: "\n".join(" ".join(rng.choice(["alpha", "bé", "gamma", "δ", "e"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 4))) for i in range(1, 50)}
    texts |= {-3: None, 60: "", 61: "x", 1 << 40: "large id"}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fp.edit_fingerprints(spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")).collect()}
    assert set(got) == set(texts)
    for at, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        third = len(text) // 3
        edited, r = text[: len(text) - third] + following[:third], got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        n, exact, counts = _vector(edited)
        swap = [x for k in range(0, len(counts), 2) for x in (counts[k + 1], counts[k])]
        assert r.edited_fingerprint == f"{n:08x}" + "".join(f"{e:08x}" for e in exact) + "".join(f"{c:08x}" for c in swap)
        for name, other in (("near_edited", edited), ("near_next", following)):
            (n0, e0, c0), (n1, e1, c1) = _vector(text), _vector(other)
            a, b = n0 - 2 * np.array(c0, float), n1 - 2 * np.array(c1, float)
            want = 1.0 if (n0, e0, c0) == (n1, e1, c1) else max(0.0, float(a @ b / max(np.sqrt((a @ a) * (b @ b)), 1e-9)))
            assert r[name] == pytest.approx(want, abs=1e-8)


def test_edits_with_repeated_and_null_ids(spark):
    rows = [(5, "five"), (5, "five"), (5, "other"), (None, "no id"), (None, "no id"), (7, "seven words are in this text here")]
    got = fp.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 6 and got.filter("doc_id is null").count() == 2
    assert fp.edit_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = fp.edit_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op13_document_fingerprints"])
def test_queries_match_sql(spark, name):
    from gridloom.llm import queries

    assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(connect(SF), queries.oracle_sql()[name])

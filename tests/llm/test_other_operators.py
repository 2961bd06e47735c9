"""Chat trees, vectors, archives, shared helpers and the pipeline."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import chat_trees as ct
from gridloom.llm import components, vectors, warc
from gridloom.llm.bytetext import chunks
from gridloom.llm.store import fresh_path

SF = "/root/testdata/sf0.001"
TREE = "conv_id long, node long, parent long, role string, text string, score double"


def test_escape_is_reversible(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["<", "|", "\\", ">", "a", "\n", "<|end|>", "<|turn|>", "é"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)] + [(i, 1, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = ct.format_branches(ct.chain_replies(df)).select("conv_id", ct.parse_turns(F.col("formatted")).alias("t"), ct.loss_text(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert [(t.role, t.text) for t in r.t] == [("user", texts[r.conv_id]), ("assistant", texts[r.conv_id])] and r.l == texts[r.conv_id]


def test_reply_trees(spark):
    rows = [
        (1, 0, None, "user", "q", 1.0), (1, 1, 0, "assistant", "bad", 0.1), (1, 2, 0, "assistant", "good", 0.9), (1, 3, 2, "user", "next", 0.2),
        (1, 4, 3, "assistant", None, None), (1, 5, 3, "assistant", "best", 0.5), (2, 0, None, "user", "alone", None), (3, 0, 7, None, "no parent", 1.0),
        (4, 0, 1, "user", "cycle", 1.0), (4, 1, 0, "user", "cycle", 1.0),
    ]
    # a cycle with a leaf and a chain below it, beside a good branch; and rows told again
    rows += [(4, 2, 0, "user", "below", 1.0), (4, 3, 2, "user", "leaf", 1.0), (4, 9, None, "user", "fine", 0.0), (5, 0, None, "user", "b", 1.0), (5, 0, 3, "user", "a", 2.0)]
    rows += [(5, 1, 0, "assistant", "said", 1.0)] * 2 + [(5, None, 0, "user", "no node", 9.0), (None, 0, None, "user", "null", 1.0), (None, 1, 0, "user", "conv", 1.0)]
    tree = spark.createDataFrame(rows, TREE).withColumns({"leaf": F.lit(9), "far": F.lit(8), "up": F.lit(7)})
    got = {(r.conv_id, r.branch_rank): r for r in ct.format_branches(tree, top=2).collect()}
    text = lambda k: ct.BODY in got[k].formatted and [p.split(ct.BODY)[1] for p in got[k].formatted.split(ct.END)[:-1]]
    assert text((1, 1)) == ["q", "good", "next", "best"] and text((1, 2)) == ["q", "good", "next", ""]
    assert got[1, 1].branch_score == pytest.approx(2.6)
    assert text((2, 1)) == ["alone"] and text((3, 1)) == ["no parent"] and text((4, 1)) == ["fine"]
    assert text((5, 1)) == ["a", "said"] and text((None, 1)) == ["null", "conv"] and len(got) == 7
    paths = {(r.conv_id, r.leaf, r.node, r.up) for r in ct.branches(tree).collect()}
    assert {p for p in paths if p[0] == 4} == {(4, 9, 9, 0)} and (1, 5, 0, 3) in paths and len(paths) == 2 + 4 + 4 + 1 + 1 + 1 + 2 + 2
    assert {(r.conv_id, r.leaf) for r in ct.best_branches(tree).collect()} == {(1, 5), (2, 0), (3, 0), (4, 9), (5, 1), (None, 1)}
    assert ct.branches(spark.createDataFrame([], TREE)).count() == 0 and ct.format_branches(spark.createDataFrame([], TREE)).count() == 0
    assert ct.format_branches(spark.createDataFrame(rows[8:10], TREE)).count() == 0


def test_long_chain_needs_few_joins(spark):
    df = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(70)], "conv_id long, turn long, role string, text string")
    r = ct.format_branches(ct.chain_replies(df)).first()
    assert r.formatted.count(ct.TURN) == 70 and len(r.loss_mask) == 35 and r.branch_score == 70


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 16))
    near = base[:1] + rng.normal(size=(60, 16)) * 0.12
    all_ = np.concatenate([base, near, base[:10], base[5:6].repeat(12, 0) * 3]).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(all_)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, []), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9007, [None, 1.0]), (9008, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"n": F.lit(1), "cell": F.lit(2), "id": F.lit(3)})
    old, vectors.BLOCK_ROWS = vectors.BLOCK_ROWS, 16
    try:
        got = {r.vec_id: r for r in vectors.vector_duplicates(df).collect()}
    finally:
        vectors.BLOCK_ROWS = old
    v = all_.astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(v))
    for _ in range(len(v)):
        label = np.minimum(label, np.where(link, label[None, :], 1 << 60).min(axis=1))
    for i in range(len(v)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), label[i], label[i] == i)
    for i in (9001, 9002, 9003, 9004, 9007, 9008):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[9006].component_id == 9005
    assert vectors.vector_duplicates(df.limit(0)).count() == 0


def test_vectors_miss_nothing_in_a_hot_cluster(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=(1, 64)) + rng.normal(size=(1200, 64)) * 0.2121
    far = rng.normal(size=(800, 64))
    all_ = np.concatenate([hot, far, far[:9] + rng.normal(size=(9, 64)) * 0.1]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(all_)], "vec_id long, embedding array<float>")
    old, vectors.CELL_ROWS = vectors.CELL_ROWS, 20  # a hundred cells, of which the cluster draws over half
    try:
        got = {r.vec_id: r.n_links for r in vectors.vector_duplicates(df).collect()}
        wide = {r.vec_id: r.n_links for r in vectors.vector_duplicates(df.withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()}
    finally:
        vectors.CELL_ROWS = old
    v = all_.astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = dict(enumerate((v @ v.T >= 0.95).sum(axis=1) - 1))
    assert sum(want.values()) > 100_000 and got == want and wide == want


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 100)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in [*range(100, 160), 200]) and len(got) == 102


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    long, short = "x" * 120, "y" * 20
    rows = [(5, "http://a/5", long), (3, "http://a/3", long), (9, None, long), (1, "http://a\r\nb/1", short), (2, "http://a/2", short), (4, "u", None), (6, "u", "é" * 60), (6, "u", "é" * 60), (7, "", "z\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"shard": F.lit("s"), "record_type": F.lit(1)})
    folder = fresh_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder).collect()
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect())
    assert got == [(1, 20, "response", None), (2, 20, "response", None), (3, 120, "response", None), (4, 0, "response", None), (5, 120, "revisit", 3), (6, 120, "response", None), (6, 120, "response", None), (7, len(rows[8][2]), "response", None), (9, 120, "revisit", 3)]
    again = fresh_path(spark, "warc-test")
    assert sorted(map(tuple, manifest)) == sorted(map(tuple, warc.write_archives(pages.repartition(3), again).collect()))
    assert warc.read_archives(spark, folder).filter("page_id = 7").first().payload.decode() == rows[8][2]
    with pytest.raises(PySparkException):  # a finished folder is not written again
        warc.write_archives(pages, folder)
    path = folder.removeprefix("file://") + "/" + manifest[0].file
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(PySparkException):
        warc.read_archives(spark, folder).count()


def test_archives_of_nothing_and_rolling(spark):
    folder = fresh_path(spark, "warc-test")
    assert warc.write_archives(spark.createDataFrame([], PAGES), folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(None, None, "no id"), (None, None, "no id")], PAGES))
    found = []
    for table in (pages, pages.repartition(7), pages.orderBy("html")):
        folder = fresh_path(spark, "warc-test")
        files = warc.write_archives(table, folder, shard_bytes=60_000, roll_bytes=5_000).collect()
        found.append(sorted((r.file, r.records, r.bytes, r.sha256) for r in files))
        assert warc.read_archives(spark, folder).count() == pages.count()
    assert found[0] == found[1] == found[2]  # the same bytes, however the table is cut
    shards = collections.Counter(r.shard for r in files)
    assert len(shards) > 2 and max(shards.values()) > 2 and all(r.bytes <= 5_000 or r.records == 1 for r in files)
    spans = sorted((r.file, r.first, r.last) for r in files if r.first is not None)
    assert all(a[2] <= b[1] for a, b in itertools.pairwise(spans))  # in key order throughout


def test_chunks_cover_any_text():
    texts = ["", None, "  a b\tc\n", "é ü" * 5, "x" * 50, "\n\n", "last"] * 3
    for budget in (1, 7, 1000):
        seen = []
        for c in chunks(pa.array(texts), budget):
            for r in range(c.rows):
                seen.append([bytes(c.data[s:e]).decode() for s, e, w in zip(c.start, c.end, c.row, strict=True) if w == r])
        assert seen == [(t or "").lower().split() for t in texts]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "odd", 0), (9003, "12 34", "en", "odd", 5)], docs.schema)
    docs = docs.unionByName(odd).withColumn("extra", F.lit(1))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        path = fresh_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= before, name
        before = docs.count()
    assert docs.filter("doc_id >= 9000").count() == 0
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mix.count() == before


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

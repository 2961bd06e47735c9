"""Embedding near-duplicates: spherical k-means cells, exact bounds between them, blocked cosine products, one kept per group.

Every vector is owned by the cell of its nearest centroid; cells are cut into
blocks of bounded size, packed as one row each. Unit vectors at cosine t are at
distance r = sqrt(2 - 2t) at most. Two blocks are skipped only if their least
projections on the line between their centroids lie more than r apart, so no
link is missed, whatever the vectors. Vectors without clusters allow little to
be skipped: the products then grow with the square of the number of vectors. A
block pair is one matrix product in single precision with a margin, confirmed in
double precision, which yields each member's number of links and a spanning
forest of the links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gridloom.llm.components import connected_components
from gridloom.llm.store import materialize

#: Bounds of the centroids' fit and number: sampled vectors, vectors a cell, cells. Rows and bytes of a block, rows of a product.
SAMPLE, CELL_ROWS, MAX_CELLS, BLOCK_ROWS, BLOCK_BYTES, TILE_ROWS, ITERATIONS = 20_000, 4096, 2048, 8192, 1 << 22, 2048, 6


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null or empty, all components finite, not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def spherical_kmeans(sample: np.ndarray, k: int, seed: int = 0, iterations: int = ITERATIONS) -> np.ndarray:
    """Unit centroids of unit vectors by mean cosine; an emptied cell takes the worst-placed vector."""
    rng = np.random.default_rng(seed)
    centroid = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(iterations):
        cosine = sample @ centroid.T
        own = cosine.argmax(axis=1)
        total = np.zeros_like(centroid)
        np.add.at(total, own, sample)
        length = np.sqrt(np.einsum("ij,ij->i", total, total))
        empty = length < 1e-12
        total[~empty] /= length[~empty, None]
        if empty.any():
            total[empty] = sample[np.argsort(cosine.max(axis=1))[: empty.sum()]]
        centroid = total
    return centroid


def _owned(classes: DataFrame, shared, kind: str) -> DataFrame:
    """(cell, id, copies, v): each class in the cell of its nearest centroid, its vector as bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                cell = (_unit(v) @ shared.value.T).argmax(axis=1).astype(np.int32)
                data = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell), part.column(0), part.column(1), data], names=["cell", "id", "copies", "v"])

    return classes.select("id", "copies", "vector").mapInArrow(run, "cell int, id long, copies long, v binary")


def _pack(shared, kind: str):
    """One row per block; ``least`` holds, per centroid, the least projection of a member towards its own and away from that one."""

    def run(table: pa.Table) -> pa.Table:
        c, cell = shared.value, table["cell"][0].as_py()
        data = b"".join(table["v"].to_pylist())
        near = _unit(np.frombuffer(data, kind).reshape(table.num_rows, -1)) @ c.T
        gap = np.sqrt(np.square(c[cell] - c).sum(axis=1))
        apart = gap > 1e-6
        least = np.full(len(c), -4.0)  # less than any: never skipped
        least[apart] = (near[:, cell, None] - near[:, apart]).min(axis=0) / gap[apart]
        row = {"block": table["block"][0].as_py(), "cell": cell, "least": least, "ids": table["id"].to_numpy(), "copies": table["copies"].to_numpy()}
        return pa.table({k: pa.array([x]) for k, x in row.items()} | {"v": pa.array([data], pa.binary())}).cast(_PACKED)

    return run


_PACKED = pa.schema({
    "block": pa.int64(), "cell": pa.int32(), "least": pa.list_(pa.float64()), "ids": pa.list_(pa.int64()), "copies": pa.list_(pa.int64()), "v": pa.binary()
})


def _block_links(shared, kind: str, cosine: float):
    reach = np.sqrt(max(2 - 2 * cosine, 0)) + 1e-9

    def run(table: pa.Table) -> pa.Table:
        sides = []
        for k in np.argsort(table["side"].to_numpy()):
            ids, copies = (table[x][int(k)].values.to_numpy() for x in ("ids", "copies"))
            sides.append((table["cell"][int(k)].as_py(), ids, copies, _unit(np.frombuffer(table["v"][int(k)].as_py(), kind).reshape(len(ids), -1))))
        alone = len(sides) == 1  # a block with itself
        (cell, ia, wa, a), (other, ib, wb, b) = sides[0], sides[-1]
        if cell != other:  # members too far from the other side along the line between the centroids
            line = shared.value[cell] - shared.value[other]
            line = line / max(np.sqrt(line @ line), 1e-300)
            pa_, pb = a @ line, b @ line
            ua, ub = pa_ <= pb.max() + reach, pb >= pa_.min() - reach
            ia, wa, a, ib, wb, b = ia[ua], wa[ua], a[ua], ib[ub], wb[ub], b[ub]
        na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        edges = [np.zeros((0, 2), np.int64)]
        low = np.float32(cosine - 1e-6 - 2.5e-7 * a.shape[1])
        b32 = b.astype(np.float32).T
        for at in range(0, len(ia), TILE_ROWS):
            hit = a[at : at + TILE_ROWS].astype(np.float32) @ b32 >= low
            ra, rb = np.flatnonzero(hit.any(axis=1)) + at, np.flatnonzero(hit.any(axis=0))
            if len(ra) == 0:
                continue
            link = (a[ra] @ b[rb].T >= cosine) & (ia[ra][:, None] != ib[rb][None, :])
            ua, ub = link.any(axis=1), link.any(axis=0)
            ra, rb, link = ra[ua], rb[ub], link[np.ix_(ua, ub)]
            if len(ra) == 0:
                continue
            na[ra] += link @ wb[rb]
            nb[rb] += link.T @ wa[ra]
            la, lb, top = ia[ra], ib[rb], np.iinfo(np.int64).max
            while True:
                ma = np.minimum(la, np.where(link, lb[None, :], top).min(axis=1))
                mb = np.minimum(lb, np.where(link, ma[:, None], top).min(axis=0))
                if (ma == la).all() and (mb == lb).all():
                    break
                la, lb = ma, mb
            edges += [np.stack((ia[ra], la), axis=1), np.stack((ib[rb], lb), axis=1)]
        edge = np.unique(np.concatenate(edges), axis=0)
        count = [(ia, na)] if alone else [(ia, na), (ib, nb)]
        i, n = (np.concatenate(x) for x in zip(*((i[n > 0], n[n > 0]) for i, n in count), strict=True))
        none = np.zeros(len(edge), np.int64)
        out = {"id": (i, edge[:, 0]), "n": (n, none), "root": (i, edge[:, 1])}
        return pa.table({k: pa.array(np.concatenate(x), pa.int64()) for k, x in out.items()})

    return run


def _links(classes: DataFrame, count: int, dim: int, cosine: float, kind: str) -> DataFrame:
    """(id, n, root): links of classes of one dimension, by block pair."""
    stride = max(1, -(-count // SAMPLE))
    sample = classes.filter(F.pmod(F.xxhash64("id"), F.lit(stride)) == 0).select("vector").toPandas()
    if sample.empty:
        sample = classes.select("vector").limit(1).toPandas()
    unit = _unit(np.stack([np.asarray(v) for v in sample.vector]))
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (dim * np.dtype(kind).itemsize)))
    centroids = spherical_kmeans(unit, int(np.clip(-(-count // min(CELL_ROWS, most)), 1, MAX_CELLS)))
    shared = classes.sparkSession.sparkContext.broadcast(centroids)
    rows = materialize(_owned(classes, shared, kind), "cells")
    size = rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("long").alias("blocks"))
    rows = rows.join(F.broadcast(size), "cell").withColumn("block", F.col("cell").cast("long") * (1 << 31) + F.pmod(F.xxhash64("id"), "blocks"))
    packed = rows.select("cell", "block", "id", "copies", "v").groupBy("block").applyInArrow(
        _pack(shared, kind), "block long, cell int, least array<double>, ids array<long>, copies array<long>, v binary"
    )
    packed = materialize(packed, "blocks")
    reach = float(np.sqrt(max(2 - 2 * cosine, 0))) + 1e-9
    # cells first, of which there are MAX_CELLS at most; then the blocks of cells that can meet, a number each, by pair of cells
    sides = packed.select("block", "cell", F.posexplode("least").alias("other", "v"))
    cells = materialize(sides.groupBy("cell", "other").agg(F.min("v").alias("v")), "cells")
    back = cells.select(F.col("cell").alias("_other"), F.col("other").alias("_cell"), F.col("v").alias("_v"))
    open_ = cells.join(back, (F.col("cell") == F.col("_cell")) & (F.col("other") == F.col("_other"))).filter(F.col("v") + F.col("_v") <= reach)
    sides = materialize(sides.join(open_.select("cell", "other"), ["cell", "other"], "left_semi"), "sides")
    one = sides.select(F.col("block").alias("i"), "cell", "other", "v")
    two = sides.select(F.col("block").alias("j"), F.col("other").alias("_cell"), F.col("cell").alias("_other"), F.col("v").alias("_v"))
    met = one.join(two, (F.col("cell") == F.col("_cell")) & (F.col("other") == F.col("_other")))
    pairs = materialize(met.filter((F.col("i") <= F.col("j")) & (F.col("v") + F.col("_v") <= reach)).select("i", "j"), "pairs")
    packed = packed.drop("least")
    left = packed.join(pairs, F.col("block") == F.col("i")).withColumn("side", F.lit(0))
    right = packed.join(pairs.filter("i < j"), F.col("block") == F.col("j")).withColumn("side", F.lit(1))
    return left.unionByName(right).drop("block").groupBy("i", "j").applyInArrow(_block_links(shared, kind, cosine), "id long, n long, root long")


def vector_duplicates(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other rows at cosine >= ``cosine`` in double precision;
    component_id is the least id reachable over links. Equal vectors are one
    class before cells are made, so copies cost nothing further. Null, empty,
    zero and non-finite vectors link with nothing. Vectors of different length
    never link. Repeated rows are copies of each other. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    key = F.when(usable(F.col("vector")), F.struct(F.xxhash64("vector"), F.hash("vector"), F.xxhash64(F.lit(7), "vector")))
    rows = rows.withColumn("key", key.cast("string"))
    classes = rows.filter("key is not null and id is not null").groupBy("key").agg(
        F.min_by(F.struct("id", "vector"), "id").alias("first"), F.count("*").alias("copies")
    )
    classes = materialize(classes.select("key", "first.id", "copies", "first.vector"), "classes")
    known = vectors.schema[vector_col].dataType
    kind = "f4" if isinstance(known, ArrayType) and isinstance(known.elementType, FloatType) else "f8"
    found = None
    for dim in classes.groupBy(F.size("vector").alias("d")).count().filter("count > 1").collect():
        part = _links(classes.filter(F.size("vector") == dim.d), dim["count"], dim.d, cosine, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, n long, root long")
    found = materialize(found, "found")
    component = connected_components(found, "id", "root")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    classes = classes.drop("vector").join(counts, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select(
        F.col("key").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c")
    )
    out = rows.drop("vector").join(classes, F.col("key") == F.col("k"), "left")
    comp = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        comp.alias("component_id"), (F.col("id") == comp).alias("kept"),
    )

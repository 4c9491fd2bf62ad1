"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, components.

Equal vectors form one class.  Each class is dealt to one bucket in each of several tables by the
signs of its products with random hyperplanes.  Inside a bucket all cosines are computed as
matrix products in double precision, block by block for large buckets; a pair counts in the
first table that brings it together, and only sums and a spanning forest leave the task.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import kernels as K

BUCKET = 512  # classes a bucket has on average; the number of signs follows from it
BLOCK = 1024  # vectors of one bucket compared at once in a task


def table_shape(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Signs per table and number of tables, so that a pair at the threshold is missed with at most ``miss``.

    Two vectors at angle a agree in a sign with chance 1 - a / pi.
    """
    bits = max(1, min(48, math.ceil(math.log2(max(n, 2) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


@functools.lru_cache(maxsize=8)
def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _keys(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """n x tables int64 bucket keys (table number, dimension and signs)."""
    signs = (x @ _planes(x.shape[1], bits, tables, seed) >= 0).reshape(len(x), tables, bits)
    code = (signs.astype(K.U64) << np.arange(bits, dtype=K.U64)).sum(axis=2, dtype=K.U64)
    with np.errstate(over="ignore"):
        salt = K.seeds(tables, 61)[None, :] + K.U64(x.shape[1])
        return K.mix64(K.mix64(code + salt) ^ salt).view(np.int64)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _classes_of(batch: pa.RecordBatch) -> list[bytes | None]:
    """16-byte digest of each vector; None for one that is null, empty, zero or has null or non-finite components."""
    import hashlib

    out: list[bytes | None] = []
    for v in batch.column(1):
        x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False) if v.values.null_count == 0 else None
        ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
        out.append(hashlib.blake2b(np.ascontiguousarray(x, dtype=np.float64).tobytes(), digest_size=16).digest() if ok else None)
    return out


def _cell_links(cell: pa.Table, threshold: float, bits: int, tables: int, seed: int) -> pa.RecordBatch | None:
    """Rows ``u, v, n``: with v null, n more linked vectors of class u; with v, an edge of the cell's forest."""
    n = cell.num_rows
    if n < 2:
        return None
    x = _matrix(cell["vec"])
    node = cell["node"].to_pylist()
    copies, block = cell["copies"].to_numpy(), cell["b"].to_numpy()
    table, cross = cell["t"][0].as_py(), cell["cross"][0].as_py()
    norm = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
    np.fill_diagonal(near, False)
    if cross:
        near &= block[:, None] != block[None, :]
    near = np.triu(near)
    i, j = np.nonzero(near)
    if len(i) and table:
        keys = _keys(x, bits, tables, seed)[:, :table]
        first = np.concatenate([~(keys[i[a : a + 100_000]] == keys[j[a : a + 100_000]]).any(axis=1) for a in range(0, len(i), 100_000)])
        i, j = i[first], j[first]
    if not len(i):
        return None
    links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    rows = [(node[a], None, int(links[a])) for a in np.flatnonzero(links).tolist()]
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            rows.append((node[a], node[b], 0))
    u, v, m = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(u, type=pa.binary()), pa.array(v, type=pa.binary()), pa.array(m, type=pa.int64())], names=["u", "v", "n"])


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, miss: float = 1e-4, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row of ``vectors``.

    Vectors of equal length with cosine >= ``threshold`` are linked; a pair exactly at the threshold is
    found with a chance of 1 - ``miss`` at least, a nearer one more surely, and no other pair is
    linked.  ``n_links`` counts the other rows linked directly.  Vectors that are null, empty, zero or hold
    null or non-finite components have no links.  Repeated rows are linked copies.  A row with a
    null vec_id links nothing, has a null component_id and is kept.  Other columns are not read.
    """
    spark = vectors.sparkSession
    C.prepare(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_classes_of(batch), type=pa.binary())], names=["vec_id", "vec", "node"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    rows = C.stage(rows.mapInArrow(digest, "vec_id long, vec array<double>, node binary"), "vec-rows")
    valid = rows.where("node is not null and vec_id is not null")
    classes = C.stage(valid.groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vec-classes")
    bits, tables = table_shape(classes.count(), threshold, miss)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                keys = _keys(_matrix(part.column(2)), bits, tables, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(keys) + 1) * tables, tables, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["node", "copies", "vec", "keys"])

    hashed = classes.select("node", "copies", "vec").mapInArrow(keyed, "node binary, copies long, vec array<double>, keys array<long>")
    buckets = hashed.select("node", "copies", F.col("vec").cast("array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>").alias("vec"), F.posexplode("keys").alias("t", "key"))
    counts = hashed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1")
    cells = C.block_cells(buckets.join(C.dealt_again(counts, "key", "listed"), F.col("key") == F.col("listed")).drop("listed"), "key", "cnt", F.xxhash64("node"), BLOCK)
    found = C.map_groups(cells, "cell", functools.partial(_cell_links, threshold=threshold, bits=bits, tables=tables, seed=seed), "u binary, v binary, n long")
    found = C.stage(found.groupBy("u", "v").agg(F.sum("n").alias("n")), "vec-links")
    links = found.where("v is null").select(F.col("u").alias("node"), "n")
    roots = C.components(found.where("v is not null").select("u", "v"), "vec-cc")
    least = classes.join(roots, "node").groupBy("root").agg(F.min("rep").alias("component"))
    of_class = (
        classes.select("node", "rep", "copies")
        .join(links, "node", "left")
        .join(roots.join(C.dealt_again(least, "root", "r"), F.col("root") == F.col("r")).select("node", "component"), "node", "left")
        .select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    linked = F.col("vec_id").isNotNull()
    return (
        rows.select("vec_id", "node").join(C.dealt_again(of_class, "node", "own"), F.col("node") == F.col("own"), "left")
        .select("vec_id", F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(linked, F.coalesce("component", "vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )

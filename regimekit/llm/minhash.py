"""MinHash near-duplicates by an inverted join over signature coordinates.

1. One pass over the texts gives each document its shingle set's size, a 128-bit digest of the
   set and ``k`` MinHash coordinates.  Documents of equal sets form one class.
2. A class is posted under each (coordinate, value).  Two sets of Jaccard ``j`` agree in
   Binomial(k, j) coordinates, so a link has at least ``t`` (``match_threshold``) with a miss
   probability of at most ``MISS``.  Values that only one class has are skipped; a class left
   with fewer than ``t`` postings has no partner; of the others only the prefix, the ``k - t + 1``
   rarest coordinates, is merged, since two classes with ``t`` matches share one of those.
3. The pairs that meet in a prefix have their collisions counted over all ``k`` posted coordinates, the
   skipped ones included, and go on with ``t`` or more.  First each class is held against the
   heaviest class of its lists (a linear number of pairs), which joins the bulk of large groups of
   near copies.  Then, in lists that still hold several components, pairs of different components
   are counted inside the tasks, block by block; those with ``t`` collisions are counted once
   more on ``k2`` one-byte coordinates, and only pairs above both thresholds leave the task.
4. Every pair is confirmed on the full shingle sets, and confirmed pairs give the components.
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

MISS = 1e-7  # chance that a link at exactly the threshold is lost by the k coordinates
MISS2 = 1e-6  # and by the k2 coordinates
BLOCK = 512  # classes of one list compared at once in a task


def match_threshold(k: int, similarity: float, miss: float = MISS) -> int:
    """Largest t with P(Binomial(k, similarity) < t) <= miss."""
    below, t = 0.0, 0
    while t < k:
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            break
        t += 1
    return t


def _signature(shingles: np.ndarray, first: np.ndarray, k: int, seed: int, dtype: type) -> np.ndarray:
    """k x documents: least value of each coordinate's hash (a random linear permutation) of the shingles."""
    shift = K.U64(64 - np.dtype(dtype).itemsize * 8)
    x = (shingles >> shift).astype(dtype)
    out = np.empty((k, len(first) - 1), dtype=dtype)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(zip(K.seeds(k, seed), K.seeds(k, seed + 1))):
            v = x ^ dtype(b >> shift)
            v *= dtype(a >> shift) | dtype(1)
            out[i] = K.segment(np.minimum, v, first, np.iinfo(dtype).max)
    return out


def _distinct(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(len(first)))


def _digests(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of mixed shingles and the set's size: equal sets, equal digests."""
    with np.errstate(over="ignore"):
        n = np.diff(first).astype(K.U64)
        lo = K.segment(np.add, K.mix64(s ^ K.U64(0xA5A5A5A5DEADBEEF)), first, 0)
        hi = K.segment(np.add, K.mix64(K.mix64(s) + K.U64(0x6A09E667F3BCC909)), first, 0)
        return K.mix64(lo + n), K.mix64(hi ^ (n << K.U64(32)))


def _nodes(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """n x 16 bytes: the digests as binary node ids."""
    lo, hi = _digests(s, first)
    return np.ascontiguousarray(np.stack([hi, lo], axis=1)).view(np.uint8).reshape(-1, 16)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, type=pa.int32()), pa.array(values.view(np.int64)))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, k: int = 32) -> DataFrame:
    """``doc_id, n_shingles, node`` (16 bytes, null for an empty set), ``keys`` (k posting keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = K.seeds(k, 31)[:, None]
        for batch in batches:
            for i, j, raw, offsets in K.chunks(batch.column(1)):
                g, gf = K.ngrams(*K.words(raw, offsets), shingle, whole_if_short=True)
                s, first = _distinct(g, gf)
                n = np.diff(first)
                with np.errstate(over="ignore"):
                    keys = K.mix64(_signature(s, first, k, 21, np.uint64) + salt).T[n > 0]
                sizes = np.where(n > 0, k, 0)
                node = _binary(_nodes(s, first))
                node = pa.array([None if x == 0 else y for x, y in zip(n.tolist(), node.to_pylist())], type=pa.binary())
                keys = _lists(np.ascontiguousarray(keys).reshape(-1), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, type=pa.int64()), node, keys], names=["doc_id", "n_shingles", "node", "keys"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(K.tidy(run), "doc_id long, n_shingles long, node binary, keys array<long>")


def _posted(values: np.ndarray) -> np.ndarray:
    """The posted coordinates (k x documents) as rows of k four-byte values: equal postings stay equal."""
    return np.ascontiguousarray((K.mix64(values) >> K.U64(32)).astype(np.uint32).T).view(np.uint8)


def shingle_sets(docs: DataFrame, shingle: int, k: int, k2: int) -> DataFrame:
    """``node, shingles`` (sorted, distinct), ``posts`` (k four-byte posted coordinates) and ``sig`` (k2 one-byte coordinates) of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in K.chunks(batch.column(0)):
                g, gf = K.ngrams(*K.words(raw, offsets), shingle, whole_if_short=True)
                s, first = _distinct(g, gf)
                sig = (K.mix64(_signature(s, first, k2, 41, np.uint32).astype(K.U64)) & K.U64(255)).astype(np.uint8).T
                posts = _posted(_signature(s, first, k, 21, np.uint64))
                yield pa.RecordBatch.from_arrays([_binary(_nodes(s, first)), _lists(s, first), _binary(posts), _binary(sig)], names=["node", "shingles", "posts", "sig"])

    return docs.select("text").mapInArrow(K.tidy(run), "node binary, shingles array<long>, posts binary, sig binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, threshold: int = 0) -> DataFrame:
    """Those of the pairs ``u, v`` that collide in ``threshold`` or more posted coordinates and whose
    full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"), F.col("posts").alias("pu"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"), F.col("posts").alias("pv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a_val, a_off), (b_val, b_off) = (_list_parts(batch.column(c)) for c in (2, 3))
            keep = np.zeros(batch.num_rows, dtype=bool)
            if not batch.num_rows:
                continue
            enough = (_rows(batch.column(4)).view(np.uint32) == _rows(batch.column(5)).view(np.uint32)).sum(axis=1) >= threshold
            for r in np.flatnonzero(enough).tolist():
                x, y = a_val[a_off[r] : a_off[r + 1]], b_val[b_off[r] : b_off[r + 1]]
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large) or not len(small):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                keep[r] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "su", "sv", "pu", "pv").mapInArrow(K.tidy(run), "u binary, v binary")


def _list_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = col.values.to_numpy(zero_copy_only=False).view(K.U64)
    return values, col.offsets.to_numpy()


def _cell_pairs(threshold: int, threshold2: int) -> functools.partial:
    return functools.partial(_pairs_of_cell, threshold=threshold, threshold2=threshold2)


def _rows(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length binary values as an array of byte rows."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(len(col), -1)


def _pairs_of_cell(cell: pa.Table, threshold: int, threshold2: int) -> pa.RecordBatch | None:
    """Pairs of different components with ``threshold`` collisions of posted coordinates and ``threshold2`` equal bytes, in their first common list only."""
    n = cell.num_rows
    if n < 2:
        return None
    key = cell["key"][0].as_py()
    cross = cell["cross"][0].as_py()
    block = cell["b"].to_numpy()
    root = np.unique(np.array(cell["root"].to_pylist(), dtype=object), return_inverse=True)[1]
    posts, sig = _rows(cell["posts"]).view(np.uint32), _rows(cell["sig"])
    lists = [frozenset(x) for x in cell["prefix"].to_pylist()]
    node = cell["node"].to_pylist()
    us, vs = [], []
    for i in range(n - 1):
        j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & ((block[i + 1 :] != block[i]) if cross else True))
        if not len(j):
            continue
        j = j[(posts[j] == posts[i]).sum(axis=1) >= threshold]
        j = j[(sig[j] == sig[i]).sum(axis=1) >= threshold2]
        for x in j.tolist():
            if min(lists[i] & lists[x]) == key and node[i] != node[x]:
                us.append(node[i])
                vs.append(node[x])
    if not us:
        return None
    return pa.RecordBatch.from_arrays([pa.array(us, type=pa.binary()), pa.array(vs, type=pa.binary())], names=["u", "v"])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 85, k: int = 32, k2: int = 1024) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the set holds the distinct shingles of
    ``shingle`` words, or the whole sequence of a shorter text.  Sets with 100 * intersection >=
    ``percent`` * union are linked; ``component_id`` is the least doc_id reachable.  Null, empty and
    blank texts have an empty set and are linked with nothing.  A row with a null doc_id is linked
    with nothing and has a null component_id and ``kept`` true.  Repeated rows are copies of each
    other.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    t = match_threshold(k, percent / 100)
    t2 = match_threshold(k2, percent / 100, MISS2)
    prints = C.stage(fingerprints(docs, text, doc_id, shingle, k), "mh-prints")

    linked = prints.where("node is not null and doc_id is not null")
    reps = linked.groupBy("node").agg(F.min(F.struct("doc_id", "keys")).alias("r")).select("node", F.col("r.doc_id").alias("rep"), F.col("r.keys").alias("keys"))
    postings = reps.select("node", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1")
    prefixes = (
        postings.join(C.dealt_again(shared, "key", "listed"), F.col("key") == F.col("listed"))
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("cnt", "key"))).alias("lists"), F.sum("cnt").alias("weight"))
        .where(F.size("lists") >= t)
        .withColumn("prefix", F.expr(f"slice(lists, 1, size(lists) - {t} + 1)"))
        .select("node", "weight", "prefix")
    )
    prefixes = C.stage(prefixes.join(reps.select("node", "rep"), "node"), "mh-prefixes")

    wanted = prefixes.select(F.col("rep").alias("_rep")).distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"))
    texts = texts.where(C.likely_in(wanted, "_rep")(F.col("_id")))
    sets = shingle_sets(texts.join(wanted, F.col("_id") == F.col("_rep"), "left_semi"), shingle, k, k2)
    sets = C.stage(sets.dropDuplicates(["node"]), "mh-sets")

    # each class against the heaviest class of each of its lists
    rows = prefixes.select("node", "weight", F.explode("prefix").alias("p")).select("node", "weight", "p.key")
    centre = rows.groupBy("key").agg(F.max(F.struct("weight", "node")).getField("node").alias("centre"))
    star = rows.join(C.dealt_again(centre, "key", "listed"), F.col("key") == F.col("listed")).where("node != centre").select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v")).distinct()
    links = C.stage(confirmed(star, sets, percent, t), "mh-links")
    roots = C.components(links, "mh-star")

    # what is left: pairs of different components in the same list
    labelled = prefixes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("prefix.key").alias("prefix"))
    labelled = C.stage(labelled.join(sets.select("node", "posts", "sig"), "node"), "mh-labelled")
    flat = labelled.select(F.explode("prefix").alias("key"), "node", "root")
    mixed = flat.groupBy("key").agg(F.count("*").alias("cnt"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key", "cnt")
    members = labelled.withColumn("key", F.explode("prefix")).join(C.dealt_again(mixed, "key", "listed"), F.col("key") == F.col("listed")).drop("listed")
    cells = C.block_cells(members, "key", "cnt", F.xxhash64("node"), BLOCK)
    rest = C.map_groups(cells, "cell", _cell_pairs(t, t2), "u binary, v binary")
    more = C.stage(confirmed(rest, sets, percent, t), "mh-more")
    joined = roots.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = C.components(joined.unionByName(more), "mh-all")

    least = reps.select("node", "rep").join(roots, "node").groupBy("root").agg(F.min("rep").alias("component"))
    grouped = roots.join(C.dealt_again(least, "root", "r"), F.col("root") == F.col("r")).select("node", "component")
    own = reps.select("node", "rep").join(grouped, "node", "left").select("node", F.coalesce("component", "rep").alias("component"))
    return (
        prints.select("doc_id", "n_shingles", "node")
        .join(C.dealt_again(own, "node", "own"), F.col("node") == F.col("own"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )

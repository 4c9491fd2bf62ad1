"""SimHash fingerprints and search within a Hamming radius by block tables that are probed around each query."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import kernels as K

WORD_WEIGHT, PAIR_WEIGHT = 1, 4  # votes of a word and of two adjacent words
BLOCK = 4096  # fingerprints of one table key compared at once in a task
SIMILAR = 18  # bits of 128 within which texts of 5-word Jaccard 0.8 or more lie, but for a few (see README)
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1).astype(np.float32)


def fingerprint_rows(raw: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """n x bits/8 bytes.  Each word and each pair of adjacent words votes with the signs of its
    hash's bits; a bit is set where the votes are positive.  A text without words gives zeros."""
    h, first = K.words(raw, offsets)
    pairs, pairs_first = K.ngrams(h, first, 2)
    n = len(offsets) - 1
    out = np.zeros((n, bits // 8), dtype=np.uint8)
    parts = [(x, np.repeat(np.arange(n) * 256, np.diff(f)), w) for x, f, w in ((h, first, WORD_WEIGHT), (pairs, pairs_first, PAIR_WEIGHT)) if len(x)]
    for q, salt in enumerate(K.seeds(bits // 64, 51)):
        hashes = [(K.mix64(x ^ salt).view(np.uint8).reshape(-1, 8), at, w) for x, at, w in parts]
        for b in range(8):
            counts = np.zeros(n * 256)
            for x, at, w in hashes:
                counts += np.bincount(at + x[:, b], minlength=n * 256) * w
            votes = counts.reshape(n, 256) @ _SIGNS
            out[:, q * 8 + b] = np.packbits(votes > 0, axis=1)[:, 0]
    return out


def fingerprints_of(texts: pa.Array, bits: int) -> np.ndarray:
    return np.concatenate([fingerprint_rows(raw, offsets, bits) for _, _, raw, offsets in K.chunks(texts)] or [np.zeros((0, bits // 8), np.uint8)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - Hamming distance / bits, row by row."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / (a.shape[1] * 8.0)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 128) -> DataFrame:
    """``doc_id, fingerprint`` (lowercase hex) of every row; a null text counts as empty."""
    C.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = fingerprints_of(batch.column(1), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), _hex(f)], names=["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(K.tidy(run), "doc_id long, fingerprint string")


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in rows], type=pa.string())


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: pa.Array, own: list[str], following: list[str], own_f: np.ndarray, next_f: np.ndarray, bits: int) -> list[pa.Array]:
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, following)]
    f = fingerprints_of(pa.array(edited, type=pa.large_string()), bits)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
    return [ids, pa.array([len(x) for x in own], type=pa.int64()), pa.array(sha, type=pa.string()), _hex(own_f), _hex(f), pa.array(likeness(own_f, f)), pa.array(likeness(own_f, next_f))]


def fingerprint_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 128) -> DataFrame:
    """Fingerprint of each text, of its edited text, and how near they and the next document are.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  The
    edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document in ascending (doc_id, text); the last document's next is the first.  A
    null text counts as empty; null doc_ids come first; of repeated rows one follows the other.
    A single row is its own next; an empty table gives no rows.  Other columns are not read.

    The rows are dealt by ranges of doc_id, so a task streams its range in order and holds one batch;
    only a range's first and last row meet again, one row a task, to find what follows.
    """
    spark = docs.sparkSession
    C.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the row whose next row is not seen yet
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])

        def edge(row: pa.RecordBatch, kind: int) -> pa.RecordBatch:
            null = [pa.nulls(1, t) for t in schema.types[1:7]]
            return pa.RecordBatch.from_arrays([row.column(0), *null, pa.array([kind], pa.int32()), row.column(2), row.column(1).cast(pa.string())], schema=schema)

        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = batch.slice(a, 1000)
                if held is None:
                    yield edge(rows.slice(0, 1), 2)
                else:
                    rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                n = rows.num_rows - 1
                held = rows.slice(n, 1)
                if n:
                    texts = [x or "" for x in rows.column(1).to_pylist()]
                    f = fingerprints_of(rows.column(1), bits)
                    out = _compared(rows.column(0).slice(0, n), texts[:-1], texts[1:], f[:-1], f[1:], bits)
                    yield pa.RecordBatch.from_arrays([*out, pa.array(np.zeros(n, np.int32)), rows.column(2).slice(0, n), pa.nulls(n, pa.string())], schema=schema)
        if held is not None:
            yield edge(held, 1)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, following = ([x or "" for x in batch.column(c).to_pylist()] for c in (1, 2))
            yield pa.RecordBatch.from_arrays(_compared(batch.column(0), own, following, fingerprints_of(batch.column(1), bits), fingerprints_of(batch.column(2), bits), bits), names=_NAMES)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ranged = rows.repartitionByRange(C.shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    done = C.stage(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(K.tidy(run), f"{_OUT}, kind int, part int, text string"), "simhash-ranges")
    edges = done.where("kind > 0").groupBy("part").agg(
        F.max(F.when(F.col("kind") == 2, F.struct(F.lit(1), F.coalesce("text", F.lit(""))))).alias("first"),
        F.max(F.when(F.col("kind") == 1, F.struct(F.lit(1), "doc_id", "text"))).alias("last"),
    )  # one row a task of the step above
    w = Window.orderBy("part")
    following = F.coalesce(F.lead("first").over(w), F.first("first").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = edges.select(F.col("last.doc_id").alias("doc_id"), F.col("last.text").alias("text"), following["col2"].alias("next")).mapInArrow(last, _OUT)
    return done.where("kind = 0").select(*_NAMES).unionByName(ends)


_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def block_bounds(bits: int, blocks: int) -> list[tuple[int, int]]:
    return [(i * bits // blocks, (i + 1) * bits // blocks) for i in range(blocks)]


def block_values(rows: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The bits of each block as a uint64."""
    bits = np.unpackbits(rows, axis=1)
    values = []
    for a, b in block_bounds(rows.shape[1] * 8, blocks):
        v = np.zeros(len(rows), dtype=K.U64)
        for c in range(a, b):
            v = (v << K.U64(1)) | bits[:, c]
        values.append(v)
    return values


def table_keys(rows: np.ndarray, radius: int, blocks: int) -> np.ndarray:
    """n x tables uint64: one table for each choice of ``blocks - radius`` blocks.

    Fingerprints within ``radius`` differ in at most that many blocks, so they agree in all
    blocks of at least one table, whose key is the hash of those blocks' bits.
    """
    words = block_values(rows, blocks)
    keys = []
    with np.errstate(over="ignore"):
        for t, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
            k = np.full(len(rows), t + 1, dtype=K.U64)
            for c in chosen:
                k = K.mix64(k * K.U64(0x9E3779B97F4A7C15) + words[c])
            keys.append(k)
    return np.stack(keys, axis=1) if len(rows) else np.zeros((0, len(keys)), K.U64)


def block_radii(radius: int, blocks: int) -> list[int]:
    """How many bits of each block a probe flips: of two fingerprints within ``radius`` some block is as near as that.

    Were every block farther apart, they would differ in sum(radii + 1) = radius + 1 bits.
    """
    return [(radius + 1) // blocks - 1 + (t < (radius + 1) % blocks) for t in range(blocks)]


def _n_probes(bits: int, radius: int, blocks: int) -> list[tuple[int, int]]:
    """Bits and number of probes of each block."""
    widths = [b - a for a, b in block_bounds(bits, blocks)]
    return [(w, sum(math.comb(w, k) for k in range(r + 1))) for w, r in zip(widths, block_radii(radius, blocks))]


def block_count(rows: int, queries: int, bits: int, radius: int) -> int:
    """The number of blocks with the least work for rows in tables, probes, and pairs that meet by chance; none loses a pair."""

    def work(blocks: int) -> float:
        probes = _n_probes(bits, radius, blocks)
        return 150 * (rows * blocks + queries * sum(n for _, n in probes)) + rows * queries * sum(n / 2.0**w for w, n in probes)

    least = -(-bits // 48)  # a key has room for 48 bits of a block; blocks beyond radius + 1 get no probes
    return min(range(least, max(min(radius + 1, bits), least) + 1), key=work)


def probe_keys(rows: np.ndarray, radius: int, blocks: int) -> np.ndarray:
    """n x probes int64 keys: each block's number and its bits with up to its radius of them flipped."""
    keys = []
    for t, ((width, _), r, v) in enumerate(zip(_n_probes(rows.shape[1] * 8, radius, blocks), block_radii(radius, blocks), block_values(rows, blocks))):
        flips = np.array([sum(1 << c for c in chosen) for k in range(r + 1) for chosen in itertools.combinations(range(width), k)], dtype=K.U64)
        keys.append(K.U64(t << 48) | (v[:, None] ^ flips))
    return np.concatenate(keys, axis=1).view(np.int64)


def _bytes(hexes: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(hexes)), dtype=np.uint8).reshape(len(hexes), -1)


def _met(cells: pa.Table, words: list[str], radius: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """For each probe of whole cells, sorted by cell with the table's rows first, what lies within the radius and met here first."""
    key, part, probe = (cells[c].to_numpy() for c in ("key", "part", "probe"))
    f = np.stack([cells[c].to_numpy() for c in words], axis=1).view(K.U64)
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
    cell = np.cumsum(np.bincount(new, minlength=len(key))) - 1
    n_rows = np.add.reduceat(1 - probe, new)[cell]  # of the table in each row's cell
    asked = np.flatnonzero((probe == 1) & (n_rows > 0))
    bounds = np.array([a for a, _ in block_bounds(64 * len(words), blocks)])
    radii = np.array(block_radii(radius, blocks))
    upto = np.cumsum(n_rows[asked])
    while len(asked):
        k = max(1, int(np.searchsorted(upto - (upto[0] - n_rows[asked[0]]), 1 << 19)))  # probes handled at once
        q, n = asked[:k], n_rows[asked[:k]]
        at = np.repeat(q, n)
        other = np.repeat(new[cell[q]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        distance = np.bitwise_count(f[at] ^ f[other]).sum(axis=1)
        near = np.flatnonzero((distance <= radius) & (distance > 0))
        at, other, distance = at[near], other[near], distance[near]
        if len(at):
            apart = np.add.reduceat(np.unpackbits((f[at] ^ f[other]).view(np.uint8), axis=1), bounds, axis=1, dtype=np.int64)
            first = (apart <= radii).argmax(axis=1) == (key[at] >> 48)
            at, other, distance = at[first], other[first], distance[first]
        if len(at):
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            near = pa.StructArray.from_arrays(
                [cells["rep"].take(pa.array(other)).combine_chunks(), _hex(f[other].view(np.uint8)), pa.array(distance.astype(np.int32)), cells["copies"].take(pa.array(other)).combine_chunks()],
                names=["doc_id", "fingerprint", "distance", "copies"],
            )
            offsets = pa.array(np.append(starts, len(at)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([_hex(f[at[starts]].view(np.uint8)), pa.ListArray.from_arrays(offsets, near)], names=["fp", "near"])
        asked, upto = asked[k:], upto[k:]


NEAR = "array<struct<doc_id: long, fingerprint: string, distance: int, copies: long>>"


def near_fingerprints(prints: DataFrame, queries: str, radius: int = SIMILAR, blocks: int | None = None) -> DataFrame:
    """``fp, copies, near``: for each distinct fingerprint of a query row, all other fingerprints within ``radius``.

    ``prints`` has columns ``doc_id`` and ``fingerprint`` (hex, a multiple of 64 bits); ``queries`` is a boolean SQL
    condition on its columns.  ``near`` has one entry for each other distinct fingerprint: its least doc_id, itself,
    the distance in bits and the number of rows that have it; ``copies`` counts the rows of ``fp`` itself.

    The search covers all rows and misses none.  Every distinct fingerprint lies once in a table for each block of its
    bits, and a query looks up all values of a block that are as near as ``block_radii`` says.  Table keys with many rows are
    split into blocks; pairs count in the first table they meet in.
    """
    spark = prints.sparkSession
    classes = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("copies"), F.max(F.coalesce(F.expr(queries), F.lit(False))).alias("query"), F.min("doc_id").alias("rep"))
    classes = C.stage(classes, "simhash-classes")
    rows, asked, digits = classes.agg(F.count("*"), F.count_if("query"), F.max(F.length("fp"))).first()
    bits = 4 * (digits or 32)
    blocks = blocks or block_count(rows, asked, bits, radius)
    words = [f"f{i}" for i in range(bits // 64)]
    n_probes = sum(n for _, n in _n_probes(bits, radius, blocks))

    def keyed(batch: pa.RecordBatch, keys: np.ndarray, probe: int) -> pa.RecordBatch:
        n, m = keys.shape
        f = np.repeat(_bytes(batch.column(0).to_pylist()).view(np.int64), m, axis=0)
        at = pa.array(np.repeat(np.arange(n), m))
        rest = [pa.nulls(n * m, pa.int64())] * 2 if probe else [batch.column(c).take(at) for c in (1, 3)]
        return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.full(n * m, probe, np.int32)), *(pa.array(np.ascontiguousarray(f[:, i])) for i in range(len(words))), *rest], names=["key", "probe", *words, "copies", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = block_values(_bytes(batch.column(0).to_pylist()), blocks) if batch.num_rows else []
            if values:
                yield keyed(batch, np.stack([K.U64(t << 48) | v for t, v in enumerate(values)], axis=1).view(np.int64), 0)
            queries = batch.filter(batch.column(2))
            step = max(1, (1 << 17) // n_probes)
            for a in range(0, queries.num_rows, step):
                some = queries.slice(a, step)
                yield keyed(some, probe_keys(_bytes(some.column(0).to_pylist()), radius, blocks), 1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a cell that may go on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([*held, batch])
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from _met(table.slice(0, cut), words, radius, blocks)
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from _met(pa.Table.from_batches(held), words, radius, blocks)

    schema = ", ".join(["key long, probe int", *(f"{w} long" for w in words), "copies long, rep long"])
    met = classes.mapInArrow(K.tidy(run), schema)
    # counted on one fingerprint in 16: the sizes only say how a key's rows are dealt
    some = met.where(F.pmod(F.xxhash64(*words), F.lit(16)) == 3).groupBy("key").agg((16 * F.count_if(F.col("probe") == 0)).alias("n0"), (16 * F.count_if(F.col("probe") == 1)).alias("n1"))
    large = some.select(F.col("key").alias("large"), F.ceil(F.col("n0") / BLOCK).cast("int").alias("b0"), F.ceil(F.col("n1") / BLOCK).cast("int").alias("b1")).where("b0 > 1 or b1 > 1")
    large = large.withColumns({"b0": F.greatest("b0", F.lit(1)), "b1": F.greatest("b1", F.lit(1))})
    dealt = met.join(F.broadcast(C.stage(large, "simhash-large")), F.col("key") == F.col("large"), "left")
    # cell (i, j) of a key holds the i-th block of its rows and the j-th of its probes
    own = F.pmod(F.xxhash64(*words, F.lit(7)), F.when(F.col("probe") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int")
    parts = F.when(F.col("probe") == 0, F.transform(F.sequence(F.lit(0), F.col("b1") - 1), lambda j: own * F.col("b1") + j)).otherwise(F.transform(F.sequence(F.lit(0), F.col("b0") - 1), lambda i: i * F.col("b1") + own))
    dealt = dealt.withColumn("part", F.explode(F.coalesce(parts, F.array(F.lit(0))))).drop("large", "b0", "b1")
    sorted_cells = dealt.repartition(C.shuffle_width(spark), "key", "part").sortWithinPartitions("key", "part", "probe")
    found = sorted_cells.mapInArrow(K.tidy(cells), f"fp string, near {NEAR}").groupBy("fp").agg(F.flatten(F.collect_list("near")).alias("near"))
    return classes.where("query").select("fp", "copies").join(found, "fp", "left").withColumn("near", F.coalesce("near", F.array().cast(NEAR)))


def rows_within(near: str, copies: str, radius: int) -> Column:
    """How many other rows lie within ``radius`` (at most that of the search) of a fingerprint of ``copies`` rows."""
    return F.expr(f"aggregate({near}, {copies} - 1L, (n, x) -> n + if(x.distance <= {radius}, x.copies, 0L))")


def count_within(prints: DataFrame, queries: str, radius: int = 6, blocks: int | None = None) -> DataFrame:
    """``fp, n_near``: for each distinct fingerprint of a query row, how many other rows lie within ``radius``."""
    return near_fingerprints(prints, queries, radius, blocks).select("fp", rows_within("near", "copies", radius).alias("n_near"))

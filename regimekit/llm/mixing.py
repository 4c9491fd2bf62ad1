"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a number of words; every document of it is to be copied ``target / size of the
source`` times on average.  The whole part is certain.  For the fractional parts, pairs of
documents exchange mass (fraction x words) at random until one of the two is integral, so each
document keeps its expected number of copies and the source's words stay put.  The pairing runs in
buckets of a source; the one document of a bucket that stays fractional goes on to the next level
of a reduction tree.  At the root waits a reserve, a bounded random sample of the source's fractional
documents: the last open document is settled by its own draw and the difference is spread over the
reserve, which is then rounded from the longest to the shortest document.  So the source's words miss the target by a
short document at most, where a plain root would leave up to the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import kernels as K

RESERVE = 256  # expected documents of a source that wait at the root (at most half of them)
ALIKE = 4096  # numbers of equal rows made at once
FAN_IN = 32  # fractional documents that meet in one task group of the upper levels


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in ascending code-point order, null last, weigh ``weights`` in turn.  They share ``share`` times all
    sizes by weight; a target above ``most`` times its source's size is cut to that and the excess
    shared again by weight among the others, until none is above.
    """
    numbered = C.stage(_ranked(sources), "mix-sources")
    numbered = numbered.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    rate, capped = 0.0, -1  # words per unit of weight; each round fixes the sources found above
    while True:
        above = F.col("w") * F.lit(rate) >= cap
        r = numbered.agg(F.sum(F.when(above, cap).otherwise(0.0)).alias("fixed"), F.sum(F.when(above, 0.0).otherwise(F.col("w"))).alias("open"), F.count(F.when(above, 1)).alias("n")).first()
        if r["n"] == capped or not r["open"]:
            break
        capped, rate = r["n"], (share * total - r["fixed"]) / r["open"]
    return numbered.select("source", "source_size", F.least(F.col("w") * F.lit(rate), cap).alias("target"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` in order of source, null last, by ranges (no single task holds all sources)."""
    spark = sources.sparkSession
    dealt = sources.repartitionByRange(C.shuffle_width(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = C.stage(dealt, "mix-ranges")
    before = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row a task
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = dealt.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1)
    return inside.join(before, "part").select("source", "source_size", (F.col("r") + F.col("before")).alias("rank"))


def _uniform(tags: np.ndarray, level: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (K.mix64(tags.view(K.U64) + K.seeds(level + 1, seed)[level]) >> K.U64(11)).astype(np.float64) / 2**53


def pivotal(mass: list[float], size: list[float], draw: list[float]) -> tuple[list[float], int | None]:
    """Round the fractions ``mass / size`` in (0, 1) pair by pair; returns fractions and the one left open.

    ``draw`` are uniform numbers, one per document.  A pair's words ``size * fraction`` are kept: either one
    takes what the other gives until a fraction reaches 0 or 1, with the chances that
    keep both expectations.
    """
    p = [m / s for m, s in zip(mass, size)]
    open_: int | None = None
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if open_ is None:
            open_ = i
            continue
        j = open_
        up = min((1 - p[i]) * size[i], p[j] * size[j])  # words that i may take from j
        down = min(p[i] * size[i], (1 - p[j]) * size[j])  # words that i may give to j
        move = up if draw[i] * (up + down) < down else -down
        full_i = (1 - p[i]) * size[i] <= p[j] * size[j] if move > 0 else p[i] * size[i] <= (1 - p[j]) * size[j]
        if full_i:  # i becomes integral
            p[j] = min(1.0, max(0.0, p[j] - move / size[j]))
            p[i] = 1.0 if move > 0 else 0.0
        else:
            p[i] = min(1.0, max(0.0, p[i] + move / size[i]))
            p[j] = 0.0 if move > 0 else 1.0
        open_ = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else None
    return p, open_


def settle(p: list[float], size: list[float], draw: list[float]) -> list[float]:
    """Round all fractions, longest document first, each by its own draw.

    The words a document gains or loses are spread over the shorter ones in proportion to
    ``min(p, 1 - p)``, the same either way, so expectations stay.  Where the shorter ones have too little
    room the rest is rounded pair by pair, and the last one by its draw.
    """
    q, s = np.array(p), np.array(size)
    for i in range(len(q)):
        if not 0.0 < q[i] < 1.0:
            continue
        slack = np.minimum(q[i + 1 :], 1 - q[i + 1 :])
        room = float((slack * s[i + 1 :]).sum())
        if max(q[i], 1 - q[i]) * s[i] > room:
            break
        x = 1.0 if draw[i] < q[i] else 0.0
        q[i + 1 :] = np.clip(q[i + 1 :] + slack * ((q[i] - x) * s[i] / room), 0.0, 1.0)
        q[i] = x
    out, left = pivotal((q * s).tolist(), size, draw)
    if left is not None:
        out[left] = 1.0 if draw[left] < out[left] else 0.0
    return out


_ROW = "tag long, doc_id long, source string, size long, source_size long, target double, whole long, p double, bucket long, reserve boolean, open boolean"


def _level(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(group: pa.Table) -> pa.RecordBatch:
        # long documents first; the reserve, which only the root has, after the others
        reserve = group["reserve"].to_numpy(zero_copy_only=False)
        group = group.take(pa.array(np.lexsort((group["tag"].to_numpy(), -group["size"].to_numpy(), reserve))))
        size, p = group["size"].to_numpy().astype(float), group["p"].to_numpy()
        draw = _uniform(group["tag"].to_numpy(), level, seed)
        n = int((~reserve).sum())
        out, left = pivotal((p[:n] * size[:n]).tolist(), size[:n].tolist(), draw[:n].tolist())
        p = np.concatenate([out, p[n:]])
        if last:
            order = np.argsort(-size, kind="stable")
            p[order] = settle(p[order].tolist(), size[order].tolist(), _uniform(group["tag"].to_numpy(), level + 64, seed)[order].tolist())
            left = None
        is_open = np.zeros(len(p), dtype=bool)
        if left is not None:
            is_open[left] = True
        table = group.select([n for n in names if n not in ("p", "open")])
        cols = {n: table[n].combine_chunks() for n in table.column_names} | {"p": pa.array(p), "open": pa.array(is_open)}
        return pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    keyed = rows.withColumn("cell", F.xxhash64("source", F.col("source").isNull(), "bucket"))
    return C.stage(C.map_groups(keyed, "cell", run, _ROW), f"mix-level{level}")


def size_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""

    def count(t: pa.Array) -> pa.Array:
        out = pa.array(K.word_counts(t))
        K.give_back()
        return out

    return F.arrow_udf(count, "long")(text.cast("string"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 3, bucket_rows: int = 4096, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: how many of each document's words the mix takes.

    ``size`` is the number of words, ``taken`` a whole multiple of it, at most ``ceil(most)`` times.  Reruns agree:
    draws depend on doc_id, size, source and seed only.  A null text has size 0 and is not taken; a
    null source is a source of its own, ordered last.  Rows of equal doc_id, size and source are numbered
    by their count and are separate documents with draws and buckets of their own.  Rows with a null doc_id take part.  An empty table gives no rows.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"))
    sized = C.stage(sized, "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = C.stage(source_targets(sources.select("source", "source_size"), weights, share, most), "mix-targets")
    targets = targets.join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "n")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    # rows that agree in all three columns can't be told apart, so their count says all: no window holds them, and their numbers come in blocks
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_alike"))
    blocks = alike.withColumn("block", F.explode(F.expr(f"sequence(0L, (n_alike - 1) div {ALIKE})")))
    numbered = blocks.withColumn("nth", F.explode(F.expr(f"sequence(block * {ALIKE}, least((block + 1) * {ALIKE}, n_alike) - 1)"))).select("doc_id", "source", "size", "nth")
    rows = (
        numbered.join(targets, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
        .withColumn("whole", F.floor("rate"))
        .withColumn("p", F.col("rate") - F.col("whole"))
        .withColumn("tag", F.xxhash64("doc_id", "size", "source", "nth"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit(seed)), F.ceil(F.col("n") / bucket_rows)))
        .withColumn("open", (F.col("p") > 0) & (F.col("p") < 1))
        .withColumn("reserve", F.pmod(F.xxhash64("tag", F.lit(seed)), F.lit(1 << 40)) < F.least(F.lit(0.5), F.lit(float(RESERVE)) / F.col("n")) * float(1 << 40))
        .select(*[x.split()[0] for x in _ROW.split(", ")])
    )
    rows = C.stage(rows, "mix-rows")
    done = [rows.where("not open")]
    open_, widest = rows.where("open and not reserve"), rows.agg(F.max("bucket")).first()[0]
    waiting = rows.where("open and reserve").withColumn("bucket", F.lit(0).cast("long"))
    level = 0
    while widest is not None:
        last = widest == 0
        out = _level(open_.unionByName(waiting) if last else open_, level, last, seed)
        done.append(out.where("not open"))
        open_ = out.where("open").withColumn("bucket", F.expr(f"bucket div {FAN_IN}"))
        if last:
            break
        widest //= FAN_IN
        level += 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.select("doc_id", "source", "size", "source_size", "target", ((F.col("whole") + F.col("p").cast("long")) * F.col("size")).alias("taken"))

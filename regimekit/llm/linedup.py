"""Line dedup by pairwise patience alignment.

A block is a stretch of adjacent lines (blank ones left out) of ``min_words`` words or more, so short
lines count in it too.  Documents overlap through the hashes of their shortest such runs, at most two a line: each
run that an earlier document holds pairs its document with the first that does, so the number of
(line, line) points is linear in the input and no hot line makes more than one pair a document.

The points of a pair are aligned as patience diff does: the longest increasing sequence of the rare runs (``RARE``
copies at most) are the anchors, and the common ones fill the gaps between them.  The aligned blocks are deleted
from the later document, and what is left of the pair is aligned again in rounds until nothing aligns, whatever
the order of the lines and however often they come.  So every line of a later document that lies in a
block of an earlier one goes, and every other line stays.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import kernels as K

RARE = 8  # runs with at most so many copies anchor the alignment; the others are aligned between and after them


def _tag(text: Column) -> Column:
    """Tells texts of one doc_id apart, should it repeat."""
    return F.xxhash64(text)


def _runs(h: np.ndarray, n: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, number of lines and hash of the shortest runs of ``min_words`` words that start or end at a line."""
    total = len(h)
    end, at = np.cumsum(n), np.arange(total)
    start = end - n
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    to = np.searchsorted(end, start + min_words)  # the run that starts at a line ends here
    ok = (to < total) & (to < first[1:][doc])
    since = np.searchsorted(start, end - min_words, side="right") - 1  # the run that ends at a line starts here
    back = since >= first[:-1][doc]
    back[back] = to[since[back]] != at[back]
    a, z = np.concatenate([at[ok], since[back]]), np.concatenate([to[ok], at[back]])
    acc = (z - a + 1).astype(K.U64)
    with np.errstate(over="ignore"):
        for k, salt in enumerate(K.seeds(min_words, 53)):  # every line has a word, so a run has at most min_words lines
            inside = np.flatnonzero(a + k <= z)
            acc[inside] += h[a[inside] + k] * (salt | K.U64(1))
        return a, z - a + 1, K.mix64(acc)


def _first_copies(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a run is the first of its hash in its document; ``doc`` and places ascend in each half of the runs."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    out = np.zeros(len(h), dtype=bool)
    out[order] = new
    return out


def line_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, tag, h, line, n, lead`` of (doc_id, tag, text) rows: each shortest run's hash, first line's number (among lines with words), lines, and whether it is its document's first with that hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, raw, offsets in K.chunks(batch.column(2)):
                h, n, first = K.lines(raw, offsets)
                a, lines, runs = _runs(h, n, first, min_words)
                order = np.argsort(a, kind="stable")
                a, lines, runs = a[order], lines[order], runs[order]
                doc = np.searchsorted(first, a, side="right") - 1
                rows = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(runs.view(np.int64)), pa.array((a - first[doc]).astype(np.int32)), pa.array(lines.astype(np.int32)), pa.array(_first_copies(doc, runs))],
                    names=["doc_id", "tag", "h", "line", "n", "lead"],
                )

    return docs.select("doc_id", "tag", "text").mapInArrow(K.tidy(run), "doc_id long, tag long, h long, line int, n int, lead boolean")


def _increasing(ys: list[int]) -> list[int]:
    """Places of a longest strictly increasing sequence, by patience sorting."""
    tails: list[int] = []  # least last value of an increasing sequence of each length
    tail_at: list[int] = []
    back = [-1] * len(ys)
    for c, y in enumerate(ys):
        k = bisect.bisect_left(tails, y)
        back[c] = tail_at[k - 1] if k else -1
        if k == len(tails):
            tails.append(y)
            tail_at.append(c)
        else:
            tails[k], tail_at[k] = y, c
    out = []
    c = tail_at[-1] if tail_at else -1
    while c >= 0:
        out.append(c)
        c = back[c]
    return out[::-1]


def alignment_rounds(points: list[tuple[int, int]], rare: list[bool]) -> list[int]:
    """The round in which each point (line of the later, line of the earlier document) of a pair is aligned.

    Points are sorted by line, and by falling line of the earlier document among equal ones.  Round 0 is the patience
    alignment: rare points first, then the common ones inside the gaps.  The points it leaves fall into the fewest increasing
    sequences in one pass, so n points cost n log n however many rounds they need.
    """
    only = [i for i, r in enumerate(rare) if r]
    anchors = [only[k] for k in _increasing([points[i][1] for i in only])]
    held = set(anchors)
    start, low = 0, (-1, -1)
    for stop in [*anchors, len(points)]:
        high = points[stop] if stop < len(points) else (float("inf"), float("inf"))
        gap = [i for i in range(start, stop) if low[0] < points[i][0] < high[0] and low[1] < points[i][1] < high[1]]
        held.update(gap[k] for k in _increasing([points[i][1] for i in gap]))
        start, low = stop + 1, high
    ends: list[int] = []  # last line of each later round's sequence, negated: ascending
    out = [0] * len(points)
    for i, (_, y) in enumerate(points):
        if i not in held:
            k = bisect.bisect_right(ends, -y)
            if k == len(ends):
                ends.append(-y)
            else:
                ends[k] = -y
            out[i] = k + 1
    return out


def _merged(row: np.ndarray, pair: np.ndarray, rounds: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks ``(row, pair, line, line there, lines, round)``: runs of one round that overlap or touch on one diagonal."""
    order = np.lexsort((x, y - x, rounds, pair, row))
    row, pair, rounds, x, y, n = (v[order] for v in (row, pair, rounds, x, y, n))
    same = (row[1:] == row[:-1]) & (pair[1:] == pair[:-1]) & (rounds[1:] == rounds[:-1]) & (y[1:] - x[1:] == y[:-1] - x[:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    wide = int((x + n).max()) + 1
    end = np.maximum.accumulate(x + n + group * wide) - group * wide  # the furthest line so far on the diagonal
    new = np.concatenate([[True], ~same | (x[1:] > end[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(x)) - 1
    return row[at], pair[at], x[at], y[at], end[last] - x[at], rounds[at]


BLOCKS = "array<struct<earlier: long, line: int, at: int, lines: int, round: int>>"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of each later document to its aligned blocks and the lines that go."""
    for whole in batches:
        for r in range(0, whole.num_rows, 1024):
            batch = whole.slice(r, 1024)
            points = batch.column(2)
            sizes = points.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = points.flatten()
            earlier, x, n, y, rare = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("earlier", "line", "n", "at", "rare"))
            x, n, y = x.astype(np.int64), n.astype(np.int64), y.astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            order = np.lexsort((-n, -y, x, earlier, row))
            row, earlier, x, n, y, rare = (v[order] for v in (row, earlier, x, n, y, rare))
            pair_end = (row[1:] != row[:-1]) | (earlier[1:] != earlier[:-1])
            once = np.concatenate([[True], pair_end | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])  # of runs at the same place the longest
            row, earlier, x, n, y, rare = (v[once] for v in (row, earlier, x, n, y, rare))
            pair_end = (row[1:] != row[:-1]) | (earlier[1:] != earlier[:-1])
            cuts = np.concatenate([[0], np.flatnonzero(pair_end) + 1, [len(x)]])
            rounds = np.zeros(len(x), np.int64)
            crossing = np.flatnonzero(~pair_end & (y[1:] <= y[:-1])) + 1
            for k in np.unique(np.searchsorted(cuts, crossing, side="right") - 1).tolist():  # all other pairs align at once
                a, b = cuts[k], cuts[k + 1]
                rounds[a:b] = alignment_rounds(list(zip(x[a:b].tolist(), y[a:b].tolist())), rare[a:b].tolist())
            row, earlier, x, y, n, rounds = _merged(row, earlier, rounds, x, y, n)
            order = np.lexsort((y, earlier, x, rounds, row))
            row, earlier, x, y, n, rounds = (v[order] for v in (row, earlier, x, y, n, rounds))
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            fields = [pa.array(earlier), *(pa.array(v.astype(np.int32)) for v in (x, y, n, rounds))]
            found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["earlier", "line", "at", "lines", "round"]))
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gone = np.unique(np.stack([np.repeat(row, n), np.repeat(x, n) + inside]), axis=1)
            offsets = pa.array(np.searchsorted(gone[0], np.arange(batch.num_rows + 1)).astype(np.int32))
            lines = pa.ListArray.from_arrays(offsets, pa.array(gone[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lines, found], names=["doc_id", "tag", "gone", "blocks"])


def aligned_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, tag, gone, blocks``: of each later document with a repeated run, the numbers (among lines with words) of the lines to delete, ascending, and the aligned blocks by round.

    A block names the earlier document, the first line here and there, its lines and the round.  A task holds the
    points of one document at a time, two a line at most.  Copies of a run are aligned with its first in the earlier
    document; rows that repeat the earlier doc_id count as one document.
    """
    runs = C.stage(line_runs(docs, min_words), "line-runs")
    holders = runs.groupBy("h").agg(F.min("doc_id").alias("earlier"), F.max("doc_id").alias("last"), F.count("*").alias("copies"), F.expr("min_by(line, doc_id) FILTER (WHERE lead)").alias("at"))
    holders = holders.where("last > earlier").select("h", "earlier", "at", (F.col("copies") <= RARE).alias("rare"))
    found = runs.select("doc_id", "tag", "h", "line", "n").join(C.dealt_again(holders, "h", "held"), F.col("h") == F.col("held")).where("doc_id > earlier")
    points = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("earlier", "line", "n", "at", "rare")).alias("points"))
    return points.mapInArrow(K.tidy(_align), f"doc_id long, tag long, gone array<int>, blocks {BLOCKS}")


def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """The text without the lines of the given numbers, and how many words are left."""
    texts, left = [], []
    spaces = {ord(c): " " for c in "\t\x0b\x0c\r"}
    for t, g in zip(text.to_pylist(), gone.to_pylist()):
        drop, kept, n, words = set(g or ()), [], 0, 0
        for line in (t or "").split("\n"):
            count = len([w for w in line.translate(spaces).split(" ") if w])
            if count:
                n += 1
                if n - 1 in drop:
                    continue
            kept.append(line)
            words += count
        texts.append("\n".join(kept))
        left.append(words)
    out = pa.StructArray.from_arrays([pa.array(texts, type=pa.string()), pa.array(left, type=pa.int64())], names=["text", "n_words"])
    texts.clear()
    K.give_back()
    return out


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 5) -> DataFrame:
    """All rows and columns of ``docs`` with the aligned blocks deleted from ``text``, and three new columns.

    ``__deleted_lines`` counts the deleted lines, ``__left_words`` the words left and ``__blocks`` holds the aligned
    blocks (null where nothing was deleted).  The order of documents is that of doc_id; every line stays in the first
    document that holds it.  Texts without deletions, null ones included, stay as they are; so do rows
    with a null doc_id, and rows that repeat a doc_id are not compared with each other.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("tag", _tag(F.col("text")))
    gone = C.stage(aligned_lines(keyed, min_words), "line-gone").select(F.col("doc_id").alias("__d_id"), F.col("tag").alias("__d_tag"), F.col("gone").alias("__d_gone"), F.col("blocks").alias("__blocks"))
    # rows that surely have nothing to delete pass by; only the others, and a few more, meet the deletions
    likely = C.likely_in(gone, "__d_id")(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)))
    joined = docs.where(likely).join(gone, (F.col(doc_id).cast("long") == F.col("__d_id")) & (_tag(F.col(text).cast("string")) == F.col("__d_tag")), "left")
    hit = joined.where("__d_gone is not null").withColumn("__d_new", F.arrow_udf(_without, "struct<text: string, n_words: long>")(F.col(text).cast("string"), F.col("__d_gone")))
    hit = hit.withColumn(text, F.col("__d_new.text")).withColumn("__deleted_lines", F.size("__d_gone")).withColumn("__left_words", F.col("__d_new.n_words"))
    rest = joined.where("__d_gone is null").drop("__d_id", "__d_tag", "__d_gone", "__blocks").unionByName(docs.where(~likely))
    rest = rest.withColumn("__deleted_lines", F.lit(0)).withColumn("__left_words", F.lit(None).cast("long")).withColumn("__blocks", F.lit(None).cast(BLOCKS))
    columns = [*docs.columns, "__deleted_lines", "__left_words", "__blocks"]
    return hit.select(*columns).unionByName(rest.select(*columns))

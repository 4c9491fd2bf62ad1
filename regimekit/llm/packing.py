"""Packing of tokenised documents into fixed-length training sequences.

Tokenising runs once over the texts and writes one small row per piece.  How many pieces of each
length there are (at most ``capacity`` counts, whatever the number of documents) is all the
packing needs: ``plan`` matches large lengths two by two, fits small lengths into the gaps,
whole ranges of equal bins at a time, and says which ranks of a length go to which bins.  Spark
numbers the pieces of each length and looks their place up.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import kernels as K

CACHE_IDS = 6_000_000  # token ids of distinct words a Python worker remembers; only memory depends on it


GROUP = 256  # plain words encoded as one text
# letters that stay one letter in lower case, and punctuation (no apostrophe) after them
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+([-.,:;!?*#$%&()/]+)?").fullmatch


class WordTokens:
    """Token ids by word.  The tokenizer never joins text across ASCII white space, so a text's
    ids are those of its words in order.  Words are told apart by 64-bit hashes of their bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.count, self.ids = np.zeros(0, K.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has.

        Plain letters are one piece of the pre-tokenizer and punctuation after them another; the last id of a
        piece, and no other, ends a word in the vocabulary.  So many such words are encoded as one text and
        cut apart at those ids.
        """
        plain, alone, pieces_of = [], [], []
        for k, t in enumerate(texts):
            if m := _PLAIN(t):
                plain.append(k)
                pieces_of.append(2 if m[1] else 1)
            else:
                alone.append(k)
        parts: list[list[int]] = [[]] * len(texts)
        groups = [plain[a : a + GROUP] for a in range(0, len(plain), GROUP)]
        joined = self.tokenizer.encode_batch_fast([" ".join(texts[k] for k in g) for g in groups], add_special_tokens=False)
        for at, (g, e) in enumerate(zip(groups, joined)):
            ids = e.ids
            last = np.cumsum(pieces_of[at * GROUP : at * GROUP + len(g)]) - 1
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != last[-1] + 1 or cuts[-1] != len(ids):  # another kind of vocabulary
                alone.extend(g)
                continue
            a = 0
            for k, b in zip(g, cuts[last].tolist()):
                parts[k] = ids[a:b]
                a = b
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False)):
            parts[k] = e.ids
        count = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        return np.fromiter(itertools.chain.from_iterable(parts), dtype=np.uint32, count=int(count.sum())), count

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents in order, and n+1 positions of each document's first id."""
        starts, ends, first = K.word_spans(raw, offsets)
        h = K.span_hashes(raw, starts, ends, lower=False)
        keys, seen, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.ids) > CACHE_IDS:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            texts = [data[a:b].decode("utf-8") for a, b in zip(starts[seen[new]].tolist(), ends[seen[new]].tolist())]
            ids, count = self.encode_words(texts)
            start = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]])
            self.ids = np.concatenate([self.ids, ids])
            at = place[new]
            self.keys, self.start, self.count = np.insert(self.keys, at, keys[new]), np.insert(self.start, at, start), np.insert(self.count, at, count)
            place = np.searchsorted(self.keys, keys)
        start, count = self.start[place][inverse], self.count[place][inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(start - total[:-1], count) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
        return flat, total[first]


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, text: str = "text", doc_id: str = "doc_id", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): each document's ids, then ``end_id``, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = word_tokens(tokenizer_path)
        tokens.clear()  # an idle worker keeps the tokenizer, not the words of its last task
        for batch in batches:
            for i, j, raw, offsets in K.chunks(batch.column(1)):
                ids, first = tokens.encode(raw, offsets)
                rows: list[tuple] = []
                parts: list[np.ndarray] = []
                for d in range(j - i):
                    own = np.append(ids[first[d] : first[d + 1]], np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        rows.append((i + d, p, s, len(part), zlib.crc32(part.tobytes())))
                        if with_ids:
                            parts.append(part)
                r = np.array(rows, dtype=np.int64).reshape(-1, 5)
                out = [batch.column(0).take(pa.array(r[:, 0])), pa.array(r[:, 1].astype(np.int32)), *(pa.array(r[:, c]) for c in (2, 3, 4))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([x.astype(np.int64) for x in parts], type=pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
        tokens.clear()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(K.tidy(run), schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments ``(length, rank_from, rank_to, first_bin, per_bin, offset)`` and the number of bins.

    Rank r of a length goes to bin ``first_bin + (r - rank_from) // per_bin`` at
    ``offset + (r - rank_from) % per_bin * length``.  Lengths above a third of the capacity are
    matched greedily, the largest with the largest that fits beside it, at most two to a bin;
    smaller ones go, longest first, to the bins with the smallest gap that holds them.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    bins = 0
    by_gap: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, number of bins)
    gaps: list[int] = []  # gaps that have bins, ascending

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            if not by_gap[gap]:
                bisect.insort(gaps, gap)
            by_gap[gap].append((first, number))

    def place(length: int, number: int, first: int, per: int, offset: int) -> None:
        out.append((length, used[length], used[length] + number, first, per, offset))
        used[length] += number

    left = {s: n for s, n in counts.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            m, b = left[a], 0
        elif large[at] == a:
            m, b = (left[a] // 2, a) if left[a] > 1 else (1, large[at - 1] if at else 0)
        else:
            b = large[at]
            m = min(left[a], left[b])
        place(a, m, bins, 1, 0)
        left[a] -= m
        if b:
            place(b, m, bins, 1, a)
            left[b] -= m
        put(capacity - a - b, bins, m)
        bins += m
        for s in {a, b} - {0}:
            if not left[s]:
                large.pop(bisect.bisect_left(large, s))
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):  # new bins
                put(capacity, bins, m := -(-n // (capacity // s)))
                bins += m
                continue
            gap = gaps[at]
            first, m = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(at)
            per = gap // s
            full = min(m, n // per)
            if full:
                place(s, full * per, first, per, capacity - gap)
                put(gap - per * s, first, full)
                n -= full * per
            rest = m - full
            if rest and n:  # the last n < per of them
                place(s, n, first + full, n, capacity - gap)
                put(gap - n * s, first + full, 1)
                put(gap, first + full + 1, rest - 1)
                n = 0
            elif rest:
                put(gap, first + full, rest)
    return out, bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, text: str = "text", doc_id: str = "doc_id", end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of ``docs``.

    A null text counts as empty and is one piece that holds ``end_id`` only.  Repeated rows are
    packed once for each row; rows with a null doc_id are packed too.  Pieces of one length are
    ranked by doc_id and piece, so equal input gives the same sequences.  An empty table gives no
    rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    cut = C.stage(pieces(docs, tokenizer_path, capacity, text, doc_id, end_id), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    segments, _ = plan(counts, capacity)
    ranked = C.number_in_group(cut, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], F.xxhash64("doc_id", "piece", "ids_crc32"), C.shuffle_width(spark), "rank")
    places = spark.createDataFrame(segments or [(-1, 0, 0, 0, 1, 0)], "s_length long, r0 long, r1 long, b0 long, per long, at long")
    # the plan has a few segments for each length, so its size is bounded by the capacity alone
    joined = ranked.join(F.broadcast(places), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    nth = F.col("rank") - F.col("r0")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("b0") + F.expr("(rank - r0) div per")).alias("sequence_id"),
        (F.col("at") + nth % F.col("per") * F.col("length")).alias("offset"),
    )

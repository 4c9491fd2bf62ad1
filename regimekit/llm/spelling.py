"""Spelling variants by a frequency-vector trie.

A word is its numbers of letters of each group, one trie level a group.  Inserting, deleting or
replacing one letter changes these by a surplus of at most one and a deficit of at most one, so all
words near a word lie at leaves that a search from the root reaches with that budget; the words at
these leaves are verified letter by letter.

Spark holds the top of the trie: a node of more than ``cell`` words is split by the next group, level
by level, and the searches go down with their budgets by joins with the nodes.  Nodes of at most ``cell`` words are
cells: a task builds the rest of the trie of one cell and lets all its searches descend depth first.
A leaf that holds more words (same letters in another order) is dealt over several cells, each of which sees all searches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import kernels as K

#: Letters of the trie's levels; all others are the last level.
GROUPS = ("e", "n", "i", "r", "t", "a", "s", "odl", "uchm")
LEVELS = len(GROUPS) + 1
CELL = 10_000
TEXT = 1 << 20  # characters of a long text handled at once
FLUSH = 1 << 20  # distinct words a task holds
PAIR_BYTES = 16 << 20  # of the letters of pairs verified at once
MOD = 97

# one byte a letter: a-z, A-Z lowered, U+00C0 to U+00FF; all else separates
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_LEVEL = np.full(256, LEVELS - 1, dtype=np.int64)
for _i, _g in enumerate(GROUPS):
    _LEVEL[[ord(c) for c in _g]] = _i


def _runs(text: str) -> Iterator[bytes]:
    """Parts of the text's letters (Latin-1, a space for all else) that cut no run."""
    held = b""
    for a in range(0, len(text), TEXT):
        raw = held + text[a : a + TEXT].encode("latin-1", "replace").translate(_LETTERS)
        cut = raw.rfind(b" ") + 1 if a + TEXT < len(text) else len(raw)
        held = raw[cut:]
        yield raw[:cut]


def _words_of(doc_id: str, text: str, shortest: int) -> Counter:
    """Words of a text and how often: its runs, of which the hash with the doc_id takes a letter off some."""
    head = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    found: Counter = Counter()
    for raw in _runs(text):
        found.update(raw.split())
    for run, n in found.items():
        if len(run) < shortest:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
        if h % MOD == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _count(shortest: int):
    def batch_of(total: dict) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in total if len(w) >= shortest]
        return pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array([n for w, n in total.items() if len(w) >= shortest], type=pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for w, n in _words_of(doc_id, text.as_py() or "", shortest).items():
                    total[w] = total.get(w, 0) + n
                if len(total) >= FLUSH:
                    yield batch_of(total)
                    total = {}
        yield batch_of(total)

    return K.tidy(run)


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 5, least: int = 3) -> DataFrame:
    """``word, n``: the words of at least ``shortest`` letters that occur ``least`` times or more."""
    C.prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(_count(shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- the trie


def _letters(word: Column | str, level: int) -> Column:
    """How many letters of a level a word has."""
    w = F.col(word) if isinstance(word, str) else word
    if level < LEVELS - 1:
        return F.length(w) - F.length(F.translate(w, GROUPS[level], ""))
    return F.length(F.translate(w, "".join(GROUPS), ""))


def _path(word: str, depth: int) -> Column:
    return F.concat(*[x for k in range(depth) for x in (_letters(word, k).cast("string"), F.lit(","))])


def top_of_trie(words: DataFrame, cell: int) -> tuple[DataFrame, int]:
    """``path, inner, parts`` of the inner nodes and the cells below them, and the number of levels that Spark splits."""
    vectors = words.groupBy(*[_letters("word", k).alias(f"c{k}") for k in range(LEVELS)]).agg(F.count("*").alias("n"))
    paths = [F.concat(*[x for k in range(d) for x in (F.col(f"c{k}").cast("string"), F.lit(","))]) for d in range(1, LEVELS + 1)]
    flat = vectors.select("n", F.explode(F.array(*[F.struct(F.lit(d + 1).alias("depth"), p.alias("path")) for d, p in enumerate(paths)])).alias("x"))
    nodes = flat.groupBy("x.depth", "x.path").agg(F.sum("n").alias("n"))
    nodes = nodes.withColumn("inner", (F.col("n") > cell) & (F.col("depth") < LEVELS))
    nodes = C.stage(nodes.where((F.col("n") > cell) | (F.col("depth") == 1)).unionByName(_below(nodes)).distinct(), "sv-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 1
    parts = F.when(F.col("inner"), 1).otherwise(F.ceil(F.col("n") / cell)).cast("int")
    return nodes.select("path", "inner", parts.alias("parts")), deepest


def _below(nodes: DataFrame) -> DataFrame:
    """The children of inner nodes."""
    parent = F.regexp_replace("path", "[0-9]+,$", "")
    inner = nodes.where("inner").select(F.col("path").alias("up"))
    return nodes.withColumn("parent", parent).join(inner, F.col("parent") == F.col("up"), "left_semi").drop("parent")


def _searches(words: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """``word, n, path, parts, own``: every cell that a word's search reaches; ``own`` is the cell the word lies in."""
    at = words.select("word", "n", F.lit("").alias("path"), F.lit(True).alias("inner"), F.lit(1).alias("parts"), F.lit(0).alias("up"), F.lit(0).alias("down"))
    for level in range(deepest):
        has = _letters("word", level)

        def step(more: int, up: int, down: int) -> Column:
            return F.struct(F.concat("path", (has + more).cast("string"), F.lit(",")).alias("path"), (F.col("up") + up).alias("up"), (F.col("down") + down).alias("down"))

        nothing = F.lit(None)
        steps = F.array_compact(F.array(step(0, 0, 0), F.when(F.col("up") == 0, step(1, 1, 0)).otherwise(nothing), F.when((F.col("down") == 0) & (has > 0), step(-1, 0, 1)).otherwise(nothing)))
        stay = F.array(F.struct("path", "up", "down"))
        at = at.select("word", "n", F.explode(F.when(F.col("inner"), steps).otherwise(stay)).alias("x")).select("word", "n", "x.*")
        at = at.join(nodes, "path").select("word", "n", "path", "inner", "parts", "up", "down")
    return at.select("word", "n", "path", "parts", ((F.col("up") == 0) & (F.col("down") == 0)).alias("own"))


# ---------------------------------------------------------------- one cell


def _vectors(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters of each level: words x LEVELS."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.bincount(row * LEVELS + _LEVEL[raw], minlength=(len(at) - 1) * LEVELS).reshape(-1, LEVELS)


def _latin(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [w.encode("latin-1") for w in words]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


class Cell:
    """The trie of some words below a node, and the searches in it."""

    def __init__(self, words: list[str], n: np.ndarray):
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))  # the best form first
        self.words, self.n = [words[i] for i in order], n[order]
        self.raw, self.at = _latin(self.words)
        counts = _vectors(self.raw, self.at)
        self.width = int(counts.max()) + 2 if len(counts) else 2
        node, self.levels = np.zeros(len(counts), np.int64), []
        for k in range(LEVELS):
            keys, node = np.unique(node * self.width + counts[:, k], return_inverse=True)
            self.levels.append(keys)
        self.members = np.argsort(node, kind="stable")
        self.first = np.searchsorted(node[self.members], np.arange(len(self.levels[-1]) + 1))

    def leaves(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Depth-first search for all vectors at once: ``(vector, leaf)`` pairs within the budget."""
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def descend(level: int, who: np.ndarray, node: np.ndarray, up: int, down: int) -> None:
            if not len(who):
                return
            if level == LEVELS:
                found.append((who, node))
                return
            keys = self.levels[level]
            for more in (0, 1, -1):
                if (more > 0 and not up) or (more < 0 and not down):
                    continue
                want = counts[who, level] + more
                key = node * self.width + want
                child = np.searchsorted(keys, key)
                child[child == len(keys)] = 0
                ok = (want >= 0) & (want < self.width) & (keys[child] == key)
                descend(level + 1, who[ok], child[ok], up - (more > 0), down - (more < 0))

        descend(0, np.arange(len(counts)), np.zeros(len(counts), np.int64), 1, 1)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many of the cell's words are near each word, and the number of the best of them (or the cell's size)."""
        raw, at = _latin(words)
        counts = _vectors(raw, at)
        vector, of = np.unique(counts, axis=0, return_inverse=True)
        of = of.reshape(-1)
        who, leaf = self.leaves(vector)
        order = np.argsort(who, kind="stable")
        who, leaf = who[order], leaf[order]
        a, z = np.searchsorted(who, of), np.searchsorted(who, of, side="right")
        word = np.repeat(np.arange(len(words)), z - a)  # word x leaf
        leaf = leaf[np.arange(len(word)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + np.repeat(a, z - a)]
        size = (self.first[leaf + 1] - self.first[leaf]).astype(np.int64)
        near, best = np.zeros(len(words), np.int64), np.full(len(words), len(self.words))
        longest = int(max(np.diff(at).max(initial=0), np.diff(self.at).max(initial=0))) + 1
        step = max(1, PAIR_BYTES // longest)
        upto = np.cumsum(size)
        i = 0
        while i < len(word):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + step, side="right")))
            s = size[i:j]
            q = np.repeat(word[i:j], s)
            m = self.members[np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) + np.repeat(self.first[leaf[i:j]], s)]
            for b in range(0, len(q), step):
                ok = near_pairs(raw, at, q[b : b + step], self.raw, self.at, m[b : b + step])
                x, y = q[b : b + step][ok], m[b : b + step][ok]
                near += np.bincount(x, minlength=len(near))
                np.minimum.at(best, x, y)
            i = j
        return near, best


def near_pairs(raw_a: np.ndarray, at_a: np.ndarray, a: np.ndarray, raw_b: np.ndarray, at_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words ``a`` and ``b`` differ by exactly one inserted, deleted or replaced letter."""
    la, lb = at_a[a + 1] - at_a[a], at_b[b + 1] - at_b[b]
    out = np.zeros(len(a), dtype=bool)
    # words of four letters or more keep their first two or their last two
    fa, fb, za, zb = at_a[a], at_b[b], at_a[a + 1], at_b[b + 1]
    likely = (np.minimum(la, lb) < 4) | (raw_a[fa] == raw_b[fb]) | (raw_a[za - 1] == raw_b[zb - 1])
    todo = np.flatnonzero(likely & (np.abs(la - lb) <= 1))
    fa, fb, za, zb = (x[todo] for x in (fa, fb, za, zb))
    long = np.minimum(la, lb)[todo] >= 4
    todo = todo[~long | ((raw_a[fa] == raw_b[fb]) & (raw_a[fa + long] == raw_b[fb + long])) | ((raw_a[za - 1] == raw_b[zb - 1]) & (raw_a[za - 1 - long] == raw_b[zb - 1 - long]))]
    if not len(todo):
        return out
    la, lb, pa_, pb = la[todo], lb[todo], at_a[a[todo]], at_b[b[todo]]
    short, long = np.minimum(la, lb), np.maximum(la, lb)
    # common letters from the front and from the back
    front, back = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
    for count, forward in ((front, True), (back, False)):
        live, k = np.arange(len(todo)), 0
        while len(live):
            live = live[k < short[live]]
            x, y = (pa_[live] + k, pb[live] + k) if forward else (pa_[live] + la[live] - 1 - k, pb[live] + lb[live] - 1 - k)
            live = live[raw_a[x] == raw_b[y]]
            count[live] += 1
            k += 1
    replaced = (la == lb) & (front < la) & (front + back == la - 1)
    out[todo] = replaced | ((la != lb) & (front + back >= long - 1))
    return out


NEAR = "word string, n_near long, form_n long, form string"
SEARCHES = 1 << 14  # words that search a cell at once


def _search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, the cell's own words first: only those are held."""
    key, own, words, cell = None, [], [], None
    wait: list[str] = []

    def answer() -> pa.RecordBatch | None:
        if not wait or cell is None:
            return None
        near, best = cell.search(wait)
        hit = np.flatnonzero(near)
        return pa.RecordBatch.from_arrays(
            [pa.array([wait[i] for i in hit], type=pa.string()), pa.array(near[hit]), pa.array(cell.n[best[hit]]), pa.array([cell.words[i] for i in best[hit]], type=pa.string())],
            names=["word", "n_near", "form_n", "form"],
        )

    for batch in batches:
        for k, search, w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if k != key:
                if (out := answer()) is not None:
                    yield out
                key, own, words, cell, wait = k, [], [], None, []
            if not search:
                words.append(w)
                own.append(n)
                continue
            if not words:  # a part of a leaf that no word fell in
                continue
            if cell is None:
                cell = Cell(words, np.array(own, dtype=np.int64))
            wait.append(w)
            if len(wait) >= SEARCHES:
                if (out := answer()) is not None:
                    yield out
                wait = []
    if (out := answer()) is not None:
        yield out


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """``word, n_near, form_n, form`` of the words (``word, n``) that have a near word: how many, and the most frequent."""
    C.prepare(words.sparkSession)
    nodes, deepest = top_of_trie(words, cell)
    reached = _searches(words, nodes, deepest)
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    lies = F.when(F.col("own"), F.array(F.struct(part.alias("part"), F.lit(0).alias("search")))).otherwise(F.array().cast("array<struct<part:int,search:int>>"))
    asks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(1).alias("search")))
    rows = reached.select("word", "n", "path", F.explode(F.concat(lies, asks)).alias("x")).select(F.xxhash64("path", "x.part").alias("cell"), "x.search", "word", "n")
    rows = rows.repartition(C.shuffle_width(words.sparkSession), "cell").sortWithinPartitions("cell", "search")
    found = rows.mapInArrow(K.tidy(_search_cells), NEAR)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.form").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` links without circles: every round doubles the steps that a word looks ahead."""
    now = C.stage(links.select("word", F.col("form").alias("root")), "sv-roots")
    while True:
        ahead = now.select(F.col("word").alias("w2"), F.col("root").alias("r2"))
        step = C.stage(now.join(ahead, F.col("root") == F.col("w2"), "left").select("word", F.coalesce("r2", "root").alias("root"), F.col("r2").isNotNull().alias("moved")), "sv-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 5, least: int = 3, factor: int = 2, cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the words of all texts and the frequent words they are variants of.

    Runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lowered; where 97 divides the crc32 of ``<doc_id>:<run>`` the run loses
    the letter at that hash modulo its length.  Words have ``shortest`` letters and ``least`` occurrences at least.
    ``form`` is the near word with the largest ``n`` (ties: the least word) where that is ``factor`` times the word's at
    least.  Null texts have no words; a null doc_id counts as the empty string; repeated rows count each; other columns are not read.
    """
    words = C.stage(vocabulary(docs, text, doc_id, shortest, least), "sv-words")
    near = near_words(words, cell).select(F.col("word").alias("w2"), "n_near", "form_n", "form")
    joined = words.join(near, F.col("word") == F.col("w2"), "left").drop("w2")
    frequent = F.col("form_n") >= factor * F.col("n")
    joined = joined.select("word", F.when(frequent, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("form_n")).alias("form_n"))
    joined = C.stage(joined, "sv-forms")
    ends = roots(joined.where("form is not null")).select(F.col("word").alias("w2"), "root")
    out = joined.join(ends, F.col("word") == F.col("w2"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

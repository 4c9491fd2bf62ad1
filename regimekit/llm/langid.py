"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text accepts all substrings of the
sample.  A text is cut greedily into the longest phrases an automaton accepts.  As samples differ in size and a
longer one offers more phrases, phrases are normalised to what it costs to name them: the log of the sample's length
each, and the log of the alphabet for each letter the sample never had, which is a phrase of its own.  The
language with the least cost wins.  Letters are lower-cased and each run of other characters is one separator.

Every letter of the samples counts: the commonest are one symbol each, the others a lead digit and further digits in
base 16, so the tables stay narrow with any number of scripts.

Texts are parsed in blocks of ``BLOCK`` characters, a phrase ending with its block, so that many
blocks and all languages advance together, one character a step.  The whole text counts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import kernels as K

BLOCK = 1024
PARSE_BYTES = 2 << 20  # text parsed together: many blocks keep a step of all of them cheap
MAX_LANGUAGES = 256  # labels learned; with the sample's total length a bound on the automata, which every worker holds
MAX_SAMPLE = 640_000  # characters of all samples together
UNKNOWN = "und"
_LETTERS, _DIRECT, _BASE = 2, 62, 16  # first symbol of a letter, letters of one symbol, base of the others


def suffix_automaton(classes: list[int], width: int) -> np.ndarray:
    """Transitions (states x width, -1: none) of the automaton of all substrings; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in classes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), width), -1, dtype=np.int32)
    for s, row in enumerate(nxt):
        for c, t in row.items():
            out[s, c] = t
    return out


class Parser:
    """Automata of all languages in one table; made from the sample texts alone, in any worker."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        letters: dict[str, int] = {}
        for _, text in samples:
            for ch in text.lower():
                if ch.isalpha():
                    letters[ch] = letters.get(ch, 0) + 1
        known = sorted(letters, key=lambda ch: (-letters[ch], ch))
        direct, others = known[:_DIRECT], known[_DIRECT:]
        self.lut = np.zeros(0x110000, dtype=np.uint8)
        self.lut[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
        self.digits = 1
        while _BASE**self.digits < len(others):
            self.digits += 1
        self.lead = _LETTERS + len(direct)  # the lead digit is told from the further ones
        width = self.lead + (2 * _BASE if others else 0)
        self.nth = np.full(0x110000 if others else 0, -1, dtype=np.int32)  # numbers of letters of several symbols
        for k, ch in enumerate(known):
            for x in (ch, ch.upper()):
                if len(x) == 1 and k < _DIRECT:
                    self.lut[ord(x)] = _LETTERS + k
                elif len(x) == 1:
                    self.lut[ord(x)], self.nth[ord(x)] = self.lead, k - _DIRECT
        tables, roots, dead, price, at = [], [], [], [], 0
        for _, text in samples:
            flat, _ = self.classes(*K.buffers(pa.array([text])))
            t = suffix_automaton(flat.tolist(), width)
            t = np.vstack([t, np.full((1, width), -1, np.int32)])  # the last state has no way on
            t[:, 1] = -1
            t = np.where(t >= 0, (t + at) * width, -1).astype(np.int32)
            end = (at + len(t) - 1) * width
            roots.append(np.where(t[0] >= 0, t[0], end))
            dead.append(end)
            price.append(np.log(len(flat) + 1.0))
            tables.append(t)
            at += len(t)
        self.table = np.concatenate(tables).reshape(-1)
        self.roots, self.dead = np.array(roots, dtype=np.int32), np.array(dead, dtype=np.int32)
        self.missing = self.roots == self.dead[:, None]  # languages x symbols their samples never had
        self.price, self.letter = np.array(price), np.log(len(known) + 1.0)

    def classes(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all documents (0: separator, 1: unknown letter), and n+1 positions."""
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        cls = self.lut[points]
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
        before = np.zeros_like(cls)
        before[1:] = cls[:-1]
        before[chars[:-1][chars[:-1] < len(cls)]] = 0
        keep = (cls != 0) | (before != 0)
        cls, points, first = cls[keep], points[keep], np.concatenate([[0], np.cumsum(keep)])[chars]
        several = np.flatnonzero(self.nth[points] >= 0) if len(self.nth) else points[:0]
        if not len(several):
            return cls, first
        size = np.ones(len(cls), dtype=np.int64)
        size[several] = self.digits
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(cls, size)
        rest, at = self.nth[points[several]], ends[several]
        for k in reversed(range(self.digits)):
            out[at + k] = self.lead + (_BASE if k else 0) + rest % _BASE
            rest = rest // _BASE
        return out, ends[first]

    def phrases(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """languages x documents: how many phrases each document needs."""
        n = len(first) - 1
        blocks = -(-np.diff(first) // BLOCK)
        doc = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[doc] + nth * BLOCK
        size = np.minimum(first[doc + 1] - start, BLOCK)
        order = np.argsort(-size, kind="stable")
        doc, start, size = doc[order], start[order], size[order]
        state = np.repeat(self.dead[:, None], len(doc), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for t, a in enumerate(active.tolist()):
            c = flat[start[:a] + t]
            to = self.table[state[:, :a] + c]
            end = to < 0
            count[:, :a] += end
            state[:, :a] = np.where(end, self.roots[:, c], to)
        return np.stack([np.bincount(doc, weights=row, minlength=n) for row in count]) if len(doc) else np.zeros((len(self.dead), n))

    def costs(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """languages x documents: the normalised phrases, as the cost of naming them."""
        cost = self.phrases(flat, first) * self.price[:, None]
        gaps = np.flatnonzero(self.missing.any(axis=0)[flat])  # few: most symbols are in every sample
        doc = np.searchsorted(first, gaps, side="right") - 1
        for row, missing in zip(cost, self.missing):
            row += self.letter * np.bincount(doc, weights=missing[flat[gaps]], minlength=len(row))
        return cost


@functools.lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_language: int = 64, chars_per_doc: int = 500, seed: int = 9, max_languages: int = MAX_LANGUAGES, max_sample: int = MAX_SAMPLE) -> tuple[tuple[str, str], ...]:
    """(language, sample text) of each label: the first ``chars_per_doc`` characters of ``docs_per_language`` rows.

    The rows are those with the least hash of doc_id, so reruns agree.  The sample is bounded by the parameters: with many
    labels each has fewer rows, so that all have ``max_sample`` characters (but one row each at least), and only
    the ``max_languages`` labels with the most rows (ties: by code point) are learned; no text is
    given a label beyond them.  Rows without label, text or doc_id are not used.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text")).where("_id is not null and _lang is not null and _text is not null")
    ids = rows.select("_id", "_lang", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 40)).alias("h"))
    counts = ids.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "_lang").limit(max_languages).collect()
    if not counts:
        return ()
    docs_per_language = max(1, min(docs_per_language, max_sample // (chars_per_doc * len(counts))))
    # about four times the rows wanted of each label pass, so the window below sees a bounded number
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["_lang"], min(1.0, 4.0 * docs_per_language / r["n"]))])
    near = ids.where(F.col("h") < rates[F.col("_lang")] * float(1 << 40))
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("h", "_id"))
    chosen = near.withColumn("r", nth).where(F.col("r") <= docs_per_language).select("_id", "_lang", "r")
    # docs_per_language rows a label, max_languages labels: bounded
    found = rows.join(F.broadcast(chosen), ["_id", "_lang"]).select("_lang", "r", F.substring("_text", 1, chars_per_doc).alias("t")).collect()
    by: dict[str, list[tuple[int, str]]] = {}
    for r in found:
        by.setdefault(r["_lang"], []).append((r["r"], r["t"]))
    return tuple((k, "\n".join(t for _, t in sorted(by[k]))) for k in sorted(by))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    ``lang_pred`` is the language of least cost (ties: the first in order), ``und`` for a null text or one without a
    letter, or if no language was learned.  ``score`` is 1 / sum over languages of exp(least cost - cost), so other languages
    that cost little more lower it; 0 for ``und``.
    Only the text decides.  Repeated rows get equal answers; an empty table gives no rows; other columns are not read.
    """
    C.prepare(docs.sparkSession)
    names = [k for k, _ in samples]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(samples) if samples else None
        for batch in batches:
            for i, j, raw, offsets in K.chunks(batch.column(1), PARSE_BYTES):
                pred, score = [UNKNOWN] * (j - i), np.zeros(j - i)
                if p:
                    flat, first = p.classes(raw, offsets)
                    n = p.costs(flat, first)
                    best = n.argmin(axis=0)
                    known = np.diff(first) > 0
                    score = np.where(known, 1.0 / np.exp(n.min(axis=0) - n).sum(axis=0), 0.0)
                    pred = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(pred, type=pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(K.tidy(run), "doc_id long, lang_pred string, score double")

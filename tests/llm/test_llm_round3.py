"""Operators 11 to 13 against brute force on small tables, and the cases that their docstrings define."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import queries, spelling, suffixdedup, trie
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id LONG, text STRING"
CONV = "conv_id LONG, turn LONG, role STRING, text STRING"


# ---------------------------------------------------------------- 12: suffix dedup


def plain_repeats(docs, length=50):
    """Every window of every text in a dictionary."""
    least = {}
    rows = [(d, (t or "").encode()) for d, t in docs]
    for d, x in rows:
        if d is not None:
            for i in range(len(x) - length + 1):
                least[x[i : i + length]] = min(d, least.get(x[i : i + length], d))
    out = []
    for d, x in rows:
        gone = bytearray(len(x))
        if d is not None:
            for i in range(len(x) - length + 1):
                if least[x[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeats(spark, docs, **kw):
    df = docs if not isinstance(docs, list) else spark.createDataFrame(docs, DOCS)
    got = suffixdedup.remove_repeats(df, **kw).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_repeats_of_the_given_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    assert repeats(spark, df) == plain_repeats([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("cell", [3, 4096])  # with and without cells that are too large for one task
def test_repeats_in_every_position(spark, cell):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abc dé😀\n") for _ in range(n))
    passage, other = text(80), text(60)
    docs = [(i, text(rnd.randrange(0, 150)) + (passage if i % 2 else other[: 40 + i % 20]) + text(rnd.randrange(0, 90))) for i in range(60)]
    docs += [(70, passage), (71, passage), (72, None), (73, ""), (74, "x" * 49), (75, "x" * 50), (76, "x" * 49), (77, "y" + "x" * 51), (78, "x" * 3000)]
    docs += [(80, text(200) + passage * 3), (81, passage * 2), (81, passage * 2), (81, other + passage), (None, passage), (None, None), (-5, passage[5:70]), (90, passage + passage[10:30])]
    rnd.shuffle(docs)
    assert repeats(spark, docs, cell=cell) == plain_repeats(docs)


def test_long_texts_come_in_segments(spark, monkeypatch):
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(700_000))
    docs = [(3, long), (1, long[300_000:400_010]), (7, "z" + long[250_000:262_300] + "z"), (9, "ab" * 300_000), (8, "ab" * 30)]
    assert repeats(spark, docs) == plain_repeats(docs)


def test_repeats_of_nothing_and_clashing_columns(spark):
    assert repeats(spark, spark.createDataFrame([], DOCS)) == []
    odd = spark.createDataFrame([(1, "a" * 60, 1, 2), (2, "b" + "a" * 60, 3, 4)], DOCS + ", hash LONG, th LONG")
    assert [r[:4] for r in repeats(spark, odd)] == [(1, 60, 0, 0), (2, 61, 60, 1)]


def test_pieces_spread_evenly_over_the_buckets():
    rnd = random.Random(8)
    texts = pa.array(["".join(rnd.choice("abcdefgh ") for _ in range(20_000)) for _ in range(20)])
    h = np.concatenate([p[0] for _, _, _, _, p in suffixdedup.pieces(texts)])
    dealt = suffixdedup._chunk_rows(0, 64, h, np.zeros((3, 1), "<i8")).to_pylist()
    sizes = [len(r["nos"]) // 4 for r in dealt if r["bucket"] is not None]
    assert sum(sizes) == len(np.unique(h)) and sorted({r["bucket"] for r in dealt[:-1]}) == list(range(64))
    assert max(sizes) < 1.5 * sum(sizes) / 64  # the least of 35 hashes is a small number


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.lists(st.sampled_from(["ab" * 13, "ba" * 12, "abc" * 9, "x", "yz" * 14]), max_size=6).map("".join)), min_size=1, max_size=8))
def test_the_sort_of_a_cell(docs):
    raw = np.frombuffer("".join(t for _, t in docs).encode(), np.uint8)
    at, doc, pos = [], [], 0
    for d, t in docs:
        at += list(range(pos, pos + len(t) - 32 + 1))
        doc += [d] * max(0, len(t) - 31)
        pos += len(t)
    x = raw.tobytes()
    want = [any(x[a : a + 32] == x[b : b + 32] and e < d for b, e in zip(at, doc)) for a, d in zip(at, doc)]
    got = suffixdedup.repeated_suffixes(raw, np.array(at, np.int64), np.zeros(len(at), np.int64), np.array(doc, np.int64), 32)
    assert got.tolist() == want


# ---------------------------------------------------------------- 13: spelling variants


def plain_words(docs):
    total = collections.Counter()
    for d, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def plain_variants(docs):
    n = plain_words(docs)
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        if xs and n[best := min(xs, key=lambda x: (-n[x], x))] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def variants(spark, docs, **kw):
    df = docs if not isinstance(docs, list) else spark.createDataFrame(docs, DOCS)
    rows = [tuple(r) for r in spelling.spelling_variants(df, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_of_the_given_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    assert variants(spark, df, cell=300) == plain_variants([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("cell", [2, 10_000])
def test_variants_of_words_of_few_letters(spark, cell):
    """Many words at one leaf: the same letters in another order."""
    rnd = random.Random(7)
    some = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(5, 8))) for _ in range(80)]
    docs = [(i, " ".join(rnd.choices(some, k=40)).upper() if i % 3 else "-".join(rnd.choices(some, k=30))) for i in range(20)]
    docs += [(None, "abaabé " * 4), (None, None), (50, ""), (51, "  "), (52, "straße straße straßen straßen straßen 東京 ﬁnale")]
    assert variants(spark, docs, cell=cell) == plain_variants(docs)


def test_chains_of_forms_and_ties(spark):
    text = "aaaaaa " * 3 + "aaaaab " * 6 + "aaaabb " * 12 + "aaabbb " * 24 + "ccccce " * 3 + "cccccf " * 6 + "cccccd " * 6
    docs = [(i, text) for i in range(1)]
    got = variants(spark, docs)
    assert got == plain_variants(docs)
    assert {r[2] for r in got if r[0].startswith("aa")} == {"aaabbb"}


def test_a_run_is_cut_nowhere(monkeypatch):
    text = "abcdefghijklmnopqrstuvwxyz abcde fghijkl ab cd abcde! abcde? abcdefgh,abcdefgh;Abcdefgh"
    whole = spelling._words_of("4", text, 5)
    monkeypatch.setattr(spelling, "TEXT", 7)
    assert spelling._words_of("4", text, 5) == whole and sum(whole.values()) == 8


def test_variants_of_nothing_and_clashing_columns(spark):
    assert variants(spark, spark.createDataFrame([], DOCS)) == set()
    odd = spark.createDataFrame([(1, "hello hello hello", "x", 1)], DOCS + ", word STRING, n LONG")
    assert variants(spark, odd) == plain_variants([(1, "hello hello hello")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=7), min_size=1, max_size=12))
def test_words_one_letter_apart(words):
    raw, at = spelling._latin(words)
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    assert spelling.near_pairs(raw, at, a, raw, at, b).tolist() == [one_apart(words[i], words[j]) for i, j in zip(a, b)]


# ---------------------------------------------------------------- 11: prefix trie


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c >= 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    saved = {k: (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0 for k, m in members.items()}
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        kids = {x for x in below if len(x) == len(k) + 1}
        leaves = sum(1 for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below))
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids), leaves, sum(saved[x] for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, CONV)
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=repr)


def test_trie_of_the_given_conversations(spark):
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert trie_of(spark, df) == plain_trie([tuple(r) for r in df.collect()])


def test_trie_of_nulls_ties_and_lengths(spark):
    rnd = random.Random(8)
    rows = []
    for c in [*range(-25, 65, 3), 1000, 100_020, 100_021]:
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, rnd.choice([t, t, t, None, 0]), rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "a  b c", "", None, "x\ty"])))
    rows += [rows[0], rows[0], (None, 1, "user", "lost")]
    rows += [(c, t, "user", "same words") for c in (40, 60, 61, 62) for t in range(37 + c % 5)]  # deeper than 32, across blocks of 64 turns
    rows += [(41, 1000 - 10 * t, "user", f"turn {t}") for t in range(90)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_nothing_and_clashing_columns(spark):
    assert trie_of(spark, spark.createDataFrame([], CONV)) == []
    odd = spark.createDataFrame([(20, 1, "user", "a b", 5, "z"), (21, 1, "user", "a b", 6, "y")], CONV + ", p LONG, node STRING")
    assert trie_of(spark, odd) == plain_trie([(20, 1, "user", "a b"), (21, 1, "user", "a b")])


def test_a_conversation_with_all_turns_and_all_ends_at_one_node(spark):
    """600 turns of one conversation, and 20,000 conversations of one text."""
    deep = spark.range(600).select(F.lit(10_000_007).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id") % 3).alias("text"))
    wide = spark.range(20_000).select((F.col("id") * 20).alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("one two").alias("text"))
    rows = trie.prefix_trie(deep.unionByName(wide)).collect()
    by_depth = {r["depth"]: r for r in rows if r["depth"] != 1 or r["conv_id"] == 0}
    assert by_depth[1]["n_convs"] == 20_000 and by_depth[1]["saved_tokens"] == 2 * 19_999
    assert by_depth[1]["ends_sha256"] == hashlib.sha256(",".join(str(20 * i) for i in range(20_000)).encode()).hexdigest()
    assert by_depth[0]["n_leaves"] == 2 and max(by_depth) in (597, 598, 599, 600)  # less its first turns


# ---------------------------------------------------------------- general


def test_likely_in_keeps_all_and_little_else(spark):
    ids = spark.range(0, 3000, 7)
    likely = C.likely_in(ids, "id")
    got = {r[0] for r in spark.range(-50, 3000).where(likely(F.col("id"))).collect()}
    assert set(range(0, 3000, 7)) <= got and len(got) < 500
    assert spark.range(10).where(C.likely_in(spark.range(0), "id")(F.col("id"))).count() == 0


def test_new_queries_have_sql():
    assert {"op11_prefix_trie", "op12_suffix_dedup", "op13_spelling_variants"} <= set(queries.ORACLES) & set(queries.QUERIES)

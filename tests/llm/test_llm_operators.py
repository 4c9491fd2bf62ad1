"""The numbered operators against brute force, round trips and held-out accuracy on small tables."""

import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regimekit.llm import chat, htmltext, kernels, langid, linedup, minhash, mixing, packing, quality, queries, simhash, vecdedup
from regimekit.llm import common as C
from tests.conftest import SF_ORACLE, SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(name, sf=SF_SMALL):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet' ORDER BY 1").df()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def tokenizer():
    return queries._tokenizer("word_bpe_49k.json")


# ---------------------------------------------------------------- kernels


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\t\x0bé😀.", max_size=25)), max_size=12))
def test_words_shingles_and_lines_as_in_plain_python(texts):
    raw, offsets = kernels.buffers(pa.array(texts, type=pa.string()))
    h, first = kernels.words(raw, offsets)
    g, g_first = kernels.ngrams(h, first, 5, whole_if_short=True)
    lines, counts, l_first = kernels.lines(raw, offsets)
    seen = {}
    for d, t in enumerate(texts):
        own = words(t)
        assert first[d + 1] - first[d] == len(own)
        sets = [tuple(own[i : i + 5]) for i in range(len(own) - 4)] if len(own) >= 5 else [tuple(own)] if own else []
        by_line = [x for x in (tuple(words(x)) for x in (t or "").split("\n")) if x]
        assert g_first[d + 1] - g_first[d] == len(sets) and l_first[d + 1] - l_first[d] == len(by_line)
        assert list(counts[l_first[d] : l_first[d + 1]]) == [len(x) for x in by_line]
        for kind, items, values in (("w", own, h[first[d] :]), ("g", sets, g[g_first[d] :]), ("l", by_line, lines[l_first[d] :])):
            for x, y in zip(items, values):
                assert seen.setdefault((kind, x), y) == y
    assert len(set(seen.values())) == len(seen)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(300, 301)]
    df = spark.createDataFrame([(a, b) if a % 3 else (b, a) for a, b in edges], "u LONG, v LONG")
    got = {r["node"]: r["root"] for r in C.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}


@pytest.mark.parametrize("k", [1, 5, 600, 999, 1000, 1001])
def test_kth_largest(spark, k):
    x = np.random.default_rng(0).normal(size=1000).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "v DOUBLE")
    assert C.kth_largest(df, "v", k, bins=7, small=20) == sorted(x, reverse=True)[min(k, 1000) - 1]


def test_numbers_in_groups(spark):
    df = spark.createDataFrame([(i % 3 if i % 4 else None, i) for i in range(200)], "g INT, i INT")
    got = collections.defaultdict(list)
    for r in C.number_in_group(df, ["g"], [F.col("i")], F.xxhash64("i"), 5, "n").collect():
        got[r["g"]].append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 200


# ---------------------------------------------------------------- 1 packing


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once(capacity, counts):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    segments, bins = packing.plan(counts, capacity)
    ranks, content = collections.defaultdict(set), collections.defaultdict(list)
    for s, r0, r1, b0, per, at in segments:
        for r in range(r0, r1):
            assert r not in ranks[s]
            ranks[s].add(r)
            content[b0 + (r - r0) // per].append((at + (r - r0) % per * s, s))
    assert {s: len(r) for s, r in ranks.items()} == counts and sorted(content) == list(range(bins))
    for items in content.values():
        end = 0
        for at, s in sorted(items):
            assert at == end
            end += s
        assert end <= capacity and sum(3 * s > capacity for _, s in items) <= 2
    if counts:
        assert bins <= 11 / 9 * max(1, -(-sum(s * n for s, n in counts.items()) // capacity)) * 1.5 + 1


def test_packing_of_the_documents(spark):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(tokenizer())
    got = queries.op1_best_fit_packing(spark, SF_SMALL).toPandas()
    want = {}
    for r in table("documents").itertuples():
        ids = np.array([*tokens.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            want[(r.doc_id, p)] = (s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 2048 + 1


# ---------------------------------------------------------------- 2 fingerprints


def test_fingerprints_of_edits(spark):
    got = queries.op2_simhash(spark, SF_SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = [t or "" for t in table("documents").text]
    n = len(texts)
    assert len(got) == n and list(got.n_chars) == [len(t) for t in texts]
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % n][: len(t) // 2] for i, t in enumerate(texts)]
    assert list(got.edited_sha256) == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    same = {}
    for t, f in zip([*texts, *edited], [*got.fingerprint, *got.edited_fingerprint]):
        assert same.setdefault(t, f) == f
    bits = np.array([[int(c) for c in f"{int(f, 16):0128b}"] for f in got.fingerprint])
    far = (bits[:, None] != bits[None]).sum(2)
    assert np.allclose(got.near_next, [1 - far[i, (i + 1) % n] / 128 for i in range(n)])
    assert (got.near_edited > got.near_next).mean() > 0.95
    asked = got.doc_id % 20 == 0
    assert list(got.n_near[asked]) == list((far[asked] <= 6).sum(1) - 1) and got.n_near[~asked].isna().all()


@pytest.mark.parametrize("blocks", [7, 8])
def test_block_tables_miss_nothing_within_the_radius(blocks):
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (300, 16), dtype=np.uint8)
    b = np.unpackbits(a, axis=1)
    for row in b:
        row[r.permutation(128)[: r.integers(0, 7)]] ^= 1
    keys = simhash.table_keys(a, 6, blocks), simhash.table_keys(np.packbits(b, axis=1), 6, blocks)
    assert (keys[0] == keys[1]).any(axis=1).all()


def distances(hexes):
    f = np.array([np.frombuffer(bytes.fromhex(x), np.uint64) for x in hexes])
    return np.bitwise_count(f[:, None] ^ f[None]).sum(2)


def test_similar_texts_lie_within_the_radius(spark):
    got = queries.op2_simhash(spark, SF_ORACLE).toPandas().sort_values("doc_id").reset_index(drop=True)
    far, sets = distances(got.fingerprint), [shingles(t) for t in table("documents", SF_ORACLE).text]
    asked = np.flatnonzero(got.doc_id % 20 == 0)
    assert list(got.n_similar[asked]) == list((far[asked] <= simhash.SIMILAR).sum(1) - 1)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert pairs and all(far[p] <= simhash.SIMILAR for p in pairs)


def test_matches_can_be_told_from_the_result(spark):
    got = queries.op2_simhash(spark, SF_ORACLE).toPandas().sort_values("doc_id").reset_index(drop=True)
    far, docs = distances(got.fingerprint), got.groupby("fingerprint").doc_id.agg(list)
    assert got.similar[got.doc_id % 20 != 0].isna().all() and (got.n_near > 0).any()
    for i in np.flatnonzero(got.doc_id % 20 == 0):
        for x in got.similar[i]:
            assert x["doc_id"] == min(docs[x["fingerprint"]]) and x["copies"] == len(docs[x["fingerprint"]])
            assert x["distance"] == far[i, got.index[got.doc_id == x["doc_id"]][0]]
        found = [*docs[got.fingerprint[i]], *(d for x in got.similar[i] for d in docs[x["fingerprint"]])]
        assert sorted(found) == list(got.doc_id[far[i] <= simhash.SIMILAR])


def test_search_finds_edited_copies(spark):
    """Recall by 5-word Jaccard, not by distance."""
    r, texts = np.random.default_rng(0), [w for w in map(words, table("documents", SF_ORACLE).text) if 25 <= len(w) <= 3000][:300]
    pool, rows = [w for t in texts for w in t], []
    for i, t in enumerate(texts):
        e = list(t)
        for k in r.choice(len(t), max(1, round(0.015 * len(t))), False):
            e[k] = pool[r.integers(len(pool))]
        a, b = shingles(" ".join(t)), shingles(" ".join(e))
        if 0.8 * len(a | b) <= len(a & b) < len(a | b):
            rows += [(20 * i, " ".join(t)), (20 * i + 1, " ".join(e))]
    prints = simhash.fingerprints(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    of = {x["doc_id"]: x["fingerprint"] for x in prints.collect()}
    near = {x["fp"]: {y["fingerprint"] for y in x["near"]} | {x["fp"]} for x in simhash.near_fingerprints(prints, "doc_id % 20 = 0").collect()}
    found = np.mean([of[d + 1] in near[of[d]] for d, _ in rows[::2]])
    assert len(rows) > 300 and found > 0.99, (len(rows), found)


@pytest.mark.parametrize("blocks", [3, 8, 10, 17])
def test_probes_miss_nothing_within_the_radius(blocks):
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (40, 16), dtype=np.uint8)
    b = np.unpackbits(a, axis=1)
    for row in b:
        row[r.permutation(128)[:16]] ^= 1
    radii = simhash.block_radii(16, blocks)
    apart = np.stack([np.bitwise_count(x ^ y) for x, y in zip(simhash.block_values(a, blocks), simhash.block_values(np.packbits(b, axis=1), blocks))], axis=1)
    assert sum(radii) + blocks == 17 and (apart <= radii).any(axis=1).all()


@pytest.mark.parametrize("radius,blocks", [(16, None), (16, 9), (6, None), (0, None)])
def test_near_fingerprints_as_brute_force(spark, radius, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)  # split the keys of the large group
    r = np.random.default_rng(radius)
    base = r.integers(0, 256, (60, 16), dtype=np.uint8)
    rows = np.unpackbits(base[np.minimum(r.integers(0, 120, 900), 59)], axis=1)
    for row in rows:
        row[r.permutation(128)[: r.integers(0, 12)]] ^= 1
    hexes = [x.tobytes().hex() for x in np.packbits(rows, axis=1)]
    hexes += hexes[:40]
    prints = spark.createDataFrame(list(enumerate(hexes)), "doc_id LONG, fingerprint STRING")
    far = distances(hexes)
    for x in simhash.near_fingerprints(prints, "doc_id % 20 = 0", radius, blocks).collect():
        i = hexes.index(x["fp"])
        want = {hexes[j]: (hexes.index(hexes[j]), far[i, j], hexes.count(hexes[j])) for j in np.flatnonzero((far[i] <= radius) & (far[i] > 0))}
        assert {y["fingerprint"]: (y["doc_id"], y["distance"], y["copies"]) for y in x["near"]} == want
        assert len(x["near"]) == len(want) and x["copies"] == hexes.count(x["fp"])


# ---------------------------------------------------------------- 3 html


def test_article_text_of_the_pages(spark):
    got = queries.op3_html_extraction(spark, SF_ORACLE).toPandas().sort_values("page_id")
    pages = table("pages", SF_ORACLE)
    assert list(got.url) == list(pages.url) and list(got.n_chars) == [len(t) for t in got.text]
    for text, page in zip(got.text, pages.html):
        inner = re.sub(r"<br>", " ", re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1])
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner))
        assert text == " ".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_labeller_on_unseen_layouts():
    model, r = htmltext.trained(), np.random.default_rng(99)
    pages = [p for p in (htmltext.blocks(htmltext.generated_page(r)) for _ in range(200)) if p]
    want = np.concatenate([[b.label == "1" for _, b in p] for p in pages])
    got = model.probabilities(htmltext.vectors(pages), [len(p) for p in pages]) >= 0.5
    assert (got == want).mean() > 0.98


def test_backpropagation_matches_differences():
    r = np.random.default_rng(0)
    pages = [p for p in (htmltext.blocks(htmltext.generated_page(r)) for _ in range(3)) if p]
    x, sizes = htmltext.vectors(pages), [len(p) for p in pages]
    y = np.concatenate([[float(b.label == "1") for _, b in p] for p in pages])
    model = htmltext.Labeller(1)

    def loss():
        p = np.clip(htmltext._sigmoid(model._forward(x, sizes)), 1e-12, 1 - 1e-12)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() / len(sizes)

    grad = model.gradients(x, sizes, y)
    for name, w in model.w.items():
        at = np.unravel_index(np.abs(grad[name]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        slope = (up - loss()) / 2e-5
        w[at] = old
        assert slope == pytest.approx(grad[name][at], rel=1e-4, abs=1e-7)


def test_blocks_of_broken_markup():
    page = """<body><p>a &lt;b&gt; &amp;x<script>var t="</p>";</script> c<br>d<!-- <p>no --><div>e<span>f</span> <a href='>'>g</a>
    <style>p{}</style><li>h<li>i<p>j<p>k</div><textarea><p>z</textarea>l &nbsp; m"""
    assert [t for t, _ in htmltext.blocks(page)] == ["a <b> &x c d", "ef g", "h", "i", "j", "k", "l m"]
    assert htmltext.blocks("") == [] and [t for t, _ in htmltext.blocks("x < y <")] == ["x < y <"]


@pytest.mark.parametrize("tag", ["select", "svg", "object", "canvas", "noscript"])
def test_an_unclosed_element_hides_no_article(tag):
    body = "<article><p>first part</p>{}<p>second part</p></article><p>third part</p>"
    texts = lambda inner: [t for t, _ in htmltext.blocks(body.format(inner))]
    want = ["first part", "second part", "third part"]
    assert texts(f"<{tag}>")[0] == "first part" and texts(f"<{tag}>")[-2:] == want[1:]  # closed nowhere
    assert texts(f"<{tag}>a<{tag}>b</{tag}>c</{tag}>") == want  # nested
    assert texts(f"<div><{tag}>a</div>") in (want, [want[0], "a", *want[1:]])
    assert texts(f"<div><{tag}>a</div><{tag}>b</{tag}>") == want  # ends with the element around it


def test_math_is_text_and_deep_pages_are_cheap():
    assert [t for t, _ in htmltext.blocks("<p>so <math><mi>x</mi></math> it is</p>")] == ["so x it is"]
    page = "".join(f"<div class=c{k % 50}>text {k}" for k in range(20_000))
    got = htmltext.blocks(page)
    assert len(got) == 20_000 and len(htmltext._slots(got[-1][1].path)) <= 51
    assert htmltext.vectors([got[:10]]).shape == (10, htmltext.INPUT_DIM)
    assert len(htmltext.blocks("<span>" * 20_000 + "<p>a</p>" * 2_000)) == 2_000


# ---------------------------------------------------------------- 4 language


def predictions(spark, samples, texts):
    rows = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING"), samples).orderBy("doc_id").collect()
    return [r["lang_pred"] for r in rows]


def invented(r, letters, words, n):
    """n texts of 30 of the given words' number, made of the given letters."""
    vocabulary = ["".join(r.choice(letters, int(r.integers(2, 7)))) for _ in range(words)]
    return [" ".join(r.choice(vocabulary, 30)) for _ in range(n)]


def test_every_letter_of_the_samples_counts(spark):
    """Two languages without a common letter, and more letters than get a symbol of their own."""
    r = np.random.default_rng(3)
    han = [chr(0x4E00 + k) for k in range(9_000)]
    made = {"aa": invented(r, han[:3000], 2000, 60), "en": invented(r, list("etaoinshrdlu"), 500, 60), "zz": invented(r, han[3000:6000], 2000, 60)}
    samples = tuple((k, "\n".join(v)) for k, v in sorted(made.items()))
    p = langid.Parser(samples)
    flat, first = p.classes(*kernels.buffers(pa.array(["".join(han[:2000]), "".join(han[8000:])])))
    assert len({tuple(flat[k : k + p.digits]) for k in range(0, first[1], p.digits) if flat[k] != 1}) > 1000
    for name, letters in (("aa", han[:3000]), ("zz", han[3000:6000])):
        assert predictions(spark, samples, invented(r, letters, 2000, 50)).count(name) == 50


@pytest.mark.parametrize("words", [20, 60, 150])
def test_a_small_sample_is_not_at_a_loss(spark, words):
    r = np.random.default_rng(words)
    big, small = (["".join(r.choice(list("abcdefghijklmnopqrst"), int(r.integers(3, 8)))) + e for _ in range(300)] for e in ("u", "v"))
    text = lambda own, n: " ".join(r.choice(own, n))
    samples = (("big", text(big, 4000)), ("small", text(small, words)))
    assert predictions(spark, samples, [text(small, 60) for _ in range(100)]).count("small") >= 95
    assert predictions(spark, samples, [text(big, 60) for _ in range(100)]).count("big") >= 95


def test_labels_beyond_the_bound(spark):
    rows = [(k, f"l{k % 300:03d}", f"word{chr(97 + k % 26) * 3} of the label {k % 300}") for k in range(600)] + [(1000, "l299", "word")]
    docs = spark.createDataFrame(rows, "doc_id LONG, lang STRING, text STRING")
    samples = langid.learn(docs, max_sample=4_000)
    assert len(samples) == langid.MAX_LANGUAGES and samples[-1][0] == "l299" and samples[-2][0] == "l254"
    got = langid.identify(docs, samples).collect()
    assert len(got) == 601 and {r["lang_pred"] for r in got} <= {k for k, _ in samples}


def test_languages_of_held_out_documents(spark):
    got = queries.op4_language_id(spark, SF_ORACLE).toPandas().sort_values("doc_id").reset_index(drop=True)
    docs = table("documents", SF_ORACLE)
    held = [zlib.crc32(str(d).encode()) % 4 == 2 for d in docs.doc_id]
    assert list(got.held_out) == held and got.score.between(0, 1).all()
    right = (got.lang_pred == docs.lang)[held]
    assert right.mean() > 0.97


def test_phrases_are_the_greedy_longest_matches():
    samples = (("aa", "abcabdabe hello there"), ("bb", "zyx zzy xyz"))
    p = langid.Parser(samples)
    norm = [" ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) for _, t in samples]
    texts = ["abcabdzz", "Hello, THERE zyx", "ü", "zyxzyx abab", "", None, "a" * 3000, "!!"]
    flat, first = p.classes(*kernels.buffers(pa.array(texts)))
    got = p.phrases(flat, first)
    for d, t in enumerate(texts):
        s = re.sub(r"[^a-zü]+", " ", (t or "").lower()).lstrip()
        for k, sample in enumerate(norm):
            n = 0
            for block in (s[i : i + langid.BLOCK] for i in range(0, len(s), langid.BLOCK)):
                i = 0
                while i < len(block):
                    j = i + 1
                    while j < len(block) and block[i : j + 1] in sample:
                        j += 1
                    n, i = n + 1, j
            assert got[k, d] == n


# ---------------------------------------------------------------- 5 mixing


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    total, w = 1.5 * sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, fixed = {}, set()
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(2 * sizes[s] for s in fixed)
        out = {s: 2 * sizes[s] if s in fixed else left * w[s] / sum(w[r] for r in rest) for s in names}
        over = {s for s in rest if out[s] > 2 * sizes[s]}
        if not over:
            return out
        fixed |= over


def test_mix_of_the_documents(spark):
    got = queries.op5_mixing(spark, SF_ORACLE).toPandas()
    docs = table("documents", SF_ORACLE)
    docs["want"] = [len(WORD.findall(t or "")) for t in docs.text]
    both = got.merge(docs[["doc_id", "want"]], on="doc_id")
    assert len(both) == len(docs) and (both["size"] == both.want).all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    per = got.groupby("source").agg(size=("size", "sum"), ss=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    want = targets(per["size"].to_dict())
    assert (per["size"] == per.ss).all() and np.allclose(per.target, [want[s] for s in per.index])
    assert ((per.taken - per.target).abs() <= 0.1 * per["size"] + 50).all()
    again = queries.op5_mixing(spark, SF_ORACLE).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_targets_with_caps_and_a_null_source(spark):
    sizes = {"b": 10, "a": 1, "c": 5000, None: 70, "é": 0}
    df = spark.createDataFrame(list(sizes.items()), "source STRING, source_size LONG")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == pytest.approx(targets(sizes))


def test_pivotal_keeps_words_and_expectations():
    r = np.random.default_rng(3)
    size, p = r.integers(1, 500, 30).astype(float), r.random(30)
    order = np.argsort(-size)
    size, p = size[order], p[order]
    sums = np.zeros((2, 30))
    for _ in range(3000):
        draw = r.random(30).tolist()
        out, left = mixing.pivotal((p * size).tolist(), size.tolist(), draw)
        assert sum(0 < x < 1 for x in out) == (left is not None) and np.dot(out, size) == pytest.approx(np.dot(p, size))
        whole = mixing.settle(p.tolist(), size.tolist(), draw)
        assert set(whole) <= {0.0, 1.0}
        sums += [out, whole]
    assert np.abs(sums / 3000 - p).max() < 0.05


def test_mix_through_several_levels(spark):
    r = np.random.default_rng(0)
    rows = [(i, "x " * int(r.integers(1, 40)), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    got = mixing.mix(df, bucket_rows=16).toPandas()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert len(got) == 3000 and ((per.taken - per.target).abs() <= 40).all()


# ---------------------------------------------------------------- 6, 7 near duplicates


def roots(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [find(a) for a in range(n)]


def test_embeddings_against_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.25 * r.normal(size=(20, 16)), base[:5], base[:1].repeat(200, 0) + 0.2 * r.normal(size=(200, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    monkeypatch.setattr(vecdedup, "BLOCK", 50)  # splits the large buckets
    got = vecdedup.near_vectors(df).orderBy("vec_id").collect()
    d = x.astype(float)
    cos = d @ d.T / np.sqrt((d * d).sum(1))[:, None] / np.sqrt((d * d).sum(1))[None]
    near = cos >= 0.9
    np.fill_diagonal(near, False)
    assert [g["n_links"] for g in got] == near.sum(1).tolist()
    assert [g["component_id"] for g in got] == roots(len(x), np.argwhere(near))
    assert [g["kept"] for g in got] == [g["vec_id"] == g["component_id"] for g in got]


def brute_near(texts, percent):
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, roots(len(sets), links)


def near_texts():
    r = np.random.default_rng(8)
    base = [f"w{i}" for i in r.integers(0, 5000, 160)]
    texts = []
    for _ in range(140):  # one large group of near copies, some of them too far apart
        w = list(base)
        for at in r.integers(0, len(w), int(r.integers(0, 9))):
            w[at] = f"e{r.integers(0, 10**6)}"
        texts.append(" ".join(w))
    texts += texts[:3] + ["a b c", "A  b\tc", "a b c d", "", None, " \n", "one"] + [" ".join(f"u{i}" for i in r.integers(0, 9000, 30)) for _ in range(40)]
    return texts


@pytest.mark.parametrize("percent", [85, 80])
def test_near_copies_against_all_pairs(spark, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = minhash.near_duplicates(df, percent=percent).orderBy("doc_id").collect()
    sets, want = brute_near(texts, percent)
    assert [g["n_shingles"] for g in got] == [len(s) for s in sets]
    assert [g["component_id"] for g in got] == want
    assert [g["kept"] for g in got] == [g["doc_id"] == g["component_id"] for g in got]


def test_near_copies_of_the_documents(spark):
    got = queries.op7_minhash(spark, SF_SMALL).toPandas().sort_values("doc_id")
    docs = table("documents")
    _, want = brute_near(list(docs.text), 85)
    assert list(got.component_id) == [docs.doc_id[i] for i in want]


# ---------------------------------------------------------------- 8 lines


def patience(later, earlier):
    """Longest common subsequence length of two sequences without repeats, by the plain table."""
    best = np.zeros((len(later) + 1, len(earlier) + 1), int)
    for i, a in enumerate(later):
        for j, b in enumerate(earlier):
            best[i + 1, j + 1] = best[i, j] + 1 if a == b else max(best[i, j + 1], best[i + 1, j])
    return int(best[-1, -1])


@settings(max_examples=60, deadline=None)
@given(st.permutations(list(range(9))), st.permutations(list(range(9))), st.sets(st.integers(0, 8)))
def test_rounds_of_an_alignment(later, earlier, common):
    points = [(i, earlier.index(v)) for i, v in enumerate(later)]
    rounds = linedup.alignment_rounds(points, [v not in common for v in later])
    for r in set(rounds):  # each round is an alignment: no two points cross
        ys = [y for (_, y), k in zip(points, rounds) if k == r]
        assert ys == sorted(set(ys))
    anchors = [v for v, k in zip(later, rounds) if k == 0 and v not in common]
    assert len(anchors) == patience([v for v in later if v not in common], earlier)  # the longest chain of rare lines
    if not common:
        assert rounds.count(0) == patience(later, earlier)


def test_copies_and_crossing_points_take_rounds_of_their_own():
    assert linedup.alignment_rounds([(0, 4), (1, 4), (2, 4)], [True] * 3) == [1, 2, 0] or linedup.alignment_rounds([(0, 4), (1, 4), (2, 4)], [True] * 3).count(0) == 1
    n = 20_000
    assert sorted(linedup.alignment_rounds([(i, n - i) for i in range(n)], [True] * n)) == list(range(n))  # a long document in reverse order
    assert linedup.alignment_rounds([], []) == []


def test_blocks_of_the_alignment_hold_the_same_lines(spark):
    r = np.random.default_rng(12)
    pool = [f"line number {k} of the pool" for k in range(12)] + ["two words", "x"]
    docs = [[pool[k] for k in r.integers(0, len(pool), int(n))] for n in r.integers(1, 12, 60)]
    got = linedup.dedup_lines(spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id LONG, text STRING")).collect()
    seen = 0
    for row in got:
        later, gone = docs[row["doc_id"]], set()
        for b in row["__blocks"] or []:
            assert b["earlier"] < row["doc_id"]
            assert later[b["line"] : b["line"] + b["lines"]] == docs[b["earlier"]][b["at"] : b["at"] + b["lines"]]
            gone.update(range(b["line"], b["line"] + b["lines"]))
            seen += 1
        assert row["__deleted_lines"] == len(gone) and row["text"] == "\n".join(t for k, t in enumerate(later) if k not in gone)
        for first in {b["earlier"] for b in row["__blocks"] or []}:  # round 0 of a pair never crosses itself
            ends = [(b["line"], b["at"]) for b in row["__blocks"] if b["earlier"] == first and b["round"] == 0]
            assert [y for _, y in sorted(ends)] == sorted({y for _, y in ends})
    assert seen > 60


def test_one_line_in_all_documents(spark):
    """A line that 20,000 documents hold pairs each with the first only."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('own words of document number ', id, char(10), 'the line that all documents hold') AS text")
    done = linedup.dedup_lines(docs)
    assert done.where("doc_id > 0 and __deleted_lines = 1 and size(__blocks) = 1 and __blocks[0].earlier = 0").count() == 19_999


def test_repeated_lines_go_from_later_documents(spark):
    a, b, c = "the first shared line of text", "a second line that is shared too", "five words make a line"
    rows = [
        (3, f"{a}\nown words of number three here\n{b}\nyes", "x"),
        (1, f"intro of the first one\n{a}\n{b}\nyes", "x"),
        (2, f"{c}\n\n{a}\n{b}\nyes\nand the end of two", "x"),
        (4, f"{a}\n{b}\nyes", "x"),
        (5, f"yes\n{c} \nyes", "x"),
        (6, None, "x"),
        (None, f"{a}\n{b}", "x"),
        (7, "", "x"),
    ]
    got = {r["doc_id"]: (r["text"], r["__deleted_lines"], r["__left_words"]) for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id LONG, text STRING, gone STRING")).collect()}
    assert got == {
        1: (rows[1][1], 0, None),
        2: (f"{c}\n\nand the end of two", 3, 10),
        3: ("own words of number three here", 3, 6),
        4: ("", 3, 0),
        5: ("yes\nyes", 1, 2),
        6: (None, 0, None),
        None: (f"{a}\n{b}", 0, None),
        7: ("", 0, None),
    }


def test_lines_of_the_documents(spark):
    got = queries.op8_line_dedup(spark, SF_ORACLE).toPandas().set_index("doc_id").text
    docs = table("documents", SF_ORACLE)
    first, left, repeated = {}, 0, 0
    for d, t in zip(docs.doc_id, docs.text):
        before, after = (collections.Counter(tuple(words(x)) for x in (s or "").split("\n")) for s in (t, got[d]))
        for line, n in before.items():
            if len(line) >= 5 and first.setdefault(line, d) == d:
                assert after[line] == n  # the first holder keeps it
            elif len(line) >= 5:
                repeated, left = repeated + n, left + after[line]
        del after[()]
        assert not after - before
    assert left < 0.03 * repeated


def shared_blocks(later, earlier, least=5):
    """Numbers of the later document's lines that lie in a stretch of `least` words which the earlier one has too."""
    out = set()
    for i in range(len(later)):
        for j in range(len(earlier)):
            k = 0
            while i + k < len(later) and j + k < len(earlier) and later[i + k] == earlier[j + k]:
                k += 1
            if sum(map(len, later[i : i + k])) >= least:
                out.update(range(i, i + k))
    return out


def lines_left(spark, texts):
    return [r["text"] for r in linedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")).orderBy("doc_id").collect()]


def test_lines_meet_every_earlier_holder_in_any_order(spark):
    a, b, c, d = ("the %s line has five words" % x for x in ("first", "second", "third", "fourth"))
    texts = [f"{a}\n{b}\n{c}", f"{c}\nown\n{d}", f"{b}\n{c}\n{a}", f"{c}\nown"]
    assert lines_left(spark, texts) == [texts[0], f"own\n{d}", "", ""]


def test_short_lines_and_surplus_copies_go(spark):
    a, verse = "this line has five words", "two words\nthree\nfour\nfive five"
    texts = [f"{a}\none\n{verse}", f"x\n{verse}\none\ntwo words", f"{a}\n{a}\nnew\n{a}"]
    assert lines_left(spark, texts) == [texts[0], "x\none\ntwo words", "new"]


def test_lines_as_every_pair_says(spark):
    r = np.random.default_rng(8)
    pool = [["a"], ["b"], ["a", "b"], ["c", "d", "e"], ["f"] * 4, list("ghijk"), list("lmnopqr")]
    docs = [[pool[i] for i in r.integers(0, len(pool), int(n))] for n in r.integers(0, 14, 120)]
    rows = [(i, "\n".join(" ".join(x) + "\n" * int(r.integers(0, 2)) for x in d)) for i, d in enumerate(docs)]
    got = {x["doc_id"]: [w for w in (words(y) for y in x["text"].split("\n")) if w] for x in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    for i, later in enumerate(docs):
        gone = set().union(*(shared_blocks(later, docs[j]) for j in range(i)))
        assert got[i] == [y for k, y in enumerate(later) if k not in gone]


def test_no_later_document_keeps_a_long_line(spark):
    got = queries.op8_line_dedup(spark, SF_ORACLE).toPandas().set_index("doc_id").text
    docs, first = table("documents", SF_ORACLE), {}
    for d, t in zip(docs.doc_id, docs.text):
        after = {tuple(words(x)) for x in (got[d] or "").split("\n")}
        for line in {tuple(words(x)) for x in (t or "").split("\n")}:
            assert len(line) < 5 or (first.setdefault(line, d) == d) == (line in after)


# ---------------------------------------------------------------- 9 chat


def test_escaping_is_reversible(spark):
    r = np.random.default_rng(6)
    parts = ["\\", "<", "|", "im_start", "im_end", "|>", "</s>", "[INST]", "[/", "]", "s>", "a", "\n", "$1", "im_sep", *chat.CONTROL]
    texts = ["".join(r.choice(parts, int(n))) for n in r.integers(0, 14, 1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for row in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert row["u"] == row["t"] and not any(c in row["e"] for c in chat.CONTROL)


def test_conversations_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_ORACLE}/conversations.parquet'")
    want = con.execute(queries.ORACLES["op9_chat_formatting"]).df()
    got = queries.op9_chat_formatting(spark, SF_ORACLE).toPandas()[list(want.columns)]
    assert got.sort_values("conv_id").reset_index(drop=True).astype(str).equals(want.sort_values("conv_id").reset_index(drop=True).astype(str))


def test_examples_of_a_conversation(spark):
    rows = [(1, 1, "assistant", "re|ply"), (1, 0, "user", "[INST] hi"), (1, 2, "user", None), (2, 0, "assistant", ""), (None, None, None, "x")]
    got = chat.examples(spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")).orderBy("conv_id", "example").collect()
    spans = [(r["conv_id"], r["example"], r["formatted"][r["loss_from"] : r["loss_to"]]) for r in got]
    assert spans == [(None, 0, ""), (1, 1, "re|ply"), (1, 2, ""), (2, 0, "")]
    assert got[1]["formatted"] == "<|im_start|>user<|im_sep|>[\\INST] hi<|im_end|><|im_start|>assistant<|im_sep|>re|ply<|im_end|>"


# ---------------------------------------------------------------- 10 quality


def test_junk_goes_and_clean_documents_stay(spark):
    got = queries.op10_quality(spark, SF_ORACLE).toPandas()
    both = got.merge(table("labels", SF_ORACLE), on="doc_id")
    assert both[both.quality == 0].kept.mean() < 0.05 and both[both.quality == 1].kept.mean() > 0.97


def test_weights_and_counts_against_plain_python(spark):
    texts = ["abc abc abc abc xyz", "", None, "a", "abcd é", "no repeats here at all"]
    df = spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(texts)], "text STRING, good BOOLEAN")
    counts = {r["bucket"]: (r["raw"], r["target"]) for r in quality.count_ngrams(df.repartition(3)).collect()}
    n_bytes = sum(max(len((t or "").encode()) - 2, 0) for t in texts)
    assert sum(raw for b, (raw, _) in counts.items() if b < 1 << quality.BYTE_BITS) == n_bytes
    ratios = np.arange(quality.BUCKETS, dtype=np.int64)
    arr = pa.array(texts)
    whole = quality.score_texts(arr, ratios)
    alone = np.concatenate([quality.score_texts(pa.array([t], type=pa.string()), ratios) for t in texts])
    assert np.array_equal(whole, alone) and whole[1] == whole[2] == 0

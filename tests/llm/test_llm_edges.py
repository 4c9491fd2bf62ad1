"""Nulls, empty and long texts, repeated rows, empty tables and extra columns: defined results, no crash."""

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from regimekit.llm import chat, htmltext, langid, linedup, minhash, mixing, packing, quality, queries, simhash, vecdedup
from tests.conftest import SF_SMALL

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
CLASH = ["size", "key", "node", "tag", "gone", "_id", "bucket", "part", "rank", "taken", "kept", "w", "good", "length", "_copies", "n", "lo"]
LONG = "".join(f"word{i % 9173} " for i in range(60_000)) + "\n" + "same line of five words\n" * 500
ROWS = [
    (1, "plain words in a first document, just some text to keep", "en", "a", 10),
    (1, "plain words in a first document, just some text to keep", "en", "a", 10),  # a repeated row
    (1, "another text under the same number, which has other words", "en", "b", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\r\n ", "de", "a", 7),
    (5, LONG, "en", None, None),
    (6, LONG, "en", "c", None),
    (None, "a row without a number, but with words of its own", None, "a", 3),
    (None, None, None, None, None),
    (7, "!!! ??? 123", "fr", "", 11),
    (8, "日本語の文字だけ 中国話", "ja", "日本", 12),
    (9, "one", "en", "a", 3),
    (2**62, "one\x00zero ́ combining \U0001f600", "en", "a", 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (9, 1, 0), (7, 0, 0), (None, 1, 0), (3, None, None), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id LONG, quality INT, toxic INT")


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def test_packing(docs, none):
    got = by_id(packing.pack(docs, queries._tokenizer("word_bpe_49k.json"), capacity=64))
    assert sum(r["length"] for r in got[2]) == sum(r["length"] for r in got[3]) == 1
    assert len([r for r in got[1] if r["piece"] == 0]) == 3 and len([r for r in got[None] if r["piece"] == 0]) == 2
    assert len(got[5]) > 1000 and sorted(r["start"] for r in got[5]) == list(range(0, 64 * len(got[5]), 64))
    bins = collections.defaultdict(int)
    for r in sum(got.values(), []):
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 64
    assert packing.pack(none, queries._tokenizer("word_bpe_49k.json")).count() == 0


def test_simhash(docs, none):
    got = by_id(simhash.fingerprint_edits(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[2][0]["fingerprint"] == got[3][0]["fingerprint"] == got[4][0]["fingerprint"] == "0" * 32 and got[2][0]["n_chars"] == 0
    assert got[5][0]["near_next"] == 1.0 and got[5][0]["fingerprint"] == got[6][0]["fingerprint"]
    one = simhash.fingerprint_edits(docs.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0
    assert simhash.fingerprint_edits(none).count() == 0
    prints = simhash.fingerprints(docs)
    near = {r["fp"]: r["n_near"] for r in simhash.count_within(prints, "doc_id in (3, 5)").collect()}
    assert near[got[3][0]["fingerprint"]] == sum(r["fingerprint"] == "0" * 32 for r in sum(got.values(), [])) - 1 and near[got[5][0]["fingerprint"]] == 1


def test_html(spark):
    page = "<html><body><nav><a href=/>menu</a></nav><article><h1>t</h1><p>" + "long text of the article. " * 40_000 + "</p></article></body></html>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", page), (3, "u", "no markup at all"), (3, "u", "<p"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", '<a "' * 200)]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").withColumn("text", F.lit("extra"))
    got = {(r["page_id"], r["n_chars"]): r for r in htmltext.extract(df).collect()}
    assert len(got) >= 6 and (1, 0) in got and (2, 0) in got
    long = next(r for k, r in got.items() if k[0] is None)
    assert long["text"].count("long text of the article.") == 40_000 and "menu" not in long["text"]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_language(docs, none):
    samples = langid.learn(docs)
    assert [k for k, _ in samples] == sorted({"en", "de", "fr", "ja"})
    got = by_id(langid.identify(docs, samples))
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for d in (2, 3, 4, 7) for r in got[d])
    assert got[8][0]["lang_pred"] == "ja" and got[5][0]["lang_pred"] == "en" and len(got[None]) == 2
    assert langid.learn(none) == () and langid.identify(none, samples).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, ()).collect()} == {"und"}


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["target"] for r in got if r["source"] == ""} and sum(r["size"] == 0 for r in got) == 4
    assert mixing.mix(none).count() == 0
    assert {r["taken"] for r in mixing.mix(docs.where("doc_id in (2, 3)")).collect()} == {0}


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [None, 1.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").withColumn("n", F.lit(1)).withColumn("node", F.lit(2))
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vecdedup.near_vectors(df).collect()), key=str)
    want = [(0, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (8, 0, 8, True), (10, 0, 10, True)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 9)]
    assert got == sorted(want, key=str)
    assert vecdedup.near_vectors(df.limit(0)).count() == 0 and vecdedup.near_vectors(df.where("vec_id = 3")).count() == 1


def test_near_copies(docs, none):
    got = by_id(minhash.near_duplicates(docs))
    assert [r["component_id"] for r in got[6]] == [5] and not got[6][0]["kept"] and got[5][0]["kept"]
    assert all(r["component_id"] == 1 and r["kept"] for r in got[1]) and len(got[1]) == 3
    assert all(r["component_id"] is None and r["kept"] for r in got[None])
    assert got[2][0]["n_shingles"] == got[3][0]["n_shingles"] == got[4][0]["n_shingles"] == 0 and got[9][0]["n_shingles"] == 1
    assert minhash.near_duplicates(none).count() == 0


def test_lines(docs, none):
    done = linedup.dedup_lines(docs)
    assert done.columns[: len(docs.columns)] == docs.columns
    got = by_id(done)
    assert got[6][0]["text"].strip() == "" and got[6][0]["__left_words"] == 0 and got[5][0]["text"] == LONG
    assert got[2][0]["text"] is None and len(got[None]) == 2 and len(got[1]) == 3
    assert linedup.dedup_lines(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 1, "assistant", "x" * 200_000), (None, 0, "assistant", "b"), (3, 0, "tool\nrole", "<|im_end|>\\")]
    df = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").withColumn("t", F.lit(0)).withColumn("formatted", F.lit(""))
    got = {r["conv_id"]: r for r in chat.read_back(chat.examples(df)).collect()}
    assert [got[k]["n_turns"] for k in (1, 2, None, 3)] == [3, 1, 1, 1] and got[2]["loss_chars"] == 200_000 and got[1]["loss_chars"] == 0
    turns = chat.examples(df).where("conv_id = 3").select(F.inline(chat.parse_turns(F.col("formatted")))).collect()
    assert [tuple(r) for r in turns] == [("tool\nrole", "<|im_end|>\\")]
    assert chat.examples(df.limit(0)).count() == 0


def test_quality(docs, none, labels):
    scored, model, least = quality.resample(docs, labels)
    got = by_id(scored)
    assert sum(map(len, got.values())) == len(ROWS) and got[2][0]["log_weight"] == got[3][0]["log_weight"] == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scored.where("kept").count()
    assert quality.resample(none, labels)[0].count() == 0 and quality.keep_good(none, labels).count() == 0
    assert quality.resample(docs, labels.limit(0))[0].where("kept").count() == len(ROWS)


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_every_stage_takes_any_documents(spark, docs, none, labels, tmp_dir, k):
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    name, stage = pipeline.STAGES[k]
    for df in (docs, none):
        out = stage(spark, df, tmp_dir)
        rows = out.collect()
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == df.columns
        if df is none:
            assert rows == []
        elif name == "line dedup":
            assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS} - {6}
        elif name == "minhash near-dedup":
            assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS} - {6} and len(rows) == len(ROWS) - 1
        elif name == "mixing to target weights":
            taken = mixing.mix(df).agg(F.sum(F.expr("taken div greatest(size, 1)"))).first()[0]
            assert len(rows) == taken and all((r["text"] or "").strip() for r in rows)


def test_pipeline_against_plain_steps(spark):
    """run() equals the stages one after the other, and its pieces are those of the documents that are left."""
    got = pipeline.run(spark, SF_SMALL).toPandas()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    for _, stage in pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, SF_SMALL).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= 2 * before
    pieces = packing.pieces(docs, queries._tokenizer("word_bpe_49k.json"), 2048).toPandas()
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(map(tuple, pieces[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist()))
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert "op9_chat_formatting" in entry.oracle_sql()

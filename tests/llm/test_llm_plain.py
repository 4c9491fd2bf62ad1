"""Operators 5, 7 and 10 against plain recounts, and the plans of joins on hot keys."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimekit.llm import kernels as K
from regimekit.llm import minhash, mixing, quality
from tests.conftest import SF_SMALL


def word_hash(w):
    raw = np.frombuffer(w, np.uint8)
    return int(K.words(raw, np.array([0, len(w)]))[0][0])


def plain_buckets(text):
    """The bucket of every n-gram of one text, one by one."""
    raw = (text or "").encode()
    out = [((int.from_bytes(raw[i : i + 3], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - quality.BYTE_BITS) for i in range(len(raw) - 2)]
    words = [w for w in raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    hashes = [word_hash(w) for w in words]
    base, shift = 1 << quality.BYTE_BITS, 64 - quality.WORD_BITS
    out += [base + (h >> shift) for h in hashes]
    for i in range(1, len(hashes)):
        if hashes[i] == hashes[i - 1]:
            out.append(base)  # the pair of a repeated word
        else:
            two = np.array(hashes[i - 1 : i + 1], dtype=np.uint64)
            out.append(base + (int(K.ngrams(two, np.array([0, 2]), 2)[0][0]) >> shift))
        for order in range(quality.RUNS):
            if i >= order + 2 and len(set(hashes[i - order - 2 : i + 1])) == 1:
                out.append(base + 1 + order)
    return out


def plain_resample(spark, docs, labels, dependence, min_posterior=0.005, seed=5):
    """``(doc_id, log weight, kept)`` by dictionaries and one sort."""
    known = {}
    for d, q in labels:
        if d is not None and q is not None:
            known[d] = min(q, known.get(d, q))
    good = {d for d, q in known.items() if q == 1}
    raw, target = collections.Counter(), collections.Counter()
    grams = [(d, plain_buckets(t)) for d, t in docs]
    for d, g in grams:
        raw.update(g)
        if d in good:
            target.update(g)
    ratio = {}
    for part in (range(1 << quality.BYTE_BITS), range(1 << quality.BYTE_BITS, quality.BUCKETS)):
        n_raw, n_target = (sum(c[b] for b in part) + len(part) for c in (raw, target))
        for b in part:
            ratio[b] = math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw)
    noise = {r["d"]: r["g"] for r in spark.createDataFrame([(d,) for d in {d for d, _ in docs}], "d long").select("d", quality.gumbel(F.col("d"), seed).alias("g")).collect()}
    rows = []
    for d, g in grams:
        weight = sum(ratio[b] for b in g) / (1 + max(len(g) - 1, 0) * dependence)
        rows.append((d, weight, weight + noise[d]))
    floor = math.log(min_posterior) - math.log(len(good) / len(known))
    k = sum(w >= floor for _, w, _ in rows)
    least = sorted((key for _, _, key in rows), reverse=True)[k - 1]
    return [(d, w, key >= least) for d, w, key in rows]


@pytest.mark.parametrize("dependence", [quality.DEPENDENCE, 0.0])
def test_quality_against_a_plain_recount(spark, dependence):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").where("doc_id < 150")
    odd = spark.createDataFrame([(1001, "a a a a a a b b b"), (1002, ""), (1003, None), (1004, "ab"), (1005, "word " * 400)], docs.schema)
    docs = docs.unionByName(odd)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "quality")
    plain = plain_resample(spark, [tuple(r) for r in docs.collect()], [tuple(r) for r in labels.where("doc_id < 150").collect()], dependence)
    got = {r["doc_id"]: r for r in quality.resample(docs, labels.where("doc_id < 150"), dependence=dependence)[0].collect()}
    assert len(got) == len(plain)
    for d, weight, kept in plain:
        # ratios are rounded to 1 / SCALE each
        assert got[d]["log_weight"] == pytest.approx(weight, abs=1e-4 if dependence else 0.2)
        assert got[d]["kept"] == kept


def test_equal_rows_are_dealt_over_the_buckets_of_a_mix(spark):
    equal = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("three equal words").alias("text"), F.lit("a").alias("source"))
    own = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some other words here").alias("text"), F.lit("b").alias("source"))
    docs = equal.unionByName(own)
    first = mixing.mix(docs, bucket_rows=64).groupBy("source", "doc_id", "taken", "target").count().toPandas()
    assert first["count"].sum() == 22_000
    again = mixing.mix(docs.repartition(5), bucket_rows=64).groupBy("source", "doc_id", "taken", "target").count().toPandas()
    key = ["source", "doc_id", "taken"]
    assert first.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    for _, rows in first.groupby("source"):
        assert abs((rows["taken"] * rows["count"]).sum() - rows["target"].iloc[0]) <= 4


def test_pairs_below_the_match_threshold_are_not_confirmed(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p"), (2, "a b c d e f g h i j k l m n o q"), (3, "r s t u v w x y z a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = minhash.shingle_sets(docs.select("text"), 5, 32, 64).cache()
    node = {r["doc_id"]: r["node"] for r in minhash.fingerprints(docs).select("doc_id", "node").collect()}
    posts = {r["node"]: np.frombuffer(r["posts"], np.uint32) for r in sets.collect()}
    pairs = spark.createDataFrame([(node[1], node[2]), (node[1], node[3])], "u binary, v binary")
    matches = int((posts[node[1]] == posts[node[2]]).sum())
    assert matches > int((posts[node[1]] == posts[node[3]]).sum())
    for threshold, expected in ((0, 1), (matches, 1), (matches + 1, 0)):
        got = minhash.confirmed(pairs, sets, 80, threshold).collect()
        assert [(r["u"], r["v"]) for r in got] == [(node[1], node[2])] * expected
    # collisions of postings are collisions of the four-byte coordinates
    keys = {r["doc_id"]: r["keys"] for r in minhash.fingerprints(docs).collect()}
    assert sum(a == b for a, b in zip(keys[1], keys[2])) == matches


def test_last_join_of_near_duplicates_has_a_shuffle_on_each_side(spark):
    n = 40_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("one text that all even rows hold")).otherwise(F.concat_ws(" ", F.lit("row"), "id", F.lit("has words of its own"))).alias("text"))
    out = minhash.near_duplicates(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "least(node" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = out.groupBy("kept").agg(F.count("*").alias("n"), F.min("component_id").alias("c")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["kept"]: r["n"] for r in got} == {True: n // 2 + 1, False: n // 2 - 1}

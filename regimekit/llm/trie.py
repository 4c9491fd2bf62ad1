"""Prefix trie of conversations by a van Emde Boas recursion.

All sequences are laid in blocks of ``2**m`` depths.  A block is cut at half its depth: the name of the prefix at
the cut is the name where the block starts hashed with the name of the block's upper half, the upper trie keeps
the block's start, and the lower tries, one for each cut prefix, start at that name.  Both halves are cut again,
all blocks of a height in one Spark step, so after ``m`` steps every prefix has its name, whatever the lengths.

Totals go the other way: the tries of height ``2**j`` come from an upper trie and its lower forests of half that height.
The sums of a lower forest are grafted on the cut node it hangs from and on that node's ancestors in the upper trie, which the
cut node's least member has on its path.  Again all blocks of a height are one step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import kernels as K

ROOT = "0" * 32
NO_ENDS = hashlib.sha256(b"").hexdigest()
TURNS = 64  # turn numbers whose rows one task orders
IDS = 4096  # conv_ids joined to one string


def _name(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("/", *parts))


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, p, name, words``: turn 1, 2, … of each conversation, its 128-bit name and its number of words.

    Order: turn (null first), then role, then text.  Rows of one conversation are numbered by blocks of turn numbers.
    """
    df = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    df = df.where("conv_id is not null")
    block = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62))).cast("long")
    words = F.size(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).cast("long")
    equal = df.groupBy("conv_id", block.alias("block"), "turn", "role", "text").agg(F.count("*").alias("times"))
    named = equal.select("conv_id", "block", "turn", "role", "text", "times", F.md5(F.concat(F.length("role").cast("string"), F.lit("/"), "role", "text")).alias("name"), words.alias("words"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumn("upto", F.sum("times").over(inside)).select("conv_id", "block", "times", "name", "words", "upto")
    counts = equal.groupBy("conv_id", "block").agg(F.sum("times").alias("c"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("conv_id").alias("c2"), F.col("block").alias("b2"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))
    placed = named.join(shift, (F.col("conv_id") == F.col("c2")) & (F.col("block") == F.col("b2")))
    last = F.col("shift") + F.col("upto")
    return placed.select("conv_id", F.explode(F.sequence(last - F.col("times") + 1, last)).alias("p"), "name", "words")


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The conversations and their turns with the first ``crc32(conv_id) % most`` ones of conversation ``c - c % group``.

    ``own`` has the rows of ``turns``.  Returns ``(conv_id, n)`` and ``(conv_id, p, name, words)``.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = own.groupBy("conv_id").agg(F.max("p").alias("n")).withColumns({"h": h, "base": base})
    first = own.where((F.col("p") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "p", "name", "words")
    has = first.groupBy("base").agg(F.max("p").alias("k"))
    convs = convs.join(has, "base", "left").withColumn("head", F.least("h", F.coalesce("k", F.lit(0))).cast("long"))
    convs = C.stage(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "trie-convs")
    heads = convs.select("conv_id", "base", "head").join(first, "base").where("p <= head").select("conv_id", "p", "name", "words")
    tails = own.join(C.dealt_again(convs.select("conv_id", "h", "head"), "conv_id", "c2"), F.col("conv_id") == F.col("c2")).where("p > h")
    tails = tails.select("conv_id", (F.col("p") - F.col("h") + F.col("head")).alias("p"), "name", "words")
    return convs.select("conv_id", "n"), C.stage(heads.unionByName(tails), "trie-turns")


def prefixes(convs: DataFrame, seq: DataFrame) -> tuple[DataFrame, int]:
    """``conv_id, d, node`` for d = 0 … n: the name of each conversation's first ``d`` turns; and ``m``."""
    longest = convs.agg(F.max("n")).first()[0] or 0
    m = int(longest).bit_length()  # 2**m > longest
    halves = [seq.select("conv_id", (F.col("p") - 1).alias("i"), "name")]
    for _ in range(1, m):  # names of the full blocks of 2, 4, … turns
        pair = halves[-1].groupBy("conv_id", F.expr("i div 2").alias("b")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("right"))
        pair = pair.where("left is not null and right is not null").select("conv_id", F.col("b").alias("i"), _name("left", "right").alias("name"))
        halves.append(C.stage(pair, "trie-blocks"))
    at = convs.select("conv_id", "n", F.lit(0).cast("long").alias("b"), F.lit(ROOT).alias("node"))
    for j in range(m - 1, -1, -1):  # cut blocks of 2**(j + 1) depths into halves of 2**j
        upper = halves[j].where("i % 2 = 0").select(F.col("conv_id").alias("c2"), F.expr("i div 2").alias("b2"), "name")
        cut = at.join(upper, (F.col("conv_id") == F.col("c2")) & (F.col("b") == F.col("b2")), "left")
        two = F.array(F.struct((F.col("b") * 2).alias("b"), "node"), F.struct((F.col("b") * 2 + 1).alias("b"), _name("node", "name").alias("node")))
        low = F.array(F.struct((F.col("b") * 2).alias("b"), "node"))
        at = cut.select("conv_id", "n", F.explode(F.when((F.col("b") * 2 + 1) * (1 << j) <= F.col("n"), two).otherwise(low)).alias("x")).select("conv_id", "n", "x.*")
    return C.stage(at.select("conv_id", F.col("b").alias("d"), "node", (F.col("b") == F.col("n")).alias("ends")), "trie-prefixes"), m


def grafted(nodes: DataFrame, paths: DataFrame, m: int) -> DataFrame:
    """``node, saved, leaves``: sums over each node's subtree of ``own`` and ``leaf`` of ``nodes``.

    ``nodes`` has ``node, parent, depth, member, own, leaf``, and ``paths`` the prefixes' ``conv_id, d, node``.
    """
    now = C.stage(nodes.select("node", "parent", F.col("depth").alias("d"), "member", F.col("own").alias("saved"), F.col("leaf").alias("leaves")), "trie-sums")
    for j in range(m):  # upper and lower tries of 2**j depths become tries of 2**(j + 1)
        half = 1 << j
        tops = now.where(F.col("d") % (2 * half) == half)
        forest = tops.groupBy("parent").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        leaf = now.where(F.col("d") % (2 * half) == half - 1).select(F.col("node").alias("cut"), "member", F.expr(f"d div {half}").alias("block"))
        hung = forest.join(leaf, F.col("parent") == F.col("cut")).select("member", "block", F.col("saved").alias("s"), F.col("leaves").alias("l"))
        path = paths.where(F.col("d") % (2 * half) < half).select("conv_id", F.expr(f"d div {half}").alias("b2"), F.col("node").alias("n2"))
        graft = hung.join(path, (F.col("member") == F.col("conv_id")) & (F.col("block") == F.col("b2"))).groupBy("n2").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
        done = now.join(graft, F.col("node") == F.col("n2"), "left")
        now = C.stage(done.select("node", "parent", "d", "member", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")), "trie-sums")
    return now.select("node", "saved", "leaves")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and block: one digest a node over its id strings, of which one is held at a time."""
    node, h = None, None
    for batch in batches:
        nodes, out = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if k != node:
                if node is not None:
                    nodes.append(node)
                    out.append(h.hexdigest())
                node, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.string()), pa.array(out, type=pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the nodes where conversations end: the digest of their ids in order, joined by commas."""
    n = C.shuffle_width(paths.sparkSession)
    ids = paths.where("ends").groupBy("node", F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))
    text = ids.select("node", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return text.repartition(n, "node").sortWithinPartitions("node", "block").mapInArrow(K.tidy(_digest), "node string, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    ``rows`` has ``conv_id, turn, role, text``.  Turns are ordered by turn (null first), then role and text; a null role or
    text is empty; repeated rows are turns of their own; rows with a null conv_id belong to no
    conversation.  Without conversations there is no node.  Other columns are not read.  Columns: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    C.prepare(rows.sparkSession)
    convs, seq = rebuilt(C.stage(turns(rows), "trie-own"))
    paths, m = prefixes(convs, seq)

    found = paths.groupBy("node").agg(F.min("conv_id").alias("member"), F.min("d").alias("depth"), F.count("*").alias("n_convs"))
    last = seq.select(F.col("conv_id").alias("c2"), F.col("p").alias("d2"), "words")
    found = found.join(last, (F.col("member") == F.col("c2")) & (F.col("depth") == F.col("d2")), "left").drop("c2", "d2")
    above = paths.select(F.col("conv_id").alias("c2"), (F.col("d") + 1).alias("d2"), F.col("node").alias("parent"))
    found = C.stage(found.join(above, (F.col("member") == F.col("c2")) & (F.col("depth") == F.col("d2")), "left").drop("c2", "d2"), "trie-nodes")
    children = found.where("parent is not null").groupBy(F.col("parent").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = found.join(children, F.col("node") == F.col("p2"), "left").drop("p2")
    own = (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))
    nodes = nodes.select("*", own.alias("own"), F.col("n_children").isNull().cast("long").alias("leaf"))
    nodes = C.stage(nodes, "trie-nodes")

    sums = grafted(nodes, paths, m)
    named = nodes.select(F.col("node").alias("p2"), F.col("member").alias("parent_conv_id"))
    out = nodes.join(sums.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"))
    out = out.join(named, F.col("parent") == F.col("p2"), "left").join(ends(paths).withColumnRenamed("node", "n3"), F.col("node") == F.col("n3"), "left")
    return out.select(
        F.col("member").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaves").cast("long").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )

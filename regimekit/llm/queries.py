"""Registered queries of the numbered operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimekit.llm import chat, htmltext, langid, linedup, minhash, mixing, packing, quality, simhash, spelling, sql, suffixdedup, trie, vecdedup
from regimekit.llm.common import dealt_again, stage, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity=2048)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints, and for rows whose doc_id is divisible by 20 the others that are near.

    ``n_near`` counts the other rows within 6 bits (hardly more than exact copies), ``n_similar`` those within 18 (5-word Jaccard of about 0.8).
    ``similar`` names the latter: the other fingerprints, each with its least doc_id, distance and number of rows.  The rows of
    a fingerprint, its own included, are those of the result that have it.
    """
    prints = stage(simhash.fingerprint_edits(table(spark, sf_dir, "documents")), "simhash-edits")
    near = simhash.near_fingerprints(prints, "doc_id % 20 = 0", simhash.SIMILAR)
    near = near.select(F.col("fp").alias("fingerprint"), simhash.rows_within("near", "copies", 6).alias("n_near"), simhash.rows_within("near", "copies", simhash.SIMILAR).alias("n_similar"), F.sort_array("near").alias("similar"))
    asked = prints.where("doc_id % 20 = 0").join(dealt_again(near, "fingerprint", "found"), F.col("fingerprint") == F.col("found"), "left")
    rest = prints.where("doc_id is null or doc_id % 20 != 0").withColumns({"n_near": F.lit(None).cast("long"), "n_similar": F.lit(None).cast("long"), "similar": F.lit(None).cast(simhash.NEAR)})
    return asked.select(*prints.columns, "n_near", "n_similar", "similar").unionByName(rest)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the rows whose crc32(doc_id) mod 4 is not 2; the others are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    samples = langid.learn(docs.where(~held_out))
    return langid.identify(docs, samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its aligned blocks: the text left, how many lines went, and the earlier documents it was aligned with."""
    done = linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.col("__deleted_lines").cast("long").alias("deleted_lines"), F.sort_array(F.array_distinct("__blocks.earlier")).alias("aligned_with"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.examples(rows))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that an earlier one has."""
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the frequent words they are variants of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


# RE2 has no look-ahead: count the control strings instead of inserting the backslashes
_CONTROLS = r"<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"

ORACLES: dict[str, str] = {
    "op9_chat_formatting": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n,
    32 + length(role) + length(text) + (length(role) - length(replace(role, '\', ''))) + (length(text) - length(replace(text, '\', '')))
    + len(regexp_extract_all(role, '{_CONTROLS}')) + len(regexp_extract_all(text, '{_CONTROLS}')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY p) AS upto FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR p = n - 1))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
""",
    "op11_prefix_trie": sql.OP11,
    "op12_suffix_dedup": sql.OP12,
    "op13_spelling_variants": sql.OP13,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash": op2_simhash,
    "op3_html_extraction": op3_html_extraction,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_minhash": op7_minhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

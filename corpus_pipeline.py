"""A corpus pipeline of the numbered operators: each stage maps documents to documents.

Every stage but the last returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regimekit.llm import common, linedup, minhash, mixing, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling of operator 10 rejects go; nothing else changes.

    A null, empty or very short text has no n-grams, so its weight is 1 and it goes by its draw alone.  Repeated rows
    have equal keys and stay or go together, as do rows that tie with the last one kept.  Rows with a null doc_id
    share one draw.  Without good labels every document stays; an empty table stays empty.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines go from the later documents, and documents of which no word is left.

    ``n_chars`` follows the text where the column exists.  Documents without repeated blocks stay as they are.
    """
    done = linedup.dedup_lines(docs).where("__left_words is null or __left_words > 0")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        done = done.withColumn("n_chars", F.when(F.col("__deleted_lines") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id.

    Documents without words and rows with a null doc_id stay.  Of repeated rows of one doc_id
    each stays if that doc_id stays.
    """
    found = minhash.near_duplicates(docs, percent=80)
    gone = common.stage(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "pipeline-gone")
    # texts that surely stay pass by; only the others, and a few more, are looked up
    likely = common.likely_in(gone, "__gone")(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    looked_up = docs.where(likely).join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    return docs.where(~likely).unionByName(looked_up)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents without words are not taken.  Copies of a document are equal rows.  Rows that repeat a doc_id
    are told apart by size and source, and equal ones take the numbers of copies in turn.
    """
    mixed = mixing.mix(docs).where("taken > 0")
    names = ["__id", "__size", "__source", "__nth"]
    nth = F.row_number().over(Window.partitionBy("doc_id", "size", "source").orderBy(F.col("taken").desc()))
    copies = mixed.select(F.col("doc_id").alias("__i"), F.col("size").alias("__s"), F.col("source").alias("__so"), nth.alias("__n"), F.expr("cast(taken div size as int)").alias("__copies"))
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__size": mixing.size_of(F.col("text")), "__source": F.col("source").cast("string")})
    keyed = keyed.withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__size", "__source").orderBy(F.xxhash64("text"))))
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names, ["__i", "__s", "__so", "__n"])]
    joined = keyed.join(copies, on[0] & on[1] & on[2] & on[3])
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left and their places in sequences of 2048 tokens.

    A null or empty text is one piece that holds the end token only; a long one is cut into pieces.  Every row is
    packed, repeated ones and those with a null doc_id too.  An empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), capacity=2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


#: Hash-based scores, alignments and random draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None

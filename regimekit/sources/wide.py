"""Wide price tables (S1): CSV with one column per ticker, known only from the header.

Lines are split as text, so the plan has the same few columns for 5 tickers and for 50,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimekit.operators.chunks import with_rows_of
from regimekit.session import cut_lineage

BLOCK = 8192  # columns of a line that are put together or taken apart at a time


def read_wide_prices(spark: SparkSession, path: str, ts: str = "Date") -> DataFrame:
    """``entity, ts, price`` of a CSV file or folder; a file's header begins with ``ts`` and names its tickers.

    Files may have different tickers.  Empty cells and cells that are no number are missing prices and have no row.
    Lines meet their header by pieces of ``BLOCK`` columns, so the work of a wide file is dealt over tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "[\r\"]", ""), ",").alias("cells"))
    is_head = F.trim(F.col("cells")[0]) == ts
    heads = lines.where(is_head).groupBy("file").agg(F.first("cells").alias("cells"))  # one row a file
    heads = heads.select("file", F.explode(_pieces("cells")).alias("x")).select("file", "x.block", F.col("x.cells").alias("head"))
    rows = lines.where(~is_head & (F.size("cells") > 1)).select("file", F.col("cells")[0].alias("ts"), F.explode(_pieces("cells")).alias("x"))
    rows = with_rows_of(rows.select("file", "ts", "x.block", "x.cells"), heads, ["file", "block"], "inner")
    pairs = F.arrays_zip(F.col("head").alias("entity"), F.col("cells").alias("price"))
    long = rows.select(F.to_timestamp_ntz("ts").alias("ts"), F.explode(pairs).alias("x"))
    price = F.expr("try_cast(x.price AS double)")
    return long.select(F.trim("x.entity").alias("entity"), "ts", price.alias("price")).where("price is not null and not isnan(price) and entity is not null and entity != ''")


def _pieces(cells: str) -> Column:
    """The cells after the first as an array of ``block, cells``, ``BLOCK`` cells a piece."""
    last = F.greatest(F.ceil((F.size(cells) - 1) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("block"), F.slice(cells, i * BLOCK + 2, F.lit(BLOCK)).alias("cells")))


def write_wide_prices(prices: DataFrame, path: str, ts: str = "Date") -> None:
    """The wide form of a long panel: one file with a line per timestamp and a column per entity, in name order.

    A line holds all entities of its timestamp, as the format wants it; the header is a line of the same size.  It is put
    together from pieces of ``BLOCK`` columns, from the cells that have a row.  A pair of entity and timestamp may occur once.
    """
    spark, prices = prices.sparkSession, cut_lineage(prices.select("entity", "ts", "price"), "wide-prices")  # read for the names and for the cells
    columns = _columns(prices)
    n = columns.agg(F.count("*")).scalar()
    located = with_rows_of(prices, columns, ["entity"])
    col = F.coalesce("col", F.raise_error(F.lit("a price without an entity")).cast("int"))
    body = located.select(F.lit(1).alias("o"), "ts", col.alias("col"), F.coalesce(F.col("price").cast("string"), F.lit("")).alias("text"))
    no_ts = F.lit(None).cast(prices.schema["ts"].dataType).alias("ts")
    head = columns.select(F.lit(0).alias("o"), no_ts, "col", F.col("entity").cast("string").alias("text"))
    start = spark.range(1).select(F.lit(0).alias("o"), no_ts, F.lit(0).alias("col"), F.lit("").alias("text"))  # a header without entities

    cells = start.unionByName(head).unionByName(body).withColumn("block", F.floor((F.col("col") - 1) / BLOCK))
    pieces = _joined(cells.withColumn("last", F.col("col")), ["o", "ts", "block"])
    lines = _joined(pieces.drop("block"), ["o", "ts"])
    commas = lambda k: F.repeat(F.lit(","), k.cast("int"))  # noqa: E731 - none for k < 1
    rest = F.concat(commas(F.col("col") - 1), "text", commas(n - F.greatest("last", F.lit(1))))
    first = F.when(F.col("o") == 0, F.lit(ts)).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    done = lines.select("o", "ts", F.concat_ws(",", first, rest).alias("value"))
    done.repartition(1).sortWithinPartitions("o", "ts").select("value").write.mode("overwrite").text(path)


def _columns(prices: DataFrame) -> DataFrame:
    """``entity, col``: the column of every entity, 1, 2, … in name order; names are numbered range by range."""
    from regimekit.plans.hmm import numbered

    names = prices.select("entity").where("entity is not null").distinct()
    ranged = names.repartitionByRange("entity").withColumn("part", F.spark_partition_id())
    return numbered(cut_lineage(ranged, "wide-names"), [], F.col("part"), [F.col("entity")], "col").select("entity", "col")


def _joined(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, col, last, text``: texts that reach from column ``col`` to ``last`` as one, with a comma for each column between them."""
    a = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("col", "last", "text"))).alias("a"))
    before = lambda i: F.coalesce(F.get("a", i - 1)["last"], F.col("a")[0]["col"])
    twice = F.raise_error(F.lit("a price occurs twice")).cast("string")
    text = lambda x, i: F.when((i > 0) & (x["col"] <= before(i)), twice).otherwise(F.concat(F.repeat(F.lit(","), (x["col"] - F.greatest(before(i), F.lit(1))).cast("int")), x["text"]))
    return a.select(*keys, F.col("a")[0]["col"].alias("col"), F.element_at("a", -1)["last"].alias("last"), F.array_join(F.transform("a", text), "").alias("text"))

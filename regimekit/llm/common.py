"""Shared Spark helpers: tables, stages, ordered groups, connected components, row numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimekit.llm import kernels as K
from regimekit.session import _stage_tables, cut_lineage, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_BYTES = "8m"  # input of a Python worker at once, unless the session sets its own


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers and bound their batches by bytes, not only by rows."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's default
        spark.conf.set(key, ARROW_BYTES)


FILTER_BITS = 1 << 25  # at most 4 MB whatever the input's size
BITS_PER_ID = 32


def likely_in(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A boolean column function that is true for all values of a long ``column`` of ``ids``, and for few others.

    A bitmap filled by a hash, of 32 bits an id up to a fixed size; when very many ids fill it up, it only lets
    more rows pass.  An exact join follows it.  The bitmap is a constant of the plan, so no Python worker tests rows.
    """
    n = 1 << 16
    while n < min(FILTER_BITS, BITS_PER_ID * ids.count()):
        n *= 2
    slot = F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, s % 32))").alias("m"))
    bits = np.zeros(n >> 5, dtype=np.uint32)  # at most as many rows reach the driver
    rows = words.toPandas()
    bits[rows["w"].to_numpy()] = rows["m"].to_numpy().astype(np.uint32)
    one = pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits.view(np.int32)))
    held = ids.sparkSession.createDataFrame(pa.table({"bits": one})).scalar()

    def test(c: Column) -> Column:
        at = F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        return F.getbit(F.get(held, F.shiftright(at, 5)), at.bitwiseAND(F.lit(31))) == 1

    return test


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    out = cut_lineage(df, f"llm-{name}")
    out._stage_path = _stage_tables(df.sparkSession)[-1]
    return out


def release(*stages: DataFrame) -> None:
    """Delete tables of ``stage`` that nothing reads any more: what came from them is itself written."""
    for df in stages:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _stage_tables(spark).remove(df._stage_path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_extra(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of one ``key`` value (int64, not null) as one table each.

    The input partition is sorted by the key; only the group at hand is held.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and k[a] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over all rows of each key value; many small groups share a task and a batch.

    Groups must be bounded by the caller (see ``block_cells``).
    """
    n = shuffle_width(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, key):
            out = fn(group)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(K.tidy(run), schema)


def block_cells(df: DataFrame, key: str, count: str, row_hash: Column, block: int) -> DataFrame:
    """Split groups of more than ``block`` rows into blocks and pair the blocks.

    ``df`` has an int64 ``key`` and the number ``count`` of rows of that key.  Adds ``cell``
    (int64 group key), ``b`` (the row's block) and ``cross``: in a cell with ``cross`` true
    only pairs of rows of different blocks belong to the cell, else all pairs.  Every pair of
    rows of one key meets in exactly one cell, and a cell holds about two blocks.
    """
    blocks = F.ceil(F.col(count) / F.lit(block)).cast("int")
    df = df.withColumn("b", F.pmod(row_hash, blocks).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("b", "_o"), F.greatest("b", "_o")
    df = df.withColumn("cell", F.xxhash64(F.col(key), low, high)).withColumn("cross", F.col("b") != F.col("_o"))
    return df.drop("_o")


def dealt_again(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with its key under a new ``name`` that Spark does not take for the same partitioning.

    A join of rows with a per-key aggregate of the same rows would otherwise run on the aggregate's
    shuffle, which adaptive execution can't split; so both sides get a shuffle of their own and a hot key's rows are
    dealt over several tasks.
    """
    return df.withColumn(name, F.least(key, key)).drop(key)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of an undirected graph: ``(node, root)``, root the least node.

    ``edges`` has orderable columns ``u`` and ``v`` (u != v).  Large-star and small-star steps
    alternate until the edges stop changing; every step is two joins on a node with
    map-side minima, written to a stage table.  The result has the nodes that have an
    edge, the roots included.
    """

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return tuple(r)

    def by_min(e: DataFrame) -> DataFrame:
        return e.join(dealt_again(e.groupBy("u").agg(F.min("v").alias("m")), "u", "w"), F.col("u") == F.col("w")).drop("w")

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stage(e, f"{name}-edges")
    now = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = by_min(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        joined = by_min(large)
        small = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = stage(small, f"{name}-round")
        was, now = now, state(e)
        if was == now:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def number_in_group(df: DataFrame, group: list[str], order: list[Column], row_hash: Column, buckets: int, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, … within each ``group``, without one task per group.

    Rows of a group are dealt over ``buckets`` by ``row_hash``, numbered by ``order`` in each, and
    shifted by the counts of the group's earlier buckets (a small table: groups x buckets).
    """
    from pyspark.sql import Window

    df = df.withColumn("_nb", F.pmod(row_hash, F.lit(buckets)).cast("int"))
    counts = df.groupBy(*group, "_nb").agg(F.count("*").alias("_nc"))
    w = Window.partitionBy(*group).orderBy("_nb").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*group, "_nb", F.coalesce(F.sum("_nc").over(w), F.lit(0)).alias("_ns"))
    inner = Window.partitionBy(*group, "_nb").orderBy(*order)
    df = df.withColumn("_nr", F.row_number().over(inner) - 1)
    joined = df.join(shift.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_nb").alias("_g_nb"), "_ns"), [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group] + [F.col("_nb") == F.col("_g_nb")])
    return joined.withColumn(out, (F.col("_nr") + F.col("_ns")).cast("long")).drop("_nb", "_nr", "_ns", "_g_nb", *[f"_g_{c}" for c in group])


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 1024, small: int = 20_000) -> float | None:
    """The k-th largest value of a double column without nulls, exactly; None where k < 1.

    Histograms of ``bins`` counts narrow the range down until at most ``small`` values are left.
    """
    if k < 1:
        return None
    low, high, n = df.agg(F.min(key), F.max(key), F.count("*")).first()
    if n == 0 or k >= n:
        return low
    while True:
        inside = df.where((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high)))
        if n <= small:
            return inside.select(key).orderBy(F.col(key).desc()).limit(k).agg(F.min(key)).first()[0]
        if low == high:
            return low
        at = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1))
        rows = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]

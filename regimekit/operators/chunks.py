"""Windows over time without a task that holds a whole series.

A series (the rows of one key, in order of ``ts``) is dealt over tasks by chunks of consecutive rows.  ``with_halo``
gives each chunk the last rows of the one before, so that trailing windows are right in it; ``with_previous``
carries the last row of a month over to the next month that has rows.  ``moments`` replaces windows over whole
series by one merged row of statistics per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 8192  # rows of a series that one window partition holds, the halo not counted


def month(ts: str) -> Column:
    return F.trunc(F.col(ts).cast("date"), "month")


def with_halo(df: DataFrame, keys: list[str], halo: int, rows: int | None = None, ts: str = "ts") -> tuple[DataFrame, Window]:
    """Rows dealt by (keys, chunk), with copies of the last ``halo`` rows of the chunk before, and the window over a chunk.

    Adds ``_i`` (1, 2, … in the series), ``_chunk`` and ``_halo``; end with ``without_halo``.  Rows are
    numbered over the whole series first, so gaps in time don't matter.
    """
    from regimekit.plans.hmm import numbered

    size = max(rows or CHUNK_ROWS, halo, 1)
    n = numbered(df, keys, month(ts), [F.col(ts)], "_i")
    own = F.expr(f"cast((_i - 1) div {size} as int)")
    last = (F.col("_i") - 1) % size >= size - halo
    chunks = F.when(last, F.array(own, own + 1)).otherwise(F.array(own))
    n = n.withColumn("_own", own).withColumn("_chunk", F.explode(chunks))
    n = n.withColumn("_halo", F.col("_chunk") != F.col("_own")).drop("_own")
    return n, Window.partitionBy(*keys, "_chunk").orderBy("_i")


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_i", "_chunk", "_halo")


def with_previous(df: DataFrame, keys: list[str], columns: list[str], out: str = "prev", ts: str = "ts") -> DataFrame:
    """Add ``out``: a struct of ``ts`` and ``columns`` of the row before in the series, null for the first row.

    Inside a month that is a lag; the first row of a month takes the last row of the last month with rows, from a
    table of one row per key and month.
    """
    row = F.struct(ts, *columns)
    df = df.withColumn("_m", month(ts))
    last = df.groupBy(*keys, "_m").agg(F.max(row).alias("_last"))
    before = last.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_m").alias("_m2"), F.lag("_last").over(Window.partitionBy(*keys).orderBy("_m")).alias("_before")
    )
    inside = F.lag(row).over(Window.partitionBy(*keys, "_m").orderBy(ts, *columns))
    df = df.withColumn(out, inside)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_m").eqNullSafe(F.col("_m2"))]
    joined = df.join(before, on, "left").withColumn(out, F.coalesce(out, "_before"))
    return joined.drop("_m", "_m2", "_before", *[f"_k_{k}" for k in keys])


def known(c: Column | str) -> Column:
    """The value, with NaN as null: a NaN counts as missing in every statistic."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def moments(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: ``<column>_n``, ``_mean``, ``_sd`` (sample), ``_lo`` and ``_hi`` of each column, nulls and NaN left out.

    One aggregate that merges partial counts, means, squares, minima and maxima of the tasks.
    """
    parts = []
    for c in columns:
        v = known(F.col(c).cast("double"))
        parts += [F.count(v).alias(f"{c}_n"), F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_sd"), F.min(v).alias(f"{c}_lo"), F.max(v).alias(f"{c}_hi")]
    return df.groupBy(*keys).agg(*parts)


def with_rows_of(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a table of one row per key.

    The small side's keys are renamed by an expression, so the join doesn't take over the shuffle of an aggregate on the
    same keys, and adaptive execution can broadcast the small side or split a hot key.
    """
    renamed = small.select(*[F.least(k, k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])

"""Transition-matrix files (S7, S8): one file per entity and layer, as wide as that matrix has states.

Every matrix is one row of text on its way to and from a file, so matrices of 2, 3 or 30 states lie side by
side and each cell is named by the header of its own file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regimekit.functions.scalar import sanitize_entity, state_label

# The names and labels of the published file format.
FILE_NAME = r"^(.*)_transition_matrix(?:_layer(\d+))?\.csv$"
LABEL = r"^VS(?:(\d+)_)?(\d+)$"


def write_transition_csv(transitions: DataFrame, path: str) -> None:
    """A folder per (sanitised) entity and layer with the matrix as CSV: a header and a row per state.

    ``transitions`` has ``entity, layer_idx, from_state, to_state, prob``.  The states of a matrix are those it
    mentions; a pair without a row is an empty cell.  Names must differ once sanitised, and a pair may occur once.
    """
    cell = F.struct(F.struct("from_state", "to_state"), "prob")
    # a matrix is one row: its cells are bounded by the square of its states
    m = transitions.groupBy(sanitize_entity("entity").alias("entity_dir"), "layer_idx").agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    pairs = F.map_keys("m")
    m = m.withColumn("s", F.array_sort(F.array_distinct(F.concat(F.transform(pairs, lambda p: p["from_state"]), F.transform(pairs, lambda p: p["to_state"])))))
    labels = F.transform("s", lambda i: state_label("layer_idx", i))

    def line(i: Column) -> Column:
        probs = F.transform("s", lambda j: F.coalesce(F.try_element_at("m", F.struct(i.alias("from_state"), j.alias("to_state"))).cast("string"), F.lit("")))
        return F.concat(state_label("layer_idx", i), F.lit(","), F.array_join(probs, ","))

    text = F.concat(F.lit(","), F.array_join(labels, ","), F.lit("\n"), F.array_join(F.transform("s", line), "\n"))
    m.select("entity_dir", "layer_idx", text.alias("value")).write.mode("overwrite").partitionBy("entity_dir", "layer_idx").text(path)


def _decoded(c: Column) -> Column:
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def read_transition_csv(spark: SparkSession, path: str) -> DataFrame:
    """``entity, layer_idx, from_state, to_state, prob`` of all files at ``path`` (a folder of any depth or a glob).

    A file's entity comes from its folder ``entity_dir=…`` or its name ``<entity>_transition_matrix[_layer<l>].csv``, the layer
    from the labels ``VS<l>_<i>``, the folder ``layer_idx=…`` or the name.  A file without any layer (labels
    ``VS<i>``) is the fallback: it counts as layer 0 of entities that have no other file.  Empty cells are left out.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    where = _decoded(F.col("_metadata.file_path"))
    name = F.element_at(F.split(where, "/"), -1)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    cells = F.transform(lines, lambda x: F.transform(F.split(x, ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))))
    files = raw.select(
        F.coalesce(_decoded(_found(where, r"/entity_dir=([^/]+)/", 1)), _found(name, FILE_NAME, 1)).alias("entity"),
        F.coalesce(_found(where, r"/layer_idx=(\d+)/", 1), _found(name, FILE_NAME, 2)).alias("layer"),
        cells.alias("cells"),
    ).where("size(cells) > 1")
    files = files.withColumn("layer", F.coalesce(_found(F.element_at(F.col("cells")[0], -1), LABEL, 1), "layer").cast("int"))
    # a window over the few files of an entity
    layered = F.max(F.col("layer").isNotNull()).over(Window.partitionBy("entity"))
    files = files.withColumn("_layered", layered).where(F.col("layer").isNotNull() | ~F.col("_layered"))
    rows = files.select("entity", "layer", F.col("cells")[0].alias("head"), F.explode(F.slice("cells", 2, F.size("cells") - 1)).alias("row"))
    long = rows.select("entity", "layer", F.col("row")[0].alias("label"), F.explode(F.arrays_zip(F.slice("head", 2, F.size("head") - 1).alias("to"), F.slice("row", 2, F.size("row") - 1).alias("p"))).alias("x"))
    return long.where("x.p != ''").select(
        "entity",
        F.coalesce("layer", F.lit(0)).alias("layer_idx"),
        F.regexp_extract("label", LABEL, 2).cast("int").alias("from_state"),
        F.regexp_extract("x.to", LABEL, 2).cast("int").alias("to_state"),
        F.col("x.p").cast("double").alias("prob"),
    )


def row_sums(transitions: DataFrame) -> DataFrame:
    """Stochasticity check: sum of each row of each matrix."""
    return transitions.groupBy("entity", "layer_idx", "from_state").agg(F.sum("prob").alias("row_sum"))

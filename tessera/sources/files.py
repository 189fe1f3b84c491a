"""File sources: trees of named files, and whole texts."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import leading_int, power_of_two
from ..operators.staging import shared_folder


def sprite_tree(spark: SparkSession, root: str) -> DataFrame:
    """size, type, name, array_index of each `root`/<size>/<type>/<name>.png.

    Folders whose size is no positive number are skipped; a size that is no power of two raises when the frame runs.
    array_index counts names in their order from 0 in each (size, type). Only paths are read, not the images.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root).select("path")
    parts = F.regexp_extract_all("path", F.lit(r"([^/]+)/([^/]+)/([^/]+)\.png$"), F.lit(0))
    split = paths.where(F.size(parts) > 0).select(*(F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.png$", i).alias(n) for i, n in ((1, "size"), (2, "type"), (3, "name"))))
    sized = split.withColumn("size", leading_int(F.col("size"))).where("size > 0")
    checked = sized.withColumn("size", F.when(power_of_two(F.col("size")), F.col("size")).otherwise(F.raise_error(F.concat(F.lit("size is no power of two: "), F.col("size").cast("string"))).cast("bigint")))
    return checked.withColumn("array_index", F.expr("cast(row_number() over (partition by size, type order by name) - 1 as int)"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row (value) for each file."""
    return spark.read.text(path, wholetext=True)


def sample_tree(spark: SparkSession) -> str:
    """A small tree of stub files under the shared folder; returns its root."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(root)
    for name in ("16/grass/b.png", "16/grass/a.png", "16/stone/c.png", "32/stone/c.png", "none/stone/x.png", "32/stone/read.me"):
        folder, _, _ = f"{path}/{name}".rpartition("/")
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(b"\x89PNG")
    return root

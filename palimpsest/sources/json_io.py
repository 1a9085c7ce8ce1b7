"""Export to JSON and import from it."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.reads import json_row

#: What an import takes over; everything else of an exported row is made anew.
IMPORTED = T.StructType([T.StructField(c, T.StringType()) for c in ("ns", "key", "content", "kind", "priority", "meta")] + [T.StructField("tags", T.ArrayType(T.StringType()))])


def write_lines(exported: DataFrame, path: str) -> None:
    """One JSON object a line, in files that follow each other in the order of the rows."""
    exported.select(json_row().alias("value")).write.text(path)


def write_array(exported: DataFrame, out: TextIO) -> int:
    """One indented JSON array, a partition of rows at a time; null if there are no rows. Returns the rows."""
    n = 0
    for row in exported.select(json_row().alias("value")).toLocalIterator():
        body = json.dumps(json.loads(row["value"]), indent=2, ensure_ascii=False).replace("\n", "\n  ")
        out.write(("[\n  " if n == 0 else ",\n  ") + body)
        n += 1
    out.write("\n]\n" if n else "null\n")
    return n


def read_puts(spark: SparkSession, path: str) -> DataFrame:
    """The puts of an export: an array, or an object a line, in their order."""
    first = spark.read.text(path).select(F.ltrim("value").alias("value")).filter("value <> ''").first()
    array = first is not None and first["value"].startswith("[")
    rows = spark.read.schema(IMPORTED).option("multiLine", array).json(path)
    return rows.select(F.monotonically_increasing_id().alias("seq"), "ns", "key", "content", "kind", "tags", "priority", "meta", F.lit(None).cast("string").alias("ttl"))

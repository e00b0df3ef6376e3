"""The iris flowers from a CSV file: four measures and a class a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe.sources.batches import dense

CLASSES = ("setosa", "versicolor", "virginica")


def iris(spark: SparkSession, path: str) -> DataFrame:
    """row_id, value array<float> (sepal length and width, petal length and width), label 0..2.

    The public data set's file, or files in the order of their names, with or
    without a header; classes may be named (also with the genus) or numbered.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), ",").alias("f"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")).filter(F.size("f") == 5)
    measures = F.transform(F.slice("f", 1, 4), lambda x: x.try_cast("float"))
    name = F.lower(F.regexp_replace(F.trim(F.get("f", F.lit(4))), '"|Iris-', ""))
    label = F.coalesce(name.try_cast("smallint"), *[F.when(name == c, F.lit(k).cast("smallint")) for k, c in enumerate(CLASSES)])
    rows = lines.select(measures.alias("value"), label.alias("label"), "file", "line").filter(F.forall("value", lambda x: x.isNotNull()))
    return dense(rows, ["file", "line"]).select("row_id", "value", "label")
